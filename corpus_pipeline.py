"""A corpus pipeline over ``documents``: five of the corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, as
it changed them; ``run`` writes each stage's documents as Parquet to the shared
folder and hands what it reads back to the next.  The last stage returns ids.

Nulls in any column, empty and repeated rows, empty tables and further columns
are the operators' defined cases; a document with a null id is never dropped as
a near duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impulsar.llm.common import cut
from impulsar.llm.mixing import mix, taken_rows
from impulsar.llm.ngram_jaccard import ngram_jaccard_components
from impulsar.llm.secret_scan import scan_secrets
from impulsar.llm.sentencepiece_codec import encode
from impulsar.llm.toxicity import score_toxicity, train

TOXIC_FROM = 0.5
MASK = "[SECRET]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``.

    A null or empty text scores like one without hits; repeated rows and rows
    with a null id are judged by their text alone; an empty table gives none.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, score_column="__toxicity", keep_text=True)
    return scored.where(F.col("__toxicity") < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component, by id and then text; rows with one id are one document only if their texts are equal.

    Null, empty and wordless texts link with nothing and stay, once an id; rows
    with a null id stay, repeated ones too; an empty table gives none.
    """
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__doc")))
    if repeated.isEmpty():
        gone = ngram_jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)
    same = docs["doc_id"] == repeated["__doc"]
    order = W.partitionBy("doc_id").orderBy("text")
    shared = docs.join(repeated, same, "left_semi").withColumn("__nth", F.row_number().over(order)).withColumn("__before", F.lag("text").over(order))
    shared = shared.where("__nth = 1 OR NOT text <=> __before").drop("__before")
    every = docs.join(repeated, same, "left_anti").withColumn("__nth", F.lit(1)).unionByName(shared)
    every = cut(every.withColumn("__node", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = ngram_jaccard_components(every, id_column="__node").select(F.col("doc_id").alias("__found"), F.col("component_id").alias("__component"))
    nodes = every.select("__node", F.struct("doc_id", "__nth").alias("__at")).join(found, F.col("__node") == F.col("__found"))
    kept = nodes.groupBy("__component").agg(F.min_by("__node", "__at").alias("__kept"))
    gone = nodes.join(kept, "__component").where("__node <> __kept").select(F.col("__node").alias("__gone"))
    return every.join(gone, every["__node"] == gone["__gone"], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``MASK``.

    Null and empty texts have no secrets and stay as they are; each row is
    masked by itself, whatever its id, and a long text whole.
    """
    found = scan_secrets(docs, spans_column="__spans", redact=MASK)
    if "n_chars" in docs.columns:
        changed = F.size("__spans") > 0
        found = found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last pass may take a document's first words only.

    Null and wordless texts have no words to take and leave here; a null source
    is a source; rows of one id, null or not, are taken each by itself.
    """
    taken = taken_rows(mix(docs, carry=True))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return taken.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in place of texts, with their number.

    A null or empty text has no ids; rows are independent, so repeated rows and
    null ids change nothing; a long text is encoded whole.
    """
    return encode(docs, ids_column="ids").withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
