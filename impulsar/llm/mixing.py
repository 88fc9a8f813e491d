"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment.

1. Sizes are word counts; sources in code-point order (null last) weigh
   ``weights`` in turn and share all words, no target above ``max_repeats`` times
   its source, the excess reshared by weight until none is above.
2. A block is one word, so that every source meets its target to the word,
   however small it is beside the others.  Blocks go to sources, and then to each
   source's hash shards, by the highest quotients ``votes / (2 seats + 1)``, never
   beyond what ``max_repeats`` of a shard holds.
3. Inside a shard, documents lie in an order drawn from the seed.  The shard's
   quota is read off that order from the start, over and over: whole passes
   first, then a part of one more pass.  So a document is taken at most
   ``max_repeats`` times, and reruns agree.

Only per-source and per-shard totals reach the driver; the number of shards is
bounded by ``max_shards`` plus the number of sources.

Defined cases: a null or wordless text has size 0 and takes 0; a null source is
a source of its own; repeated rows are counted and taken like any others; with
no words every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impulsar.llm.common import cut, word_count

WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, 20240229
MAX_SHARDS, SHARD_WORDS = 1 << 16, 1_000_000


def targets(sizes: list[int], weights: list[int], max_repeats: int) -> list[float]:
    """Shares of the total by weight, capped at ``max_repeats`` times each size."""
    out, open_rows, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_rows:
        unit = rest / sum(weights[i] for i in open_rows)
        over = [i for i in sorted(open_rows) if unit * weights[i] > max_repeats * sizes[i]]
        if not over:
            for i in open_rows:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
            rest -= out[i]
            open_rows.remove(i)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 seats + 1)``, at most ``caps`` each; ties go to the earlier."""
    total = sum(votes)
    given = [0] * len(votes)
    if total <= 0 or seats <= 0:
        return given
    low, high = 0.0, total  # divisors: low gives too many seats, high too few
    at = lambda d: [min(c, int(v / d + 0.5)) for v, c in zip(votes, caps, strict=True)]
    for _ in range(80):
        middle = (low + high) / 2
        if middle > 0 and sum(at(middle)) <= seats:
            high = middle
        else:
            low = middle
    given = at(high)
    if sum(given) > seats:
        given = [0] * len(votes)
    queue = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, given, caps, strict=True)) if g < c and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows as a table from Arrow, for which the executors start no Python."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(schema.types)], schema=schema))


_SOURCES = pa.schema([("s", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("shards", pa.int64())])
_SHARDS = pa.schema([("s", pa.string()), ("k", pa.int64()), ("shard_size", pa.int64()), ("quota", pa.int64())])


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, max_shards: int = MAX_SHARDS, shard_words: int = SHARD_WORDS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source.

    With ``carry`` the whole input row follows as the struct ``doc``.
    """
    spark = docs.sparkSession
    measured = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column)).alias("size"), *([F.struct(*docs.columns).alias("doc")] if carry else []))
    sizes = cut(measured.select("doc_id", "source", "size"))
    by_source = sorted(sizes.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    held = [int(r["n"]) for r in by_source]
    total = sum(held)
    wanted = targets(held, [weights[i % len(weights)] for i in range(len(held))], max_repeats)
    per_shard = max(shard_words, -(-total // max_shards))
    source_rows = [(r["source"], n, t, max(1, -(-n // per_shard))) for r, n, t in zip(by_source, held, wanted, strict=True)]
    of_source = _frame(spark, source_rows, _SOURCES)
    small = F.broadcast if len(source_rows) <= max_shards else lambda df: df

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(small(of_source), rows["source"].eqNullSafe(of_source["s"])).drop("s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))

    shard_rows: dict = {}
    for r in placed(sizes).groupBy("source", "shard").agg(F.sum("size").alias("n")).orderBy("shard").collect():
        shard_rows.setdefault(r["source"], []).append((int(r["shard"]), int(r["n"])))
    quotas = sainte_lague(wanted, total, [max_repeats * n for n in held])
    dealt = []
    for (source, *_), quota in zip(source_rows, quotas, strict=True):
        shards = shard_rows.get(source, [])
        given = sainte_lague([float(n) for _, n in shards], quota, [max_repeats * n for _, n in shards])
        dealt += [(source, k, n, g) for (k, n), g in zip(shards, given, strict=True)]
    of_shard = _frame(spark, dealt, _SHARDS)
    every = placed(measured if carry else sizes)
    few = F.broadcast if len(dealt) <= 2 * max_shards else lambda df: df
    joined = every.join(few(of_shard), every["source"].eqNullSafe(of_shard["s"]) & (every["shard"] == of_shard["k"])).drop("s", "k")

    order = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    passes = F.coalesce(F.expr("quota div nullif(shard_size, 0)"), F.lit(0))
    begun = joined.withColumn("before", F.sum("size").over(order) - F.col("size")).withColumn("passes", passes)
    part = F.least(F.greatest(F.col("quota") - F.col("passes") * F.col("shard_size") - F.col("before"), F.lit(0)), F.col("size"))
    return begun.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long")).select("doc_id", "size", "source_size", "target", "taken", "source", *(["doc"] if carry else []))


def taken_rows(mixed: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The mix itself, from ``mix(..., carry=True)``: each document as often as it is taken.

    Whole passes give whole copies; a last part gives a copy of its first words, joined by one space.
    """
    passes = F.expr("taken div nullif(size, 0)")
    rest = F.col("taken") - F.col("passes") * F.col("size")
    rows = mixed.where("taken > 0").withColumn("passes", passes).withColumn("rest", rest)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes") + (F.col("rest") > 0).cast("long"))))
    words = F.slice(F.filter(F.split(F.col(f"doc.{text_column}"), r"[\x20\x09-\x0D]+"), lambda x: x != ""), F.lit(1), F.col("rest").cast("int"))
    text = F.when(F.col("copy") <= F.col("passes"), F.col(f"doc.{text_column}")).otherwise(F.array_join(words, " "))
    names = mixed.schema["doc"].dataType.names
    return rows.select(*[text.alias(c) if c == text_column else F.col(f"doc.`{c}`").alias(c) for c in names])
