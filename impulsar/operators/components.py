"""Cutting lineage in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset and there is no cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="impulsar-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/impulsar/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, which nothing may read any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(df._cut_at)
    at.getFileSystem(conf).delete(at, True)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u long, v long).

    Alternating large-star and small-star rounds; returns (node, component)
    for every node of an edge, the component being its smallest node.  Each
    round is joins and partially aggregated minima, cut to the shared folder;
    nothing is collected but a count and a checksum of the edges.
    """
    edges = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before_edges, edges = edges, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forget(before_edges)
        after = _signature(edges)
        if after == before:
            break
        before = after
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
