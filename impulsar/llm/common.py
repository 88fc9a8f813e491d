"""Shared pieces of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsar.operators.components import components, cut, shared_folder

__all__ = ["WORD", "components", "cut", "partitions", "salted_join", "shared_folder", "word_count"]

#: Words of a text: maximal runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_by: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join of many rows a key (``left``) with one row a key, where one key may hold a large part of ``left``.

    Rows of a key are dealt by ``salt_by`` over ``salts`` tasks, to each of which
    the key's row goes; ``right`` should be the smaller side.
    """
    left = left.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
