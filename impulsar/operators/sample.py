"""Estimation samples: singleton pruning, and horizons that share a sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.operators.components import cut


def survey(df: DataFrame, mask: str, keys: list[str], values: dict[str, str] | None = None) -> tuple[dict[str, tuple[int, int, int, int]], dict[str, float | None]]:
    """Sizes of groups and aggregates of rows, by one job.

    (levels, smallest group, largest group) of each key among the rows that
    ``mask`` holds for, and its levels in all rows; the aggregates, given in SQL
    like the mask, as numbers.
    """
    parts = []
    for k in dict.fromkeys(keys):
        per = df.groupBy(k).agg(F.expr(f"count_if({mask})").alias("n"))
        parts.append(per.agg(F.lit(k).alias("key"), F.expr("cast(array(count_if(n > 0), min(if(n > 0, n, null)), max(n), count(*)) as array<double>)").alias("found")))
    values = values or {}
    if values:
        every = ", ".join(f"cast({v} as double)" for v in values.values())
        parts.append(df.agg(F.lit(None).cast("string").alias("key"), F.expr(f"array({every})").alias("found")))
    rows = {r["key"]: r["found"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
    return {k: tuple(int(x or 0) for x in found) for k, found in rows.items() if k is not None}, dict(zip(values, rows.get(None, ()), strict=True))


def prune_singletons(df: DataFrame, effects: list[str]) -> tuple[DataFrame, int, int]:
    """Drop rows alone in a group of any effect, until none is left: (rows, dropped, rounds).

    Each round counts all effects on the same rows and drops the union; groups
    of one row are few and are anti-joined, the rows themselves are not shuffled
    for it unless that set is large.
    """
    dropped = rounds = 0
    while effects and any(low == 1 for _, low, _, _ in survey(df, "true", effects)[0].values()):
        left = df
        for e in dict.fromkeys(effects):
            left = left.join(df.groupBy(e).count().where("count = 1").select(e), e, "left_anti")
        before = df.count()
        left = cut(left.select(*df.columns))
        dropped, rounds, df = dropped + before - left.count(), rounds + 1, left
    return df, dropped, rounds


def mask_groups(df: DataFrame, unit: str, horizons: int) -> tuple[list[list[int]], list[int]]:
    """Horizons grouped by equal samples, and the number of anchors at each, by one aggregate."""
    keyed = F.xxhash64(unit, "__t")
    stats = df.agg(*[x for h in range(horizons + 1) for x in (
        F.sum(F.col(f"__m{h}").cast("long")).alias(f"n{h}"),
        F.sum(F.when(F.col(f"__m{h}"), keyed.cast("decimal(38,0)"))).alias(f"s{h}"),
        F.bit_xor(F.when(F.col(f"__m{h}"), keyed)).alias(f"x{h}"))]).first()
    groups: dict[tuple, list[int]] = {}
    for h in range(horizons + 1):
        groups.setdefault((stats[f"n{h}"], stats[f"s{h}"], stats[f"x{h}"]), []).append(h)
    return list(groups.values()), [stats[f"n{h}"] or 0 for h in range(horizons + 1)]
