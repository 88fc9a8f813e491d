"""Ranks of fixed effects, and what a cluster correction counts."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.operators.components import components

#: Levels beside the largest effect that are eliminated as a dense matrix at the end.
MAX_DENSE = 2000
#: Pairs of levels beside the largest effect that the driver holds at most.
MAX_CELLS = 1 << 21
#: Products of two remainders fit a long.
PRIMES = (2**31 - 1, 2**31 - 19)


@dataclass(frozen=True)
class Rank:
    rank: int
    exact: bool
    method: str


def pair_components(df: DataFrame, a: str, b: str) -> int:
    """Connected components of the graph that rows draw between two effects' levels."""
    pairs = df.select(F.xxhash64(F.lit(0), a).alias("u"), F.xxhash64(F.lit(1), b).alias("v")).distinct()
    return components(pairs).select("component").distinct().count()


def nested(df: DataFrame, fine: str, coarse: str) -> bool:
    """Whether each level of ``fine`` lies in one level of ``coarse``."""
    per = df.groupBy(fine).agg((F.min(coarse) == F.max(coarse)).alias("one"))
    return bool(per.agg(F.bool_and("one")).first()[0])


def _cross_products(df: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (u <= v, both numbered from 0) of the cross products of the other effects' levels within the levels of ``keys[0]``.

    A row is told from the first one of its level of ``keys[0]``: one on its own
    levels, minus one on those of the first row, on none that they share.  Rows
    so told have the rank of all dummies less the levels of ``keys[0]``, whatever
    their weights, so rows of equal levels count once and all cells are whole
    numbers.
    """
    others = [f"n{i}" for i in range(1, len(keys))]
    rows = df.select(F.col(keys[0]).alias("g"), *[F.xxhash64(F.lit(i), keys[i]).alias(f"n{i}") for i in range(1, len(keys))]).distinct()
    first = rows.groupBy("g").agg(F.min(F.struct(*others)).alias("f"))
    apart = rows.join(first, "g").select(*others, *[F.col(f"f.{n}").alias(f"f{n}") for n in others]).distinct()
    ends = [(n, 1) for n in others] + [(f"f{n}", -1) for n in others]
    # Both orders of each pair, so that a level which a row shares with the first one adds up to nothing.
    terms = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(x * y).cast("long").alias("s")) for a, x in ends for b, y in ends])
    cells = apart.select(F.explode(terms).alias("c")).where("c.u <= c.v").groupBy("c.u", "c.v").agg(F.sum("c.s").alias("s")).where("s <> 0").persist()
    try:
        if (n := cells.count()) > MAX_CELLS:
            raise ValueError(f"exact rank of {len(keys)} fixed effects with {n} pairs of levels beside the largest effect exceeds the budget of {MAX_CELLS} pairs; use fe_dof='conservative'")
        found = cells.toArrow()
    finally:
        cells.unpersist()
    u, v, s = (found.column(c).to_numpy() for c in ("u", "v", "s"))
    _, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return at[: len(u)], at[len(u) :], s


def _eliminated(u: np.ndarray, v: np.ndarray, s: np.ndarray, n: int, p: int) -> int:
    """Rank modulo ``p`` of symmetric cross products, by diagonal pivots: never above their rank.

    Levels of the fewest cells go first, until those left, at most ``MAX_DENSE``, make a dense matrix.
    """
    rows: list[dict[int, int] | None] = [{} for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), (s % p).tolist(), strict=True):
        if x:
            rows[a][b] = rows[b][a] = x
    queue = [(len(row), i) for i, row in enumerate(rows)]
    heapify(queue)
    rank, left, held = 0, n, sum(size for size, _ in queue)
    while left:
        size, i = queue[0]
        row = rows[i]
        if row is None or size != len(row):  # its cells have changed since
            heappop(queue)
            continue
        if left <= MAX_DENSE and 5 * size >= left:  # rows this full are cheaper as a matrix
            break
        heappop(queue)
        rows[i], left, held = None, left - 1, held - size
        pivot = row.pop(i, 0)
        rank += bool(pivot)
        inverse = pow(pivot, -1, p) if pivot else 0
        for j, x in row.items():
            other, factor = rows[j], x * inverse % p
            held -= len(other)
            del other[i]
            for k, y in row.items() if factor else ():
                if value := (other.get(k, 0) - factor * y) % p:
                    other[k] = value
                else:
                    other.pop(k, None)
            held += len(other)
            heappush(queue, (len(other), j))
        if held > 2 * MAX_CELLS:
            raise ValueError(f"exact rank of fixed effects with {left} levels left beside the largest effect exceeds the budget of {MAX_DENSE} levels; use fe_dof='conservative'")
    kept = {i: at for at, i in enumerate(i for i, row in enumerate(rows) if row is not None)}
    dense = np.zeros((left, left), dtype=np.int64)
    for i, at in kept.items():
        for j, x in rows[i].items():
            dense[at, kept[j]] = x
    for k in range(left - 1, -1, -1):
        if pivot := int(dense[k, k]):
            rank += 1
            rest = dense[:k, :k]
            rest -= np.outer(dense[:k, k] * pow(pivot, -1, p) % p, dense[k, :k])
            rest %= p
    return rank


def _multiway(df: DataFrame, keys: list[str], counts: list[int]) -> int:
    """Rank of the dummies of three or more effects, the largest first."""
    u, v, s = _cross_products(df, keys)
    n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1
    # A prime that divides a pivot can only lower a rank; the second one is another draw.
    return counts[0] + max(_eliminated(u, v, s, n, p) for p in PRIMES)


def effect_rank(df: DataFrame, keys: list[str], counts: list[int], mode: str) -> Rank:
    """Rank of the dummies of several effects; ``counts`` are their numbers of levels."""
    if not keys:
        return Rank(0, True, "none")
    if len(keys) == 1:
        return Rank(counts[0], True, "levels")
    if len(keys) == 2:
        return Rank(sum(counts) - pair_components(df, *keys), True, "components")
    if mode == "conservative":
        shared = max(pair_components(df, a, b) for a, b in combinations(keys, 2))
        return Rank(sum(counts) - shared, False, "conservative")
    kept: list[int] = []
    for i in sorted(range(len(keys)), key=lambda i: -counts[i]):
        if not any(nested(df, keys[j], keys[i]) for j in kept):
            kept.append(i)
    if len(kept) < 3:
        return Rank(effect_rank(df, [keys[i] for i in kept], [counts[i] for i in kept], mode).rank, True, "reduced")
    return Rank(_multiway(df, [keys[i] for i in kept], [counts[i] for i in kept]), True, "elimination")
