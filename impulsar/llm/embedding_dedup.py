"""Operator 2: embedding near-dedup by collision-counting projections.

*Cells.*  Unit vectors are put on ``LINES`` random lines in each of ``TABLES``
tables.  On every sorted line the two ends are windows of their own: a vector
belongs to the ends of the few lines on which it lies farthest out, and a cell
is a set of ``k`` such ends.  Two vectors near each other share ends; how many
of its ends a vector is entered under is calibrated by pairs drawn at the
threshold cosine, so that such a pair meets in no table with probability ``MISS``
at most.  ``k`` grows with the logarithm of a label's rows, which keeps cells
small: pairs compared grow about in proportion to the rows.

*Counts.*  Within a cell, ``PROJECTIONS`` further lines are sorted, and every
vector within ``HALF_WIDTH`` of a query vector collides with it.  A pair at the
threshold collides on a line with probability ``erf(w / (d sqrt 2))``,
``d**2 = 2 - 2 cos``; the count that it passes but for ``MISS`` of the time makes
a candidate.  Candidates are verified by their cosine in double precision.

Only vectors of one label and length meet.  Equal vectors (128-bit digests) are
one row with a multiplicity.  A cell of more than ``block_rows`` rows is split
by hash into pairs of blocks, small cells share tasks; a pair that meets in several cells counts in the
first alone.  A task gives, for each vector, the number of its links there, and
a spanning forest of them: never all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without a label, are rows of their own with no links;
rows with one id are one node (the links of their different vectors are added); null ids link with
nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.llm.common import components, cut, salted_join

COSINE, PROJECTIONS, HALF_WIDTH, MISS, BLOCK_ROWS, SEED = 0.93, 64, 0.4, 1e-6, 1024, 20240229
TABLES, LINES, TRIALS = 3, 128, 6000
#: Components of vectors that a task holds of small cells at once; pairs of a cell that are counted without sorting.
PACK_VALUES, SMALL = 1 << 18, 1 << 12
#: Sets of ends that a vector may be entered under; short vectors share many ends and get smaller sets.
MAX_ENTRIES = 512
#: Rows of a label beyond which cells are sets of one more end.
DEEPER = (1 << 17, 1 << 24)


def least_count(cosine: float, projections: int, half_width: float, miss: float) -> int:
    """Largest count that a pair at ``cosine`` falls short of with probability ``miss`` at most."""
    p = math.erf(half_width / max(math.sqrt(2 - 2 * cosine), 1e-12) / math.sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return count


def collisions(left: np.ndarray, right: np.ndarray, half_width: float) -> np.ndarray:
    """Number of lines (columns) on which each right vector lies in each left vector's window."""
    counts = np.zeros((len(left), len(right)), dtype=np.uint16)
    place = np.empty(len(right), dtype=np.uint32)
    for line in range(left.shape[1]):
        order = np.argsort(right[:, line], kind="stable")
        values = right[order, line]
        place[order] = np.arange(len(right), dtype=np.uint32)
        low = np.searchsorted(values, left[:, line] - half_width, side="left").astype(np.uint32)
        wide = np.searchsorted(values, left[:, line] + half_width, side="right").astype(np.uint32) - low
        for a in range(0, len(left), 64):  # places below a window wrap around
            counts[a : a + 64] += place - low[a : a + 64, None] < wide[a : a + 64, None]
    return counts


@lru_cache(8)
def table_lines(dim: int, tables: int, lines: int, seed: int) -> np.ndarray:
    """The lines of all tables, side by side; orthonormal in stretches of ``dim``."""
    rng = np.random.default_rng([seed, dim])
    stretches = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-tables * lines // dim))]
    return np.hstack(stretches)[:, : tables * lines]


def ends(unit: np.ndarray, lines: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` ends (twice the line, and one more at its upper end) farthest out, ascending."""
    at = unit @ lines
    far = np.argpartition(-np.abs(at), min(most, at.shape[1] - 1), axis=1)[:, :most] if most < at.shape[1] else np.tile(np.arange(at.shape[1]), (len(at), 1))
    return np.sort(2 * far + (np.take_along_axis(at, far, axis=1) > 0), axis=1)


@lru_cache(32)
def depth(dim: int, k: int, cosine: float, tables: int, lines: int, miss: float, seed: int) -> int:
    """Ends per vector with which pairs at ``cosine`` share ``k`` in some table but for ``miss`` of the time."""
    rng = np.random.default_rng([seed, dim, 1])
    x = rng.standard_normal((TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((TRIALS, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = cosine * x + math.sqrt(1 - cosine**2) * y
    own = table_lines(dim, tables, lines, seed)[:, :lines]
    left, right = np.abs(x @ own), np.abs(y @ own)
    order, other = np.argsort(-left, axis=1), np.argsort(-right, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lines)[None], axis=1)
    there = np.empty_like(other)
    np.put_along_axis(there, other, np.arange(lines)[None], axis=1)
    worst = np.maximum(rank, there)
    worst[np.signbit(x @ own) != np.signbit(y @ own)] = lines
    needed = np.sort(worst, axis=1)[:, min(k, lines) - 1] + 1  # ends a pair needs to share k
    allowed = miss ** (1 / tables)
    found = int(np.sort(needed)[max(0, math.ceil(TRIALS * (1 - allowed)) - 1)])
    return min(found, lines)


def entries(dim: int, k: int, cosine: float, tables: int, lines: int, miss: float, seed: int) -> tuple[int, int]:
    """(ends in a cell, ends per vector) for vectors of a length, at most ``k`` in a cell."""
    most = depth(dim, k, cosine, tables, lines, miss, seed)
    while k > 1 and math.comb(most, k) * tables > MAX_ENTRIES:
        k -= 1
        most = depth(dim, k, cosine, tables, lines, miss, seed)
    return k, most


def _units(column: pa.Array) -> np.ndarray:
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _cells(cosine: float, tables: int, lines: int, miss: float, seed: int):
    """Adds ``cells``: every set of k ends of a vector, as table and ends in one number."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ks = batch.column("vector"), batch.column("k").to_numpy(zero_copy_only=False)
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            found: list = [None] * len(dims)
            for dim, k in {(int(d), int(k)) for d, k in zip(dims, ks, strict=True)}:
                rows = np.flatnonzero((dims == dim) & (ks == k))
                unit = _units(vectors.take(pa.array(rows)))
                k, most = entries(dim, k, cosine, tables, lines, miss, seed)
                every = table_lines(dim, tables, lines, seed)
                sets = np.array(list(combinations(range(most), k)))
                numbers = []
                for t in range(tables):
                    out = ends(unit, every[:, t * lines : (t + 1) * lines], most)
                    number = np.full((len(rows), len(sets)), t, dtype=np.int64)
                    for j in range(k):
                        number = number * (2 * lines) + out[:, sets[:, j]]
                    numbers.append(number)
                for row, cells in zip(rows.tolist(), np.hstack(numbers), strict=True):
                    found[row] = cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return run


def _first_here(x: np.ndarray, y: np.ndarray, of_table: list[np.ndarray], cells: np.ndarray, k: int, lines: int) -> np.ndarray:
    """Whether each pair shares the ends of its cell first, and too few ends in the tables before."""
    digits, rest = [], cells
    for _ in range(k):
        rest, digit = np.divmod(rest, 2 * lines)
        digits.append(digit)
    table, own = rest, np.stack(digits[::-1], axis=1)
    here = np.ones(len(x), dtype=bool)
    for low in range(0, len(x), 1 << 14):
        part = np.arange(low, min(len(x), low + (1 << 14)))
        for t, out in enumerate(of_table):
            at = part[(table[part] >= t) & here[part]]
            a, b = out[x[at]], out[y[at]]
            shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
            lowest = np.sort(np.where(shared, a, np.iinfo(a.dtype).max), axis=1)[:, :k]
            here[at] = np.where(table[at] > t, shared.sum(axis=1) < k, (lowest == own[at]).all(axis=1))
    return here


def _candidates(placed: np.ndarray, left: np.ndarray, right: np.ndarray, half_width: float, least: int):
    """Pairs of a cell that pass the count; a small cell needs no sorting."""
    if len(left) * len(right) <= SMALL:
        x, y = np.nonzero((np.abs(placed[left][:, None] - placed[right][None]) <= half_width).sum(axis=2) >= least)
        yield left[x], right[y]
        return
    for low in range(0, len(left), 512):
        x, y = np.nonzero(collisions(placed[left[low : low + 512]], placed[right], half_width) >= least)
        yield left[low + x], right[y]


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _links(cosine: float, projections: int, half_width: float, miss: float, tables: int, lines: int, seed: int):
    least = least_count(cosine, projections, half_width, miss)

    def run(key, table):
        dim, k, i, j = (key[n].as_py() for n in (1, 2, 4, 5))
        table = table.sort_by("cell")
        ids, copies, block, cell = (table[c].to_numpy() for c in ("rep", "copies", "block", "cell"))
        unit = _units(table["vector"].combine_chunks())
        placed = unit @ np.random.default_rng(seed).standard_normal((dim, projections))
        edges = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
        xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if high - low < 2:
                continue
            left, right = (low + np.flatnonzero(block[low:high] == n) for n in (i, j))
            for x, y in _candidates(placed, left, right, half_width, least):
                if i == j:
                    x, y = x[x < y], y[x < y]
                for part in range(0, len(x), 1 << 16):
                    u, v = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                    holds = (unit[u] * unit[v]).sum(axis=1) >= cosine
                    xs.append(u[holds])
                    ys.append(v[holds])
        x, y = np.concatenate(xs), np.concatenate(ys)
        if len(x):
            k, most = entries(dim, k, cosine, tables, lines, miss, seed)
            every = table_lines(dim, tables, lines, seed)
            of_table = [ends(unit, every[:, t * lines : (t + 1) * lines], most) for t in range(tables)]
            here = _first_here(x, y, of_table, cell[x], k, lines)
            x, y = x[here], y[here]
        links, label, joined = np.zeros(len(ids), dtype=np.int64), np.unique(ids, return_inverse=True)[1], []
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        while len(x):  # one edge at a time, and drop what it joins
            a, b = int(x[0]), int(y[0])
            joined.append((a, b))
            label[label == label[b]] = label[a]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
        some = np.flatnonzero(links)
        rows = [{"u": int(ids[n]), "v": None, "links": int(links[n])} for n in some] + [{"u": int(ids[a]), "v": int(ids[b]), "links": 0} for a, b in joined]
        return pa.Table.from_pylist(rows, _FOUND)

    return run


def embedding_near_duplicates(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cosine: float = COSINE, projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS, block_rows: int = BLOCK_ROWS, tables: int = TABLES, lines: int = LINES, deeper: tuple[int, ...] = DEEPER, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    sound = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    positive = F.transform("vector", lambda x: x + F.lit(0).cast(given.schema["vector"].dataType.elementType))  # no negative zeros
    digest = ["label", "h1", "h2"]
    sound = sound.withColumn("vector", positive).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(seed), "vector", F.reverse("vector"))})
    same = cut(sound.groupBy(*digest).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))

    rows = same.select("rep", "copies", "label", "vector", F.size("vector").alias("dim"))
    sizes = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("k", 1 + sum((F.col("n") > n).cast("int") for n in deeper))
    rows = rows.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, ["label", "dim"])
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    entered = rows.mapInArrow(_cells(cosine, tables, lines, miss, seed), f"{kinds}, cells array<long>")
    entered = entered.withColumn("n_packs", F.ceil(F.col("n") * F.size("cells") * F.col("dim") / F.lit(PACK_VALUES))).withColumn("cell", F.explode("cells")).drop("cells")
    place = ["label", "dim", "k", "cell"]
    large = cut(entered.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    dealt = entered.join(F.broadcast(large) if large.count() < 10_000 else large, place, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.withColumn("pack", F.when(F.col("n_blocks") > 1, F.col("cell")).otherwise(-1 - F.pmod(F.xxhash64("cell"), F.col("n_packs"))))
    paired = dealt.select("label", "dim", "k", "pack", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "vector", "block")
    found = cut(paired.groupBy("label", "dim", "k", "pack", "i", "j").applyInArrow(_links(cosine, projections, half_width, miss, tables, lines, seed), "u long, v long, links long"))

    linked = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    groups = same.drop("vector").join(linked, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    members = salted_join(sound.select("vec_id", *digest), groups, digest, "vec_id").groupBy("vec_id", "rep").agg(F.first("copies").alias("copies"), F.first("links").alias("links"))
    nodes = cut(members.groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.col("links")).alias("n_links"), F.min("rep").alias("rep"), F.when(F.count(F.lit(1)) > 1, F.collect_set("rep")).alias("reps")))
    shared = nodes.where("reps IS NOT NULL").select(F.explode("reps").alias("u"), F.col("rep").alias("v")).where("u <> v")
    classes = components(found.where("v IS NOT NULL").select("u", "v").unionByName(shared)).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    nodes = salted_join(nodes.select("vec_id", "rep", "n_links"), classes, ["rep"], "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    out = given.select("vec_id").join(nodes.drop("rep"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
