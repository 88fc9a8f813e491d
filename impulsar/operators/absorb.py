"""Absorption of fixed effects and moments of what is left.

The strategies, chosen from the numbers of levels:

* none: no effects;
* ``exact_group``: one effect, its group means taken inside the partition;
* ``exact_schur``: the largest effect likewise, the levels of the others (at
  most ``MAX_LEVELS`` together) through the Schur complement that is left of
  their dummies; no iteration.  Effects of few levels in all are taken out
  this way together, without a group and so without a shuffle;
* ``schur_cg``: the same complement without forming it, for levels in the
  millions: conjugate gradients on one value a level and column.  A step reads
  the keys in place and sends sums by level; rows never move;
* ``map``: alternating group-mean projections over windows, beyond the bound on
  level values, until changes and group means are below the tolerance.

A partition holds whole groups of the absorbed effect.  Rows stream through
``blocks`` as float matrices; what returns to the driver is small: sums over
levels, triangular factors, sandwich meats.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impulsar.operators.components import cut, forget

MAX_LEVELS = 1000
#: Level values (levels x columns) that the driver holds and a task receives at most.
MAX_VALUES = 1 << 22
BLOCK_VALUES = 1 << 21
#: Bytes of payloads that the driver may receive in one job.
DIRECT_BYTES = 1 << 25
_PACK = pa.schema([("payload", pa.binary())])


@dataclass
class Plan:
    """How rows become residual rows; plain values, shipped to the tasks."""

    columns: list[str]
    group: str | None = None
    dims: list[str] = field(default_factory=list)
    levels: list[list] = field(default_factory=list)
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    gamma: np.ndarray | None = None  # coefficients of the levels, by column
    method: str = "none"
    iterations: int = 0
    accepted: int = 0
    block_rows: int | None = None  # rows a task holds at once, beyond whole groups

    @property
    def iterative(self) -> bool:
        return self.method in ("schur_cg", "map")

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0] + [len(x) for x in self.levels])


def _codes(column: pa.Array, levels: list) -> np.ndarray:
    return pc.index_in(column, pa.array(levels, column.type)).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(batches, plan: Plan):
    """(batch, group starts) of whole groups of ``plan.group``, in blocks of bounded size."""
    held, rows = [], 0  # batches, the last ones perhaps an unfinished group
    most = plan.block_rows or max(1, BLOCK_VALUES // max(1, len(plan.columns)))

    def emit(parts: list):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if plan.group is None:
            return batch, np.zeros(1, dtype=np.int64)
        key = batch.column(plan.group)
        new = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        return batch, np.concatenate(([0], np.flatnonzero(new) + 1)).astype(np.int64)

    for whole in batches:
        for low in range(0, whole.num_rows, most):
            batch = whole.slice(low, most)
            if held and rows + batch.num_rows > most:
                if plan.group is None:
                    yield emit(held)
                    held, rows = [], 0
                else:  # the group that ends what is held may go on in this batch
                    key = batch.column(plan.group)
                    same = pc.equal(key, held[-1].column(plan.group)[-1]).to_numpy(zero_copy_only=False)
                    end = int(np.argmin(same)) if not same.all() else batch.num_rows
                    if end < batch.num_rows:
                        yield emit([*held, batch.slice(0, end)] if end else held)
                        held, rows, batch = [], 0, batch.slice(end)
            held.append(batch)
            rows += batch.num_rows
    if rows:
        yield emit(held)


def matrix(batch: pa.RecordBatch, plan: Plan) -> np.ndarray:
    z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in plan.columns]).astype(np.float64)
    if plan.center is not None:
        z = (z - plan.center) / plan.scale
    return z


def residual_rows(batch: pa.RecordBatch, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """Rows of all columns with the effects taken out."""
    z = matrix(batch, plan)
    if plan.gamma is not None:
        for dim, levels, start in zip(plan.dims, plan.levels, plan.starts[:-1], strict=True):
            z = z - plan.gamma[start + _codes(batch.column(dim), levels)]
    return z if plan.group is None else _demeaned(z, starts)


def _demeaned(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(z)))
    for _ in range(2):  # the second pass removes the rounding of the first
        z = z - np.repeat(np.add.reduceat(z, starts, axis=0) / sizes[:, None], sizes, axis=0)
    return z


def _pack(value) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"payload": pickle.dumps(value)}], _PACK)


def _total(df: DataFrame, add, size: int):
    """Sum of the partitions' payloads of ``size`` bytes; folded by tasks first where they may be many."""
    parts = df.sparkSession.sparkContext.defaultParallelism + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts * size > DIRECT_BYTES:
        slots = max(1, int(parts**0.5))

        def fold(batches):
            whole = None
            for batch in batches:
                for value in batch.column("payload").to_pylist():
                    value = pickle.loads(value)
                    whole = value if whole is None else add(whole, value)
            if whole is not None:
                yield _pack(whole)

        df = df.repartition(slots).mapInArrow(fold, "payload binary")
    rows = df.toLocalIterator() if parts * size > DIRECT_BYTES else df.collect()
    return reduce(add, (pickle.loads(row["payload"]) for row in rows))


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _sums(codes: np.ndarray, z: np.ndarray, levels: int) -> np.ndarray:
    return np.stack([np.bincount(codes, weights=z[:, j], minlength=levels) for j in range(z.shape[1])], axis=1)


def _merged(a: tuple, b: tuple) -> tuple:
    """Sum of two (groups, levels, S, D'Z) whose levels may differ."""
    levels = a[1] + [x for x in b[1] if x not in set(a[1])]
    at = {x: i for i, x in enumerate(levels)}
    s, dz = np.zeros((len(levels), len(levels))), np.zeros((len(levels), a[3].shape[1]))
    for _, own, part, sums in (a, b):
        to = np.array([at[x] for x in own], dtype=np.int64)
        s[np.ix_(to, to)] += part
        dz[to] += sums
    return a[0] + b[0], levels, s, dz


def schur_sums(df: DataFrame, plan: Plan, levels: int) -> tuple:
    """(groups, [(dim, level)], S, D'Z): the Schur complement of the dims' dummies after the group, and their cross products.

    Tasks number the levels that they meet, so no job reads them before; ``levels`` is how many there are.
    """
    bare = Plan(plan.columns, plan.group, center=plan.center, scale=plan.scale, block_rows=plan.block_rows)

    def run(batches):
        groups, at, s, dz = 0, {}, np.zeros((levels, levels)), np.zeros((levels, len(plan.columns)))
        for batch, starts in blocks(batches, bare):
            z, codes = residual_rows(batch, starts, bare), []
            n = len(z)
            for i, dim in enumerate(plan.dims):
                words = batch.column(dim).dictionary_encode()
                numbers = np.array([at.setdefault((i, v), len(at)) for v in words.dictionary.to_pylist()], dtype=np.int64)
                codes.append(numbers[words.indices.to_numpy(zero_copy_only=False)])
            for i, c in enumerate(codes):
                dz += _sums(c, z, levels)
                s[np.diag_indices(levels)] += np.bincount(c, minlength=levels)
                for other in codes[:i]:
                    cell, times = np.unique(c * levels + other, return_counts=True)
                    s[cell // levels, cell % levels] += times
                    s[cell % levels, cell // levels] += times
            if plan.group is not None:
                sizes = np.diff(np.append(starts, n))
                group = np.repeat(np.arange(len(starts)), sizes)
                step = max(1, BLOCK_VALUES // levels)
                for low in range(0, len(starts), step):
                    rows = slice(starts[low], starts[low + step] if low + step < len(starts) else n)
                    many = min(step, len(starts) - low)
                    counts = np.zeros(many * levels)
                    for c in codes:
                        counts += np.bincount((group[rows] - low) * levels + c[rows], minlength=many * levels)
                    counts = counts.reshape(many, levels)
                    s -= (counts / sizes[low : low + step, None]).T @ counts
                groups += len(starts)
        if at:
            yield _pack((groups, list(at), s[: len(at), : len(at)], dz[: len(at)]))

    return _total(df.mapInArrow(run, "payload binary"), _merged, 8 * levels * (levels + len(plan.columns)))


def factor(df: DataFrame, plan: Plan) -> tuple:
    """(rows, groups, R): triangular factor of all residual columns, by QR of QRs."""
    p = len(plan.columns)

    def run(batches):
        n, groups, r = 0, 0, np.zeros((0, p))
        for batch, starts in blocks(batches, plan):
            z = residual_rows(batch, starts, plan)
            n += len(z)
            groups += len(starts) if plan.group is not None else 0
            r = np.linalg.qr(np.vstack([r, z]), mode="r")
        if n:
            yield _pack((n, groups, r))

    def add(a, b):
        return a[0] + b[0], a[1] + b[1], np.linalg.qr(np.vstack([a[2], b[2]]), mode="r")

    n, groups, r = _total(df.mapInArrow(run, "payload binary"), add, 8 * p * p)
    if len(r) < p:
        r = np.vstack([r, np.zeros((p - len(r), p))])
    return n, groups, r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def strategy(effects: list[str], counts: list[int], unit: str) -> tuple[int | None, list[int]] | None:
    """(the effect taken out by groups, if any; those taken out through the Schur complement), or None for alternating projections."""
    order = sorted(range(len(effects)), key=lambda i: -counts[i])
    if unit not in effects and sum(counts) <= 2 * MAX_LEVELS:
        return None, order
    main = effects.index(unit) if unit in effects and counts[order[0]] <= MAX_LEVELS else order[0]
    rest = [i for i in order if i != main]
    return (main, rest) if sum(counts[i] for i in rest) <= MAX_LEVELS else None


def vector_group(effects: list[str], counts: list[int], unit: str, columns: int) -> int | None:
    """The effect to take out by groups, best the unit, so that the levels of the others fit ``MAX_VALUES``; None if they never do."""
    for main in sorted(range(len(effects)), key=lambda i: (effects[i] != unit, -counts[i])):
        if (sum(counts) - counts[main]) * columns <= MAX_VALUES:
            return main
    return None


def make_plan(df: DataFrame, columns: list[str], effects: list[str], counts: list[int], *, unit: str, center, scale, tol: float, max_iter: int, acceleration: str = "none", block_rows: int | None = None) -> tuple[DataFrame, Plan, tuple | None]:
    """Rows laid out for a strategy, the plan, and (groups, rank of S) where a Schur complement was formed."""
    plan = Plan(columns, center=center, scale=scale, block_rows=block_rows)
    if not effects:
        plan.center, plan.method = np.zeros(len(columns)), "none"
        return df, plan, None
    if (chosen := strategy(effects, counts, unit)) is None:
        if (main := vector_group(effects, counts, unit, len(columns))) is None:
            return _alternate(df, plan, effects, tol, max_iter, acceleration)
        return _conjugate(df, plan, effects, main, unit, tol, max_iter)
    main, rest = chosen
    plan.method, plan.iterations = "exact_schur" if rest else "exact_group", 1
    if main is not None:
        plan.group = effects[main]
        if plan.group != unit:
            df = df.repartition(plan.group).sortWithinPartitions(plan.group)
    if not rest:
        return df, plan, None
    plan.dims = [effects[i] for i in rest]
    groups, found, s, dz = schur_sums(df, plan, sum(counts[i] for i in rest))
    order = sorted(range(len(found)), key=found.__getitem__)
    s, dz = s[np.ix_(order, order)], dz[order]
    plan.levels = [[found[j][1] for j in order if found[j][0] == i] for i in range(len(rest))]
    values, vectors = np.linalg.eigh(s)
    good = values > values[-1] * len(values) * 1e-14 * max(1.0, np.sqrt(len(values)))
    plan.gamma = vectors[:, good] @ ((vectors[:, good].T @ dz) / values[good][:, None])
    return df, plan, (groups, int(good.sum()))


def _level_sums(df: DataFrame, plan: Plan, known, vector: np.ndarray | None = None) -> np.ndarray:
    """Sums by level of the residual rows, or of level values ``vector`` spread over the rows, group means taken out; one pass over the keys."""
    spark, size = df.sparkSession, int(plan.starts[-1])
    sent = spark.sparkContext.broadcast(plan.gamma if vector is None else vector)
    bare = Plan(plan.columns, plan.group, list(plan.dims), center=plan.center, scale=plan.scale, block_rows=plan.block_rows)
    spread, starts = vector is not None, plan.starts[:-1]

    def run(batches):
        levels, values, total, n = [pa.array(x) for x in known.value], sent.value, None, 0
        for batch, first in blocks(batches, bare):
            codes = [at + pc.index_in(batch.column(d), x.cast(batch.column(d).type)).to_numpy(zero_copy_only=False).astype(np.int64) for d, x, at in zip(bare.dims, levels, starts, strict=True)]
            z = sum(values[c] for c in codes)
            if not spread:
                z = matrix(batch, bare) - z
            z = _demeaned(z, first)
            if total is None:
                total = np.zeros((size, z.shape[1]))
            for c in codes:
                total += _sums(c, z, size)
            n += len(z)
        if n:
            yield _pack((total,))

    try:
        needed = [plan.group, *plan.dims, *([] if spread else plan.columns)]
        return _total(df.select(*dict.fromkeys(needed)).mapInArrow(run, "payload binary"), _add, 8 * size * len(plan.columns))[0]
    finally:
        sent.destroy()


def _conjugate(df: DataFrame, plan: Plan, effects: list[str], main: int, unit: str, tol: float, max_iter: int) -> tuple[DataFrame, Plan, None]:
    """Level values by conjugate gradients, scaled by the levels' rows, restarted from the rows until every group mean is below ``tol``."""
    plan.method, plan.group = "schur_cg", effects[main]
    if plan.group != unit:
        df = df.repartition(plan.group).sortWithinPartitions(plan.group).persist()
    plan.dims = [e for i, e in enumerate(effects) if i != main]
    sizes = [sorted(df.groupBy(d).count().collect(), key=lambda r: r[0]) for d in plan.dims]
    plan.levels = [[r[0] for r in rows] for rows in sizes]
    n = np.array([r[1] for rows in sizes for r in rows], dtype=np.float64)[:, None]
    plan.gamma = np.zeros((len(n), len(plan.columns)))
    known, before = df.sparkSession.sparkContext.broadcast(plan.levels), np.inf
    try:
        while True:
            r = _level_sums(df, plan, known)
            if (largest := np.abs(r / n).max()) < tol:
                return df, plan, None
            if plan.iterations >= max_iter or not largest < before / 2:
                raise RuntimeError(f"fixed-effect absorption did not converge in {plan.iterations} iterations")
            before, aim = largest, tol / 10
            x, along = np.zeros_like(r), r / n
            length = (r * along).sum(axis=0)
            while np.abs(r / n).max() >= aim and plan.iterations < max_iter:
                spread = _level_sums(df, plan, known, along)
                curve = (along * spread).sum(axis=0)
                step = np.divide(length, curve, out=np.zeros_like(length), where=curve > 0)
                x, r = x + step * along, r - step * spread
                now = (r * r / n).sum(axis=0)
                along = r / n + np.divide(now, length, out=np.zeros_like(now), where=length > 0) * along
                length = now
                plan.iterations += 1
            plan.gamma = plan.gamma + x
    finally:
        known.destroy()


def _largest_means(df: DataFrame, effects: list[str], values: dict) -> dict[str, float]:
    """Largest absolute group mean of each value over all effects, by one job."""
    parts = [df.groupBy(e).agg(*[F.avg(v).alias(n) for n, v in values.items()]).agg(*[F.max(F.abs(n)).alias(n) for n in values]) for e in effects]
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {n: max(r[n] for r in rows) for n in values}


def _extrapolated(df: DataFrame, columns: list[str], effects: list[str], kind: str) -> tuple[DataFrame, int]:
    """Irons-Tuck or Aitken step from the last three iterates, for the columns whose group means it lowers."""
    late, early = {c: F.col(c) - F.col(f"__p_{c}") for c in columns}, {c: F.col(f"__p_{c}") - F.col(f"__o_{c}") for c in columns}
    base = late if kind == "irons_tuck" else early
    turn = {c: late[c] - early[c] for c in columns}
    sums = df.agg(*[F.sum(base[c] * turn[c]).alias(f"n{c}") for c in columns], *[F.sum(turn[c] * turn[c]).alias(f"d{c}") for c in columns]).first()
    steps = {c: sums[f"n{c}"] / sums[f"d{c}"] for c in columns if sums[f"d{c}"]}
    tries = {c: (F.col(c) if kind == "irons_tuck" else F.col(f"__o_{c}")) - step * base[c] for c, step in steps.items() if np.isfinite(step)}
    if not tries:
        return df, 0
    found = _largest_means(df, effects, {f"t_{c}": v for c, v in tries.items()} | {f"c_{c}": F.col(c) for c in tries})
    taken = {c: v for c, v in tries.items() if np.isfinite(found[f"t_{c}"]) and found[f"t_{c}"] < found[f"c_{c}"]}
    return df.withColumns(taken), len(taken)


def _alternate(df: DataFrame, plan: Plan, effects: list[str], tol: float, max_iter: int, acceleration: str) -> tuple[DataFrame, Plan, None]:
    """Alternating projections on centred, scaled columns; each sweep is cut to the shared folder."""
    columns = plan.columns
    df = df.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, plan.center, plan.scale, strict=True)})
    names, last = df.columns, None
    for done in range(1, max_iter + 1):
        history = {f"__o_{c}": F.col(f"__p_{c}") for c in columns if f"__p_{c}" in df.columns} | {f"__p_{c}": F.col(c) for c in columns}
        now = df.withColumns(history)
        for effect in effects:
            group = W.partitionBy(effect)
            now = now.withColumns({c: F.col(c) - F.avg(c).over(group) for c in columns})
        df = cut(now)
        if last is not None:
            forget(last)
        last = df
        moved = df.agg(F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"__p_{c}"))) for c in columns], F.lit(0.0)).alias("d")).first()["d"]
        if moved < tol and max(_largest_means(df, effects, {c: F.col(c) for c in columns}).values()) < tol:
            plan.center, plan.scale = np.zeros(len(columns)), np.ones(len(columns))
            plan.method, plan.iterations = "map", done
            return df.select(*names), plan, None
        if acceleration != "none" and done % 3 == 0:
            df, taken = _extrapolated(df, columns, effects, acceleration)
            plan.accepted += taken
    raise RuntimeError(f"fixed-effect absorption did not converge in {max_iter} iterations")
