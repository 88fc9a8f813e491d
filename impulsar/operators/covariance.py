"""Covariance meats: sums over rows, clusters, periods and lags of score products.

Rows are read in the orthonormal basis ``w = x R^-1``, in which the bread is the
identity; a score is ``w e_h``.  Each function returns meats (horizon x k x k)
in that basis.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.functions.lag_weights import last_lag, weights
from impulsar.operators.absorb import _PACK, Plan, _add, _pack, _total, blocks, residual_rows


@dataclass
class Fit:
    """Coefficients of one sample: the first ``k`` columns are regressors, the rest outcomes."""

    kept: np.ndarray
    k: int
    r: np.ndarray
    beta: np.ndarray

    @property
    def size(self) -> int:
        """Numbers in the meats of all horizons."""
        return len(self.kept) ** 2 * max(1, self.beta.shape[1])

    def rows(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows in the orthonormal basis, residuals) of residual rows."""
        x = z[:, self.kept]
        return np.linalg.solve(self.r.T, x.T).T, z[:, self.k :] - x @ self.beta


def _outer(s: np.ndarray, t: np.ndarray | None = None) -> np.ndarray:
    """Sum over rows of products of (rows x horizons x k) scores."""
    return np.einsum("nhi,nhj->hij", s, s if t is None else t, optimize=True)


def scores(w: np.ndarray, e: np.ndarray) -> np.ndarray:
    return e[:, :, None] * w[:, None, :]


def robust(df: DataFrame, plan: Plan, fit: Fit, kind: str) -> np.ndarray:
    """Squared residuals, for HC2 and HC3 over powers of one minus the leverage."""
    power = {"hc2": 1, "hc3": 2}.get(kind, 0)

    def run(batches):
        meat, low = 0.0, np.array([np.inf])
        for batch, starts in blocks(batches, plan):
            w, e = fit.rows(residual_rows(batch, starts, plan))
            if power:
                rest = 1 - (w * w).sum(axis=1)
                low[0] = min(low[0], rest.min())
                e = e / np.sqrt(np.maximum(rest, np.finfo(float).tiny) ** power)[:, None]
            meat = meat + _outer(scores(w, e))
        if not np.isscalar(meat):
            yield _pack((meat, low))

    meat, low = _total(df.mapInArrow(run, "payload binary"), lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1])), 8 * fit.size)
    if power and low[0] <= np.finfo(float).eps:
        raise ValueError(f"{kind} is undefined: an observation has leverage one")
    return meat


def _subsets(n: int) -> list[tuple[int, ...]]:
    return [s for size in range(1, n + 1) for s in combinations(range(n), size)]


def _meat_of(total: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return _outer(total.reshape(len(total), shape[1], shape[0]))


def clustered(df: DataFrame, plan: Plan, fit: Fit, keys: list[str], shape: tuple[int, int], slots: int) -> tuple[list[tuple], np.ndarray, list[int]]:
    """(subsets of terms, their meats, their numbers of clusters).

    Scores are summed by cluster inside each block, then by cluster over all
    blocks, then multiplied; a subset of terms is one grouping set of its own.
    The clusters of a subset with the absorbed group among its keys lie whole
    in a block: their products are formed there, and nothing is shuffled.
    """
    subsets = _subsets(len(keys))
    inside = [plan.group is not None and any(keys[j] == plan.group for j in subset) for subset in subsets]
    partial = pa.schema([("subset", pa.int32()), ("slot", pa.int32()), ("cluster", pa.binary()), ("total", pa.binary())])
    names = "subset int, slot int, cluster binary, total binary"

    def sums(batches):
        meats, counts = np.zeros((len(subsets), shape[1], shape[0], shape[0])), np.zeros(len(subsets), dtype=np.int64)
        for batch, starts in blocks(batches, plan):
            w, e = fit.rows(residual_rows(batch, starts, plan))
            s = scores(w, e).reshape(len(w), -1)
            coded = []
            for key in keys:
                words = batch.column(key).dictionary_encode()
                coded.append((words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary))
            for i, subset in enumerate(subsets):
                code = np.zeros(len(s), dtype=np.int64)
                for j in subset:
                    code = np.unique(code * len(coded[j][1]) + coded[j][0], return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
                total = np.add.reduceat(s[order], first, axis=0)
                counts[i] += len(total)
                if inside[i]:
                    meats[i] += _meat_of(total, shape)
                    continue
                parts = [coded[j][1].cast(pa.string()).take(pa.array(coded[j][0][order[first]])).to_pylist() for j in subset]
                ids = [hashlib.blake2b(repr(x).encode(), digest_size=16).digest() for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array([int.from_bytes(x[:4], "little") % slots for x in ids], pa.int32()), pa.array(ids, pa.binary()), pa.array([t.tobytes() for t in total], pa.binary())], schema=partial)
        counts[[i for i, whole in enumerate(inside) if not whole]] = 0
        if counts.any():
            yield pa.RecordBatch.from_pylist([{"subset": -1, "slot": TaskContext.get().partitionId() % slots, "cluster": b"", "total": pickle.dumps((meats, counts))}], partial)

    def multiply(key, table):
        i = key[0].as_py()
        if i < 0:
            return pa.Table.from_batches([_pack(reduce(_add, map(pickle.loads, table["total"].to_pylist())))], _PACK)
        ids = table["cluster"].combine_chunks().dictionary_encode()
        codes = ids.indices.to_numpy(zero_copy_only=False)
        rows = np.frombuffer(b"".join(table["total"].to_pylist())).reshape(len(codes), -1)
        order = np.argsort(codes, kind="stable")
        total = np.add.reduceat(rows[order], np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) != 0))), axis=0)
        meats, counts = np.zeros((len(subsets), shape[1], shape[0], shape[0])), np.zeros(len(subsets), dtype=np.int64)
        meats[i], counts[i] = _meat_of(total, shape), len(total)
        return pa.Table.from_batches([_pack((meats, counts))], _PACK)

    summed = df.mapInArrow(sums, names)
    payloads = summed.select(F.col("total").alias("payload")) if all(inside) else summed.groupBy("subset", "slot").applyInArrow(multiply, "payload binary")
    meats, counts = _total(payloads, _add, 8 * len(subsets) * fit.size)
    return subsets, meats, counts.tolist()


#: Rows of a unit beyond which long lags are taken by products with the weight matrix, not pair by pair of rows.
LONG = 64
#: Clock steps for each row up to which that product is a convolution on the grid.
DENSE = 8


def _by_distance(unit: np.ndarray, time: np.ndarray, s: np.ndarray, kernel: str, bandwidths: list[int], far: int) -> np.ndarray:
    """Weighted products of rows a number of places apart, for all units at once; only lags that occur are visited."""
    meat = np.zeros((s.shape[1], s.shape[2], s.shape[2]))
    for apart in range(1, len(unit)):
        now = apart + np.flatnonzero((unit[apart:] == unit[:-apart]) & (time[apart:] - time[:-apart] <= far))
        if not len(now):  # rows further apart have longer lags
            break
        lag = time[now] - time[now - apart]
        w = np.stack([weights(kernel, b, lag) for b in bandwidths], axis=1)
        gamma = _outer(s[now] * w[:, :, None], s[now - apart])
        meat += gamma + gamma.transpose(0, 2, 1)
    return meat


def _smoothed(time: np.ndarray, x: np.ndarray, kernel: str, bandwidth: int) -> np.ndarray:
    """Rows of one unit, each the weighted sum of all others: by FFT on a dense clock, else by blocks of the weight matrix."""
    span = int(time[-1] - time[0])
    if span < DENSE * len(time):
        size = 1 << (2 * span + 1).bit_length()
        lags = np.arange(1, span + 1)
        w = np.zeros(size)
        w[1 : span + 1] = weights(kernel, bandwidth, lags)
        w[size - lags] = w[1 : span + 1]
        turned, at, out = np.fft.rfft(w), time - time[0], np.empty_like(x)
        for column in range(x.shape[1]):
            grid = np.zeros(size)
            grid[at] = x[:, column]
            out[:, column] = np.fft.irfft(np.fft.rfft(grid) * turned, size)[at]
        return out
    far, out = last_lag(kernel, bandwidth, span), np.zeros_like(x)
    for i in range(0, len(time), 512):
        mine = time[i : i + 512]
        first, end = (np.searchsorted(time, v, side) for v, side in ((mine[0] - min(far, int(mine[0])), "left"), (mine[-1], "right")))
        later = np.searchsorted(time - mine[-1], far, "right") if far < span else len(time)
        for j in range(first, max(end, later), 4096):
            lag = np.abs(mine[:, None] - time[None, j : min(j + 4096, max(end, later))])
            w = weights(kernel, bandwidth, lag.ravel()).reshape(lag.shape)
            out[i : i + 512] += np.where(lag > 0, w, 0.0) @ x[j : j + lag.shape[1]]
    return out


def _lagged(unit: np.ndarray, time: np.ndarray, s: np.ndarray, kernel: str, bandwidths: list[int]) -> np.ndarray:
    """Weighted sum over exact lags within units; rows sorted by unit and time, times not negative."""
    meat = _outer(s)
    if not len(s):
        return meat
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.append(starts, len(unit)))
    span = int((time[starts + sizes - 1] - time[starts]).max())
    far = max(last_lag(kernel, b, span) for b in bandwidths)
    long = (sizes > LONG) & (far > LONG)
    rest = np.flatnonzero(~np.repeat(long, sizes))
    meat = meat + _by_distance(unit[rest], time[rest], s[rest], kernel, bandwidths, far)
    for start, size in zip(starts[long], sizes[long], strict=True):
        part = slice(start, start + size)
        for bandwidth in set(bandwidths):
            same = [h for h, b in enumerate(bandwidths) if b == bandwidth]
            x = s[part][:, same]
            meat[same] += _outer(x, _smoothed(time[part], x.reshape(size, -1), kernel, bandwidth).reshape(x.shape))
    return meat


def hac(df: DataFrame, plan: Plan, fit: Fit, unit: str, kernel: str, bandwidths: list[int]) -> np.ndarray:
    """Serial covariance within units, exact calendar lags."""
    if plan.group == unit:
        def run(batches):
            meat = 0.0
            for batch, starts in blocks(batches, plan):
                w, e = fit.rows(residual_rows(batch, starts, plan))
                numbers = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w))))
                time = batch.column("__t").to_numpy()
                order = np.lexsort((time, numbers))
                meat = meat + _lagged(numbers[order], time[order], scores(w, e)[order], kernel, bandwidths)
            if not np.isscalar(meat):
                yield _pack((meat,))

        return _total(df.mapInArrow(run, "payload binary"), _add, 8 * fit.size)[0]

    rows = residual_scores(df, plan, fit, unit).repartition(unit).sortWithinPartitions(unit, "__t")
    by_unit = Plan([], unit, block_rows=plan.block_rows)

    def run(batches):
        meat = 0.0
        for batch, starts in blocks(batches, by_unit):
            numbers = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            raw = np.frombuffer(b"".join(batch.column("score").to_pylist())).reshape(batch.num_rows, len(bandwidths), -1)
            meat = meat + _lagged(numbers, batch.column("__t").to_numpy(), raw, kernel, bandwidths)
        if not np.isscalar(meat):
            yield _pack((meat,))

    return _total(rows.mapInArrow(run, "payload binary"), _add, 8 * fit.size)[0]


def residual_scores(df: DataFrame, plan: Plan, fit: Fit, unit: str) -> DataFrame:
    def run(batches):
        for batch, starts in blocks(batches, plan):
            w, e = fit.rows(residual_rows(batch, starts, plan))
            packed = pa.array([x.tobytes() for x in scores(w, e)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(unit), batch.column("__t"), packed], names=[unit, "__t", "score"])

    return df.mapInArrow(run, f"`{unit}` {df.schema[unit].dataType.simpleString()}, __t long, score binary")


def driscoll_kraay(df: DataFrame, plan: Plan, fit: Fit, kernel: str, bandwidths: list[int], k: int) -> np.ndarray:
    """Scores summed by period, then lagged over periods; one row per period reaches the driver."""
    schema = pa.schema([("__t", pa.int64()), ("score", pa.binary())])

    def sums(batches):
        for batch, starts in blocks(batches, plan):
            w, e = fit.rows(residual_rows(batch, starts, plan))
            time, inverse = np.unique(batch.column("__t").to_numpy(), return_inverse=True)
            total = np.zeros((len(time), e.shape[1] * k))
            np.add.at(total, inverse, scores(w, e).reshape(len(w), -1))
            yield pa.RecordBatch.from_arrays([pa.array(time), pa.array([t.tobytes() for t in total], pa.binary())], schema=schema)

    def fold(key, table):
        total = np.frombuffer(b"".join(table["score"].to_pylist())).reshape(table.num_rows, -1).sum(axis=0)
        return pa.Table.from_pydict({"__t": [key[0].as_py()], "score": [total.tobytes()]}, schema=schema)

    rows = df.mapInArrow(sums, "__t long, score binary").groupBy("__t").applyInArrow(fold, "__t long, score binary").orderBy("__t").collect()
    time = np.array([r["__t"] for r in rows], dtype=np.int64)
    s = np.frombuffer(b"".join(bytes(r["score"]) for r in rows)).reshape(len(rows), len(bandwidths), k)
    return _lagged(np.zeros(len(rows), dtype=np.int64), time, s, kernel, bandwidths)


def residual_frame(df: DataFrame, plan: Plan, fit: Fit, unit: str, horizons: list[int]) -> DataFrame:
    """(unit, __t, residual per horizon), lazily."""
    def run(batches):
        for batch, starts in blocks(batches, plan):
            _, e = fit.rows(residual_rows(batch, starts, plan))
            yield pa.RecordBatch.from_arrays([batch.column(unit), batch.column("__t"), *[pa.array(e[:, i]) for i in range(len(horizons))]], names=[unit, "__t", *[f"residual_{h}" for h in horizons]])

    kinds = ", ".join([f"`{unit}` {df.schema[unit].dataType.simpleString()}", "__t long", *[f"residual_{h} double" for h in horizons]])
    return df.mapInArrow(run, kinds)
