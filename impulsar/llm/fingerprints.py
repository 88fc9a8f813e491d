"""Operator 4: document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the top bits choose one of ``BINS`` bins, the
bin keeps the lowest value.  An empty bin copies the first filled bin in an
order of its own (optimal densification), and the low ``8`` bits of each bin are
stored.  Likeness is the share of equal bins, less what equal low bits of
different values give: ``(m - c) / (1 - c)``, ``c = 2**-8``, cut to 0..1.

Documents are compared with their successor by ascending id: a range shuffle
puts neighbours together, tasks hold one document back, and only the first and
last document of each partition meet in a table as long as the partitions.

Defined cases: null and wordless texts have the empty fingerprint, likeness 1
among themselves and 0 to any other; texts of fewer than five words are one
shingle; null ids come first, equal ids by text; a single document is its own
successor; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impulsar.llm.common import cut, partitions
from impulsar.llm.words import Words, mix64, rolling, shingle_set

WIDTH, BINS, BITS, BATCH_BYTES = 5, 256, 8, 1 << 21
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
#: _ORDER[i, j]: how early bin j comes in the order in which empty bin i looks for a value.
_ORDER = np.argsort(np.argsort(mix64(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1 << 32)).reshape(BINS, BINS), axis=1), axis=1).astype(np.uint16)


def fingerprints(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BINS bytes, whether a row has words) of a column of texts."""
    words = Words(texts, lower=True)
    table = np.full((words.rows, BINS), _EMPTY)
    counts = np.diff(words.bounds)
    every = rolling(words.hashes, width)
    if len(every):
        row = np.repeat(np.arange(words.rows), counts)[: len(every)]
        inside = np.arange(len(every)) + width <= words.bounds[1:][row]
        every, row = every[inside], row[inside]
        np.minimum.at(table.reshape(-1), row * BINS + (every >> _BIN_SHIFT).astype(np.int64), mix64(every))
    for short in np.flatnonzero((counts > 0) & (counts < width)):
        for h in shingle_set(words.row_hashes(short), width):
            table[short, int(h >> _BIN_SHIFT)] = mix64(np.uint64([h]))[0]
    filled = table != _EMPTY
    for r in np.flatnonzero((counts > 0) & ~filled.all(axis=1)):
        have, lack = np.flatnonzero(filled[r]), np.flatnonzero(~filled[r])
        table[r, lack] = table[r, have[_ORDER[lack][:, have].argmin(axis=1)]]
    return (table & np.uint64((1 << BITS) - 1)).astype(np.uint8), counts > 0


def likeness(a: np.ndarray, b: np.ndarray, a_full: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    near = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_full & b_full, near, (a_full == b_full).astype(float))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_FIELDS = [("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
_ROWS = pa.schema(_FIELDS)
_ROWS_SQL = "part long, place long, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_DONE, _FIRST, _LAST = 0, 1, 2


def _finished(part: int, ids: list, texts: list[str], following: list[str], prints, full, next_prints, next_full) -> pa.RecordBatch:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other, other_full = fingerprints(pa.array(new, pa.large_string()))
    pack = lambda rows, has: [r.tobytes() if h else b"" for r, h in zip(rows, has, strict=True)]
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([part] * n, pa.int64()), pa.array([_DONE] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array(pack(prints, full), pa.binary()), pa.array(pack(other, other_full), pa.binary()),
        pa.array(likeness(prints, other, full, other_full)), pa.array(likeness(prints, next_prints, full, next_full)), pa.nulls(n, pa.string()),
    ], schema=_ROWS)


def _edge(part: int, place: int, doc, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "place": place, "doc_id": doc, "text": text}], _ROWS)


def _neighbours(batches):
    """Each document with its successor in this partition; the partition's first and last as they are."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        column = batch.column("text")
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(column.nbytes, 1)))
        for low in range(0, batch.num_rows, step):
            ids, texts = batch.column("doc_id").slice(low, step).to_pylist(), [t or "" for t in column.slice(low, step).to_pylist()]
            prints, full = fingerprints(pa.array(texts, pa.large_string()))
            if held is None:
                yield _edge(part, _FIRST, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
                prints, full = np.concatenate([held[2], prints]), np.concatenate([held[3], full])
            if len(ids) > 1:
                yield _finished(part, ids[:-1], texts[:-1], texts[1:], prints[:-1], full[:-1], prints[1:], full[1:])
            held = ids[-1], texts[-1], prints[-1:], full[-1:]
    if held is not None:
        yield _edge(part, _LAST, held[0], held[1])


def _meet(batches):
    for batch in batches:
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
        for doc, text, after in zip(ids, texts, following, strict=True):
            prints, full = fingerprints(pa.array([text, after], pa.large_string()))
            yield _finished(-1, [doc], [text], [after], prints[:1], full[:1], prints[1:], full[1:])


def fingerprint_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next."""
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    dealt = given.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = cut(dealt.mapInArrow(_neighbours, _ROWS_SQL))
    firsts, lasts = rows.where(F.col("place") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("following")), rows.where(F.col("place") == _LAST).select("part", "doc_id", "text")
    # Part numbers alone, as many as there are partitions, go through one task; the texts join after.
    order = firsts.select(F.col("next").alias("part"))
    order = order.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0)))).alias("next"))
    met = lasts.join(order, "part").join(firsts, "next").select("doc_id", "text", "following")
    return rows.where(F.col("place") == _DONE).unionByName(met.mapInArrow(_meet, _ROWS_SQL)).drop("part", "place", "text")
