"""Operator 8: SentencePiece encoding and decoding by streaming Viterbi.

A text streams through the model chunk by chunk, a chunk ending where no piece
can cross, so every path has a boundary there; inside a chunk
``pieces.encode_part`` keeps a window of a few lengths of the longest piece and
commits where the surviving paths meet.  Ids of chunks met before come from a bounded cache.

The path rule follows the model file: best score for unigram models, the
merge-consistent path for BPE models (see ``pieces``).

Defined cases: a null or empty text has no ids and decodes to the empty text;
letters outside the vocabulary fall back to bytes, or to the unknown id; U+2581
in a text decodes to a space, as the tokenizer itself does; rows are
independent, so repeated rows, null ids and other columns change nothing.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.llm.pieces import BYTE, CONTROL, DEFAULT_MODEL, SPACE, UNKNOWN, Chunks, PieceModel, encode_chunk, read_model, shared
from impulsar.llm.words import release

CACHE_CHUNKS, BATCH_BYTES = 150_000, 1 << 22


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.cache = Chunks(model, lambda part: array("i", encode_chunk(model, part)).tobytes(), b"".join, CACHE_CHUNKS)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.model.chunks(text))), dtype="<i4")


class Decoder:
    """Ids back to text: each id is a run of bytes."""

    def __init__(self, model: PieceModel):
        def surface(piece, kind):
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            return b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

        table = [surface(p, t) for p, t in zip(model.pieces, model.types, strict=True)]
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.strip = model.dummy_prefix

    def decode(self, ids: np.ndarray) -> str:
        n = self.sizes[ids]
        total = int(n.sum())
        at = np.arange(total) + np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.strip and text[:1] == " " else text


def _slices(batches, column: str):
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(size, 1)))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, "<i4")]).astype(np.int32)))


def encode(docs: DataFrame, *, text_column: str = "text", ids_column: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All other columns of ``docs`` and array<int> ``ids_column``."""
    data = read_model(model_path)
    kept = [c for c in docs.columns if c not in (text_column, ids_column)]
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_column}`").cast("string").alias("__text"))

    def run(batches):
        encoder = shared(data, Encoder, "encoder")
        for part in _slices(batches, "__text"):
            ids = _lists([encoder.encode(t) for t in part.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "__ids"])
            ids = None
            release(part.nbytes, keep=True)

    schema = ", ".join([f"{n} {t}" for n, t in given.dtypes if n != "__text"] + ["__ids array<int>"])
    return given.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("__ids").alias(ids_column))


def decode(encoded: DataFrame, *, ids_column: str = "ids", text_column: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All columns of ``encoded`` and the decoded ``text_column``; null ids decode to the empty text."""
    data = read_model(model_path)
    kept = [c for c in encoded.columns if c != text_column]
    given = encoded.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    at = kept.index(ids_column)

    def run(batches):
        decoder = shared(data, Decoder, "decoder")
        for part in _slices(batches, f"k{at}"):
            column = part.column(at).cast(pa.list_(pa.int32()))
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            texts = [decoder.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "__text"])

    schema = ", ".join([f"{n} {t}" for n, t in given.dtypes] + ["__text string"])
    return given.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("__text").alias(text_column))
