"""Operator 9: token counts by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary matches by their end; each
position carries the best path's last piece, score and piece count in a ring as
long as the longest piece, and no ids are kept.  Path and tie rules are the
model's own (see ``pieces``).

Defined cases: a null or empty text counts 0; letters outside the vocabulary
count their fallback bytes, or one unknown id a run; rows are independent, so
repeated rows, null ids and other columns change nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.llm.pieces import DEFAULT_MODEL, Chunks, PieceModel, count_chunk, read_model, shared
from impulsar.llm.sentencepiece_codec import _slices

CACHE_CHUNKS = 250_000


class Counter:
    def __init__(self, model: PieceModel):
        self.model = model
        self.cache = Chunks(model, lambda part: count_chunk(model, part), sum, CACHE_CHUNKS)

    def count(self, text: str | None) -> int:
        return sum(map(self.cache.__getitem__, self.model.chunks(text))) if text else 0


def count_tokens(docs: DataFrame, *, text_column: str = "text", count_column: str = "n_tokens", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All other columns of ``docs`` and long ``count_column``."""
    data = read_model(model_path)
    kept = [c for c in docs.columns if c not in (text_column, count_column)]
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_column}`").cast("string").alias("__text"))

    def run(batches):
        counter = shared(data, Counter, "counter")
        for part in _slices(batches, "__text"):
            counts = pa.array([counter.count(t) for t in part.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], names=[*part.schema.names[:-1], "__count"])

    schema = ", ".join([f"{n} {t}" for n, t in given.dtypes if n != "__text"] + ["__count long"])
    return given.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("__count").alias(count_column))
