"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("component_id", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("shard", T.LongType()),
])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    """(doc_id, text, source) rows with exact and near copies, shared passages and edge cases."""
    rng = random.Random(7)
    rows = []
    base = words(rng, 120)
    passage = words(rng, 70)
    for i in range(40):
        text = list(base) if i < 12 else words(rng, rng.randrange(3, 200))
        if 3 <= i < 12:  # near copies, some too far
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(len(text))] = f"e{i}"
        if i % 5 == 0 and i >= 12:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage + text[at:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text), f"src{i % 4}"))
    rows += [(100, None, "src0"), (101, "", None), (102, " \t\n", "src1"), (103, "one", "src1"), (104, "ONE", None), (105, "é ü ß 日本 x", "src2"), (106, "a b c d", "src3"), (107, "a b c d", "src3")]
    rows += [(200, " ".join(words(rng, 6000)), "src2"), (None, "no id here at all today", "src1"), (5, rows[5][1], "src1"), (None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), 0.5, "c", "s", 9) for d, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    """Union-find for brute-force components."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
