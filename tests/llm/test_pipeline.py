import re
from pathlib import Path

import pytest

import corpus_pipeline
from impulsar.llm.ngram_jaccard import ngram_jaccard_components
from impulsar.llm.toxicity import train

from .tables import documents, empty, frame

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    docs = frame(spark, [*documents(), (400, 'password = "hunter2hunter2" ok', "src0"), (401, "you idiot moron stupid idiot moron scum trash clown loser pathetic worthless", "src1")])
    columns, ids = docs.columns, lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "secrets", "mixing", "sentencepiece"]

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == columns and set(ids(docs)) - set(ids(kept)) == {401}

    single = stages["ngram_jaccard"](spark, kept, SF)
    found = ngram_jaccard_components(kept).collect()
    assert set(ids(single)) == {r["component_id"] for r in found} and single.columns == columns
    assert sum(i is None for i in ids(single)) == 2

    masked = stages["secrets"](spark, single, SF)
    row = masked.where("doc_id = 400").first()
    assert "hunter2" not in row["text"] and corpus_pipeline.MASK in row["text"] and row["n_chars"] == len(row["text"]) and masked.columns == columns

    mixed = stages["mixing"](spark, masked, SF)
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
    assert mixed.columns == columns and abs(words(mixed) - words(masked)) <= 20

    last = stages["sentencepiece"](spark, mixed, SF)
    assert last.count() == mixed.count() and all(r["n_ids"] == len(r["ids"]) for r in last.collect())


def test_unrelated_texts_of_one_id_stay(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(40))
    rows = [(1, text("a"), None), (5, text("b"), None), (5, text("c"), None), (5, text("b"), None), (5, text("a"), None), (7, text("c"), None), (None, text("b"), None), (5, None, None), (8, text("d"), None)]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r["doc_id"], (r["text"] or "-")[0]) for r in kept.collect()), key=repr) == [(1, "a"), (5, "-"), (5, "b"), (5, "c"), (8, "d"), (None, "b")]


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (2, "", "a"), (None, None, None), (None, "p q", None), (None, "p q", None), (3, "  ", "a"), (4, "w x", "b"), (4, "w x", "b")]
    docs, stages = frame(spark, rows), dict(corpus_pipeline.STAGES)
    found = {name: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, SF).collect()), key=repr) for name in ("toxicity", "ngram_jaccard", "secrets", "mixing")}
    every = sorted(((d, t) for d, t, _ in rows), key=repr)
    assert found["toxicity"] == found["secrets"] == every
    # One row stays of equal ones that share an id, every row without one.
    assert found["ngram_jaccard"] == sorted([*{x for x in every if x[0] is not None}, *[x for x in every if x[0] is None]], key=repr)
    assert {d for d, _ in found["mixing"]} == {4, None} and all(t.split() for _, t in found["mixing"])
    ids = sorted(((r["doc_id"], r["n_ids"]) for r in stages["sentencepiece"](spark, docs, SF).collect()), key=repr)
    assert len(ids) == len(rows) and ids.count((1, 0)) == ids.count((2, 0)) == 2 and ids.count((None, 0)) == 1


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    model = train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.terms
