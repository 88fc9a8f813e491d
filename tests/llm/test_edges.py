"""Awkward rows that the operators' own tests leave out, and queries against their SQL."""

import hashlib
import math
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from impulsar.llm import queries
from impulsar.llm.fingerprints import BINS, BITS, WIDTH, fingerprint_documents
from impulsar.llm.fingerprints import fingerprints as packed
from impulsar.llm.license_scan import scan_licenses
from impulsar.llm.mixing import mix
from impulsar.llm.secret_scan import scan_secrets
from impulsar.llm.substring_dedup import Automaton, by_window, window_hashes
from impulsar.llm.toxicity import fit, score_toxicity
from impulsar.llm.words import mix64

from .tables import documents, empty, frame

SF = "/root/testdata/sf0.001"


def test_windows_of_one_hash_stay_apart():
    rng = np.random.default_rng(2)
    first, second = rng.integers(0, 4, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
    order, new = by_window(first, second)
    pairs = list(zip(first[order].tolist(), second[order].tolist(), strict=True))
    assert sorted(order.tolist()) == list(range(500)) and (np.diff(first[order].astype(int)) >= 0).all()
    assert new.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(500)] and new.sum() == len(set(pairs))
    order, new = by_window(first[:0], second[:0])
    assert len(order) == len(new) == 0


def test_window_hashes_are_of_the_words_alone():
    words = mix64(np.arange(40, dtype=np.uint64))
    hashes = np.concatenate([words, words[:7], words])
    a, b = window_hashes(hashes, 30, np.array([0, 47, 5, 52]))
    assert a[0] == a[1] != a[2] == a[3] and b[0] == b[1] != b[2] == b[3] and a[0] != b[0]


@pytest.mark.parametrize("vocabulary", [1, 3, 60])
def test_automaton_finds_every_phrase(vocabulary):
    rng = np.random.default_rng(vocabulary)
    words = rng.choice(2**32 - 1, vocabulary, replace=False).astype(np.uint32)
    phrases = np.unique(rng.choice(words, (40, 3)), axis=0)
    text = np.concatenate([rng.choice(words, 300), rng.integers(0, 2**32, 20).astype(np.uint32), phrases[0], [0, 2**32 - 1]]).astype(np.uint32)
    known = {tuple(x) for x in phrases.tolist()}
    expected = [i for i in range(2, len(text)) if tuple(text[i - 2 : i + 1].tolist()) in known]
    assert Automaton(phrases).ends(text).tolist() == expected


def brute_bins(text):
    """Bins of one text, one shingle at a time; the bins' order for empty ones is the operator's rule."""
    import pyarrow as pa

    from impulsar.llm.fingerprints import _ORDER
    from impulsar.llm.words import Words, shingle_set

    bins = {}
    for h in shingle_set(Words(pa.array([text]), lower=True).row_hashes(0), WIDTH).tolist():
        at, value = h >> (64 - int(math.log2(BINS))), int(mix64(np.uint64([h]))[0])
        bins[at] = min(value, bins.get(at, value))
    return [bins[i] if i in bins else bins[min(bins, key=lambda j: _ORDER[i, j])] for i in range(BINS)] if bins else None


def test_fingerprints_are_bins():
    import pyarrow as pa

    texts = [t or "" for _, t, _ in documents()]
    rows, full = packed(pa.array(texts))
    for text, row, some in zip(texts, rows, full, strict=True):
        bins = brute_bins(text)
        assert some == (bins is not None)
        if some:
            assert row.tolist() == [v & ((1 << BITS) - 1) for v in bins]


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "n o p q r s", None), (3, "b b b b b b", None), (3, "a a a a a a", None), (3, "a a a a a a", None), (9, None, None)]
    found = fingerprint_documents(frame(spark, rows)).collect()
    # Null ids first, then by id and text; the last one's successor is the first.
    order = [(None, "n o p q r s"), (3, "a a a a a a"), (3, "a a a a a a"), (3, "b b b b b b"), (9, "")]
    expected = []
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 4
        expected.append((d, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert [r["near_next"] for r in found if r["doc_id"] == 9] == [0.0]


def test_toxicity_of_long_and_repeated_rows(spark):
    long = "the river walks " * 100_000
    rows = [(1, "you idiot moron", None), (1, "you idiot moron", None), (None, "you idiot moron", None), (2, long, None), (3, long + "you idiot", None), (4, "\u0000 \U0001f600", None), (5, None, None)]
    found = score_toxicity(frame(spark, rows), fit([])).collect()
    scores = {i: {r["score"] for r in found if r["doc_id"] == i} for i in (None, 1, 2, 3, 4, 5)}
    assert len(found) == len(rows) and scores[1] == scores[None] and len(scores[1]) == 1
    assert all(0 <= s <= 1 for v in scores.values() for s in v) and scores[2] != scores[3]
    assert scores[5] == scores[4]


def test_secrets_in_long_texts(spark):
    text = "x " * 200_000 + 'token="abcdefgh12"' + " token " * 50_000 + "AKIA" + "0" * 100_000 + " " + "f" * 100_000
    found = {r["doc_id"]: r["spans"] for r in scan_secrets(frame(spark, [(1, text, None), (None, text, None), (1, text, None)]), keep=["doc_id"]).collect()}
    assert {len([s for s in spans if s["kind"] in ("assign", "access", "hex")]) for spans in found.values()} == {4}


def test_licenses_of_odd_rows(spark):
    rows = [(None, "Released under the MIT License.", None), (2, "y " * 200_000 + "\nReleased under the MIT License.", None), (2, "Released under the MIT License.", None), (2, "Released under the MIT License.", None)]
    found = scan_licenses(frame(spark, rows)).collect()
    assert len(found) == 4 and all(r["licenses"] == ["MIT-reference"] for r in found)


def test_mixing_with_one_hot_id(spark):
    rows = [(7, "a b c", "hot")] * 300 + [(i, "d e", "cold") for i in range(100)] + [(None, "f", None), (500, None, "cold")]
    found = mix(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in found)
    for source, size in (("hot", 900), ("cold", 200), (None, 1)):
        part = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in part} == {size}
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 3


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op2_embedding_dedup", "op3_substring_dedup", "op7_license_scan"])
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    canonical = lambda f: sorted(tuple(str(v) for v in row) for row in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(con.execute(queries.ORACLE_SQL[name]).df())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        source = spark.read.parquet(f"{SF}/{name}.parquet") if Path(SF).exists() else empty(spark)
        source.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
