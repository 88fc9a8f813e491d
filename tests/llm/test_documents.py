import base64
import hashlib
import json
import math
import re
import time
import zlib

import numpy as np
import pytest

from impulsar.llm import ngram_jaccard, secret_scan
from impulsar.llm.fingerprints import edited, fingerprint_documents
from impulsar.llm.license_scan import RULES, SENTENCES, scan_licenses
from impulsar.llm.mixing import mix, sainte_lague, taken_rows, targets
from impulsar.llm.ngram_jaccard import ngram_jaccard_components
from impulsar.llm.secret_scan import KINDS, github_checksum, scan_secrets
from impulsar.llm.substring_dedup import remove_repeated_passages
from impulsar.llm.toxicity import Model, TermMatcher, fit, fold, plain, score_toxicity, train

from .tables import Union, documents, empty, frame

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    found = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()


@pytest.mark.parametrize(("block_rows", "many"), [(512, 512), (3, 2)])
def test_jaccard_components(spark, block_rows, many):
    rows = documents()
    # Rows of one id: equal, linked, and unlike.
    first = rows[0][1].split()
    rows += [(300, " ".join(first), None), (300, " ".join([*first, "more"]), None), (300, "nothing like the others at all", None), (301, "nothing like the others at all", None)]
    union = Union()
    named = [(d, shingles(t)) for d, t, _ in rows if d is not None]
    for i, (a, x) in enumerate(named):
        union.find(a)
        for b, y in named[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                union.join(a, b)
    found = ngram_jaccard_components(frame(spark, rows), block_rows=block_rows, many=many, hot=4, chunk_shingles=600, count_links=True).collect()
    assert len(found) == len(rows)
    links = lambda x: sum(bool(x and y) and 100 * len(x & y) >= 75 * len(x | y) for _, y in named) - bool(x)
    expected = [(d, len(shingles(t)), None if d is None else union.find(d), None if d is None else links(shingles(t))) for d, t, _ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert any(r["component_id"] not in (None, r["doc_id"]) for r in found)


def test_jaccard_all_distinct_and_empty(spark):
    assert ngram_jaccard_components(empty(spark)).count() == 0
    rows = [(i, f"only {i} of these words here {i} now", None) for i in range(5)]
    assert {(r[0], r[2]) for r in ngram_jaccard_components(frame(spark, rows)).collect()} == {(i, i) for i in range(5)}


def test_spanning_chains_classes():
    sets = {i: [np.arange(a, a + 100, dtype=np.uint64)] for i, a in enumerate((0, 10, 20, 500))}
    pairs = [(a, b) for b in range(4) for a in range(b)]
    assert sorted(ngram_jaccard.spanning(sets, {i: i for i in range(4)}, pairs, 75)) == [(0, 1), (1, 2)]


@pytest.mark.parametrize(("block_rows", "many"), [(512, 512), (20, 10)])
def test_jaccard_templated_documents(spark, block_rows, many):
    """Sentences of a small pool: all documents hang together by shared columns, few are links."""
    rng = np.random.default_rng(11)
    pool = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(14)]
    rows = [(i, " ".join([pool[k] for k in rng.choice(14, 5, replace=False)] + [f"only{i}"] * int(rng.integers(0, 2))), None) for i in range(200)]
    for i in range(200, 260):  # near copies in chains
        words = rows[int(rng.integers(0, i))][1].split()
        words[int(rng.integers(0, len(words)))] = f"x{i}"
        rows.append((i, " ".join(words), None))
    union, links = Union(), [0] * len(rows)
    sets = [shingles(t) for _, t, _ in rows]
    for i, x in enumerate(sets):
        union.find(i)
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 75 * len(x | y):
                union.join(i, j)
                links[i], links[j] = links[i] + 1, links[j] + 1
    found = ngram_jaccard_components(frame(spark, rows), block_rows=block_rows, many=many, hot=8, count_links=True).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in found} == {i: (union.find(i), links[i]) for i in range(260)}


@pytest.mark.parametrize(("rows", "vocabulary"), [(70, 40), (30, 4000), (1, 5)])
def test_overlaps_are_a_product(monkeypatch, rows, vocabulary):
    monkeypatch.setattr(ngram_jaccard, "DENSE_COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, rng.integers(1, vocabulary), 60)).astype(np.uint64) for _ in range(rows + 9)]
    found = ngram_jaccard.overlaps(sets[:rows], sets[rows:])
    assert found.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[rows:]] for x in sets[:rows]]


def test_bounded_pairs_drop_what_cannot_reach():
    prefixes = [np.arange(a, a + 25) for a in (0, 0, 13, 24)]
    u, v = ngram_jaccard.bounded_pairs(prefixes, np.full(4, 96), np.array([0, 1, 2, 3]), np.arange(1), np.arange(1, 4), 75)
    assert list(zip(u, v, strict=True)) == [(0, 1), (0, 2)]  # sharing one column of the bound is too few



def test_substrings(spark):
    rows = documents()
    window = 50
    texts = [(d, (t or "").encode().split()) for d, t, _ in rows]
    low = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                low[k] = min(low.get(k, d), d)
    expected = []
    for d, w in texts:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        expected.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    found = [tuple(r) for r in remove_repeated_passages(frame(spark, rows), chunk_words=500).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(r[2] for r in found) > 300
    assert remove_repeated_passages(empty(spark)).count() == 0


def test_fingerprints(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] != 5]
    rows.sort()
    found = {r["doc_id"]: r for r in fingerprint_documents(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    by_text = {}
    for (d, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, text, after = found[d], text or "", after or ""
        new = edited(text, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        a = shingles(text)
        for column, other in (("near_edited", new), ("near_next", after)):
            b = shingles(other)
            truth = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[column] - truth) < 0.16, (d, column)
        assert by_text.setdefault(text.lower().strip(), r["fingerprint"]) == r["fingerprint"]
    assert fingerprint_documents(empty(spark)).count() == 0
    one = fingerprint_documents(frame(spark, [(1, "a b c d e f g h", None)])).first()
    assert one["near_next"] == 1.0
    assert fingerprint_documents(frame(spark, documents())).count() == len(documents())


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(spark):
    import random

    rng = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "paſſword", ":", "=", " = ", '"', "'", " ", "é", "AKIA", "AKIA0123456789ABCD", "0123456789abcdef" * 2, "deadbeef", "x" * 9, "abcd1234", "\n", "akia", "passwd=", "日本", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "f" * 31, "f" * 32, "é" + "0" * 500]
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{github_checksum(body)}"
    head = base64.urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=")
    texts += [f"see {good} here", f"see ghp_{body}000000 here", f"{head}.e30.sig", "eyJxx.e30.sig"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in r["spans"]] for r in scan_secrets(frame(spark, rows), keep=["doc_id", "score"]).collect()}
    for i, t, _ in rows:
        assert [s for s in found[i] if s[1] < 3] == brute_spans(t or ""), t
    extra = [[KINDS[k] for _, k, _ in found[len(texts) - j]] for j in (4, 3, 2, 1)]
    assert extra == [["github"], [], ["jwt"], []]
    masked = scan_secrets(frame(spark, [(1, "my token = abcdefgh1 ok", None), (2, None, None)]), redact="[S]").select("doc_id", "text").collect()
    assert {tuple(r) for r in masked} == {(1, "my [S] ok"), (2, None)}
    assert scan_secrets(empty(spark)).count() == 0


def test_private_keys_with_headers_and_escapes():
    body = "MIIEpAIBAAKCAQEA+/x\nabcd0123==\n"
    key = lambda kind, head="", text=body: f"-----BEGIN {kind}-----\n{head}{text}-----END {kind}-----"
    plain_key = key("PRIVATE KEY")
    wrapped = key("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123ABCD\n\n")
    keys = [plain_key, key("EC PRIVATE KEY"), wrapped, wrapped.replace("\n", "\r\n"), wrapped.replace("\n", "\\n"), wrapped.replace("\n", "\\\\n"), wrapped.replace("\n", "\n  "), plain_key.replace("\n", '\\n" +\n    "')]
    keys += [key("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2.0.22 (GNU/Linux)\nComment: https://example.org\n\n", "lQOYBF+/x\n=aB3d\n"), key("RSA PRIVATE KEY", "DEK-Info: AES-256-CBC,\n 0123ABCD\n\n")]
    automaton = secret_scan._automaton()
    for text in keys:
        assert secret_scan.keyword_spans(f"x {text} y", automaton) == [(2, KINDS.index("pem"), 2 + len(text))], text
    other = ["-----BEGIN PRIVATE KEY----- and then, in time, -----END PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----\nabcd\n-----END PUBLIC KEY-----", "-----BEGIN RSA PRIVATE KEY-----" + "\nA: b" * 20_000]
    assert all(secret_scan.keyword_spans(text, automaton) == [] for text in other)


def test_hex_runs_at_row_edges():
    import pyarrow as pa

    from impulsar.llm.words import text_bytes

    texts = ["a" * 32, "b" * 40, "g" + "c" * 31, "d" * 31 + "g" + "e" * 33]
    assert secret_scan.hex_spans(*text_bytes(pa.array(texts))) == [(0, 0, 32), (1, 0, 40), (3, 32, 65)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_is_levenshtein():
    import random

    from impulsar.llm.toxicity import allowed

    rng = random.Random(1)
    terms = ["idiot", "moron", "worthless", "disgusting", "scum"]
    matcher = TermMatcher(dict.fromkeys(terms, False) | {"lowei": True})
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "s", "o"])
        word = "".join(word)
        best = min(((levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= allowed(t)), default=None)
        found = matcher.match(word)
        assert (found and (found[1], found[0])) == best, word
    assert matcher.match("loweischaft") == ("lowei", 0, True) and matcher.match("lowe") is None


def test_toxicity_scores(spark):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["the", "house", "river", "stone", "walks"], 30)) for _ in range(160)]
    toxic = [t.replace("river", "idiot", 2) for t in clean[:40]]
    texts = toxic + clean[40:]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(900, None, None), (901, "", None), (None, "idiot", None)])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(160)] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    right = [(scored[i] >= 0.5) == (i < 40) for i in range(160) if "idiot" in texts[i] or i >= 40]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in scored.values()) and scored[900] == scored[901] < 0.5
    held = {r[0]: r[1] for r in docs.where("doc_id < 160").select("doc_id", fold(docs["doc_id"])).collect()}
    assert all(held[i] == zlib.crc32(str(i).encode()) % 5 for i in held)
    assert score_toxicity(empty(spark), model).count() == 0
    assert isinstance(train(docs, labels.where("doc_id < 0")), Model)


def test_quotation_is_no_abuse():
    import pyarrow as pa

    model = fit([])
    direct, quoted, odd = model.score(pa.array(["you are an idiot and a moron", 'the word "idiot" is old and he said "moron" then', "you 1d1ot and mor0n"]))
    assert direct > quoted and odd > quoted
    assert plain("“ID1OT!!”") == "idiot"


def test_licenses(spark):
    mit = "\n".join([SENTENCES["mit-grant"], SENTENCES["mit-notice"], SENTENCES["as-is"]])
    rows = [(1, f"Some code.\n{mit}\nend", None), (2, "\n".join(reversed(mit.split("\n"))), None), (3, "LICENSED under  CC BY-NC 4.0", None), (4, None, None), (5, "", None), (6, "Released under the MIT License. All rights reserved. Released under the MIT License.", None), (6, "x", None)]
    found = sorted((r["doc_id"], r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in scan_licenses(frame(spark, rows)).collect())
    assert found[0][0::1][2:] == (["mit-grant", "mit-notice", "as-is"], ["MIT"])
    assert found[1][3] == [] and found[2][3] == ["CC-BY-NC-4.0"] and found[3][1:] == (0, [], []) and found[4][1:] == (0, [], [])
    assert (6, 3, ["mit-ref", "all-rights", "mit-ref"], ["MIT-reference", "All-rights-reserved"]) in found
    assert scan_licenses(empty(spark)).count() == 0


MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2020, Some Body
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Copyright 2020 Some Body
Licensed under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", "dnl ", "REM "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licenses(spark, leader, end):
    led = lambda t: end.join((leader + line).rstrip() for line in t.split("\n"))
    rows = [(i, led(t), None) for i, t in enumerate([MIT, BSD, APACHE, "Released under the MIT\nLicense", "Released under the\n\nMIT License", "x Released under the\nMIT License", "Released under the\nMIT License x"])]
    found = [r["licenses"] for r in scan_licenses(frame(spark, rows)).orderBy("doc_id").collect()]
    assert found == [["MIT"], ["BSD-3-Clause"], ["Apache-2.0"], ["MIT-reference"], [], [], []]


def test_every_license_rule_fires(spark):
    import textwrap

    texts = ["\n".join(SENTENCES[i] for i in ids) for _, ids in RULES]
    wrapped = ["\n".join("# " + line for line in textwrap.wrap(t, 78)) for t in texts]
    found = {r["doc_id"]: r["licenses"] for r in scan_licenses(frame(spark, [(i, t, None) for i, t in enumerate(texts + wrapped)])).collect()}
    for i, (name, _) in enumerate(RULES + RULES):
        assert name in found[i], name
    assert found[[n for n, _ in RULES].index("BSD-3-Clause")] == ["BSD-3-Clause"]  # and not its part BSD-2-Clause
    odd = [(None, SENTENCES["mit-ref"], None), (7, SENTENCES["mit-ref"], None), (7, SENTENCES["mit-ref"], None), (8, "x y. " * 100_000 + SENTENCES["isc-ref"], None)]
    assert sorted((r["doc_id"] or 0, r["licenses"]) for r in scan_licenses(frame(spark, odd)).collect()) == [(0, ["MIT-reference"]), (7, ["MIT-reference"]), (7, ["MIT-reference"]), (8, ["ISC-reference"])]
    one = scan_licenses(frame(spark, [(1, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", None)])).first()
    assert (one["sentence_ids"], one["licenses"]) == (["mpl2"], ["MPL-2.0"])


def brute_targets(sizes, weights, most):
    capped = set()
    while True:
        rest = sum(sizes) - sum(most * sizes[i] for i in capped)
        unit = rest / sum(weights[i] for i in range(len(sizes)) if i not in capped) if len(capped) < len(sizes) else 0
        over = {i for i in range(len(sizes)) if i not in capped and unit * weights[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else unit * weights[i] for i in range(len(sizes))]
        capped |= over


def test_apportionment():
    import random

    rng = random.Random(2)
    for _ in range(300):
        votes = [rng.choice([0, rng.random() * 100, rng.randrange(50)]) for _ in range(rng.randrange(1, 8))]
        seats = rng.randrange(0, 60)
        caps = [rng.randrange(0, 30) for _ in votes]
        given = [0] * len(votes)
        for _ in range(seats):
            open_ = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, given, caps, strict=True)) if g < c and v > 0]
            if not open_:
                break
            given[min(open_)[1]] += 1
        assert sainte_lague(votes, seats, caps) == given
        sizes = [rng.randrange(1, 1000) for _ in votes]
        weights = [1 + i % 3 for i in range(len(votes))]
        assert targets(sizes, weights, 3) == pytest.approx(brute_targets(sizes, weights, 3))


def test_mixing(spark):
    rows = documents()
    found = mix(frame(spark, rows), shard_words=500).collect()
    again = mix(frame(spark, rows[::-1]), shard_words=500).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    held, target, taken = {}, {}, {}
    for r in found:
        s = r["source"]
        held[s] = held.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(held, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(brute_targets([held[s] for s in order], [1 + i % 3 for i in range(len(order))], 3))
    assert all(r["source_size"] == held[r["source"]] for r in found)
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)
    assert sorted(r["size"] for r in found) == sorted(len(SPLIT.findall(t or "")) for _, t, _ in rows)
    assert mix(empty(spark)).count() == 0
    assert mix(frame(spark, [(1, None, "a"), (2, "", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_small_source_in_a_large_corpus(spark):
    rows = [(i, "a " * 200_000, "large") for i in range(24)] + [(100, "one two three four five", "small"), (101, "one", "tiny")]
    found = mix(frame(spark, rows)).groupBy("source").agg({"target": "min", "taken": "sum"}).collect()
    assert {r["source"]: r["sum(taken)"] for r in found if r["source"] != "large"} == {"small": 15, "tiny": 3}
    assert all(abs(r["sum(taken)"] - r["min(target)"]) <= 1 for r in found)


def test_taken_rows(spark):
    rows = documents()
    mixed = mix(frame(spark, rows), shard_words=500, carry=True)
    out = taken_rows(mixed)
    assert out.columns == frame(spark, rows).columns
    words = sum(len(SPLIT.findall(r["text"] or "")) for r in out.collect())
    assert words == mixed.agg({"taken": "sum"}).first()[0] and math.isfinite(words)


def test_secret_hits_are_linear(spark):
    text = "eyJ" * 200_000 + " " + "-----BEGIN PRIVATE KEY-----\n" * 5_000 + "password " * 20_000
    began = time.perf_counter()
    assert secret_scan.keyword_spans(text, secret_scan._automaton()) == []
    assert time.perf_counter() - began < 20
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    token = f"{head}.{head}.sig"
    assert [(s, e) for s, _, e in secret_scan.keyword_spans(f"eyJeyJx {token}", secret_scan._automaton())] == [(8, 8 + len(token))]


def test_toxicity_training_matches_memory(spark):
    rng = np.random.default_rng(3)
    words = ["plain", "house", "river", "stone", "grubnik", "walks", "zorkwit", "under"]
    rows = [(i, " ".join(rng.choice(words[:4] + words[5:6] + (words[4:5] + words[6:7] if i % 3 == 0 else []), 40)), None) for i in range(150)]
    rows[7] = (7, " ".join(["river stone"] * 60_000) + " grubnik", None)
    repeated = [rows[3], rows[4], (None, "grubnik zorkwit", None)]
    docs, labels = frame(spark, rows + repeated), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    found = train(docs, labels)
    expected = fit([(t, int(i % 3 == 0)) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5])
    assert found.terms == expected.terms and "grubnik" in found.terms
    assert found.odds == pytest.approx(expected.odds)
    np.testing.assert_allclose(found.coefficients, expected.coefficients, rtol=1e-8)
    texts = [t for _, t, _ in rows]
    import pyarrow as pa

    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, found).where("doc_id is not null").collect()}
    np.testing.assert_allclose([scores[i] for i in range(150)], expected.score(pa.array(texts)), rtol=1e-6)
