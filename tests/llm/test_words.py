import re

import numpy as np
import pyarrow as pa

from impulsar.llm import words as w


def test_boundaries_and_hashes(monkeypatch):
    texts = ["", None, " a\tb\n", "x", "Ab aB\x0b日本 é", " " * 5, "end", "next word word"]
    found = w.Words(pa.array(texts), lower=True)
    raw = found.data.tobytes()
    seen = {}
    for row, text in enumerate(texts):
        mine = range(found.bounds[row], found.bounds[row + 1])
        decoded = [raw[found.starts[k] : found.ends[k]].decode() for k in mine]
        assert decoded == re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k, word in zip(mine, decoded, strict=True):
            folded = "".join(c.lower() if c.isascii() else c for c in word)
            assert seen.setdefault(folded, found.hashes[k]) == found.hashes[k]
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(w, "_STRETCH", 3)
    assert (w.Words(pa.array(texts), lower=True).hashes == found.hashes).all()


def test_shingles_keep_order_and_short_texts():
    h = w.Words(pa.array(["a b c d e f", "b a c d e f", "a b"]), lower=False)
    a, b, c = (w.shingle_set(h.row_hashes(i), 5) for i in range(3))
    assert len(a) == 2 and len(c) == 1 and len(np.intersect1d(a, b)) == 0
