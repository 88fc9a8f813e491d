"""Operator 3: substring dedup with repeated-phrase automata.

1. *Recurring phrases.*  Of every window of ``window`` words, the phrase of
   ``phrase`` words with the lowest hash stands for it, so equal windows have
   equal phrases.  Phrases go to hash blocks, at most two documents for each
   phrase and document block; a block confirms those of two documents or more.
2. *Sharded automata.*  A document block (a hash of the id) gets the confirmed
   phrases of its own documents, compiles them into an Aho-Corasick automaton
   over word numbers, and streams its whole documents through it.  A word is
   two letters there, since a state's children are searched one by one.  A window
   whose lowest phrase was located may recur; every other window cannot.
3. *Passages.*  Windows left are hashed whole; hash blocks find the smallest
   document of each, from one row per window and document block.  Words that an
   earlier document's window covers are removed.

Words and phrases are compared by 64-bit hashes, windows by two independent
ones: among the windows of a large corpus 64 bits alone would equate some.

Defined cases: a null or wordless text has no words and stays the empty text;
a text shorter than a window loses nothing; rows with the same id are no
smaller than each other, so repeated rows lose nothing to one another; a row
with a null id neither loses words nor takes any; other columns of the input
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.llm.common import partitions
from impulsar.llm.ngram_jaccard import _planes, _unplanes
from impulsar.llm.words import Words, mix64, powers

WINDOW, PHRASE = 50, 5
CHUNK_WORDS, BATCH_BYTES = 4_000_000, 1 << 21
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` 32-bit word numbers, its lowest bit clear."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    scale = powers(_RADIX, size)
    for k in range(size):
        out += words[k : k + n].astype(np.uint64) * scale[k]
    return mix64(out) & ~np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


@functools.lru_cache(maxsize=64)
def _kept_powers(radix: int, size: int) -> np.ndarray:
    return powers(np.uint64(radix), size)


def _powers(radix: int, n: int) -> np.ndarray:
    """``powers``, those of short texts kept."""
    return _kept_powers(radix, 1 << n.bit_length())[:n] if n < 1 << 16 else powers(np.uint64(radix), n)


def _window_hash(hashes: np.ndarray, width: int, at: np.ndarray, radix: np.uint64) -> np.ndarray:
    """Hash of the runs of ``width`` word hashes that start ``at``, from prefix sums."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers(int(radix), len(hashes)), dtype=np.uint64)))
    return mix64((sums[at + width] - sums[at]) * _powers(pow(int(radix), -1, 1 << 64), len(hashes))[at])


def window_hashes(hashes: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the runs of ``width`` word hashes that start ``at``."""
    return _window_hash(hashes, width, at, _RADIX), _window_hash(mix64(hashes ^ _SECOND), width, at, _SECOND)


class Automaton:
    """Aho-Corasick automaton of phrases of word numbers (one a row).

    A word is two letters of disjoint alphabets of about the square root of the
    phrases' vocabulary, so that no state has more children than that; a word of
    no phrase is a letter that no phrase has.
    """

    def __init__(self, phrases: np.ndarray):
        self.vocabulary = np.unique(phrases)
        self.base = math.isqrt(len(self.vocabulary)) + 1
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text, length = self.spell(phrases.ravel()), 2 * phrases.shape[1]
        for start in range(0, len(text), length):
            self.found.add_word(text[start : start + length], 1)
        self.found.make_automaton()

    def spell(self, numbers: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.vocabulary, numbers), len(self.vocabulary) - 1)
        letters = np.column_stack([1 + at // self.base, 1 + self.base + at % self.base])
        letters[self.vocabulary[at] != numbers] = 0
        letters += (letters >= 0xD800) * 0x800  # no surrogates
        return letters.astype("<u4").tobytes().decode("utf-32-le")

    def ends(self, numbers: np.ndarray) -> np.ndarray:
        """Last words of the phrases in a text."""
        return np.fromiter((end for end, _ in self.found.iter(self.spell(numbers))), dtype=np.int64) // 2


def by_window(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal windows together, by ``first``; whether a place of it starts a new window)."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # windows that differ in the second hash only
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    return order, np.concatenate((np.ones(min(len(a), 1), dtype=bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def _documents(batches, names: tuple[str, ...]):
    """(values of ``names``, 64-bit word hashes) of each document, a bounded slice of text at a time."""
    for batch in batches:
        texts = batch.column("text")
        step = max(1, int(len(texts) * BATCH_BYTES / max(texts.nbytes, 1)))
        for low in range(0, len(texts), step):
            words = Words(texts.slice(low, step), lower=False)
            values = [batch.column(name).slice(low, step).to_pylist() for name in names]
            for row in range(words.rows):
                yield *(v[row] for v in values), words.row_hashes(row)


_POSTED = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("docs", pa.binary()), ("shards", pa.binary())])


def _post_phrases(window: int, phrase: int, bits: int, chunk_words: int):
    def flush(doc_ids, shards, rows):
        words, docs = np.concatenate(rows), np.repeat(doc_ids, [len(r) for r in rows])
        of = np.repeat(shards, [len(r) for r in rows])
        key = words[:, 0].astype(np.uint64)
        for k in range(1, phrase):
            key = key * _RADIX + words[:, k]
        key = mix64(key)
        order = np.lexsort((docs, of, key))
        key, words, docs, of = key[order], words[order], docs[order], of[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        keep = new | np.append(new[1:], True)  # first and last document of each phrase and shard
        key, words, docs, of = key[keep], words[keep], docs[keep], of[keep]
        edges = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        out, size = [], 0
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            out.append({"block": int(b), "words": words[part].astype("<u4").tobytes(), "docs": _planes(docs[part].astype(np.int64), 8), "shards": _planes(of[part], 4)})
            size += len(out[-1]["words"])
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, _POSTED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _POSTED)

    def run(batches):
        doc_ids, shards, rows, held = [], [], [], 0
        for doc, shard, hashes in _documents(batches, ("doc_id", "shard")):
            held += len(hashes)
            if doc is None or len(hashes) < window:
                continue
            numbers = hashes.astype(np.uint32)
            every = phrase_hashes(numbers, phrase)
            lowest = np.unique(sliding_min(every, window - phrase + 1))
            at = np.flatnonzero(np.isin(every, lowest))
            at = at[np.unique(every[at], return_index=True)[1]]
            doc_ids.append(doc)
            shards.append(shard)
            rows.append(np.lib.stride_tricks.sliding_window_view(numbers, phrase)[at])
            if held >= chunk_words:
                yield from flush(doc_ids, shards, rows)
                doc_ids, shards, rows, held = [], [], [], 0
        if doc_ids:
            yield from flush(doc_ids, shards, rows)

    return run


_PHRASES = pa.schema([("shard", pa.int64()), ("words", pa.binary())])


def _confirm(phrase: int):
    """Phrases of at least two documents, for each document block that has them."""

    def run(key, table):
        words = np.concatenate([np.frombuffer(w, dtype="<u4").reshape(-1, phrase) for w in table["words"].to_pylist()])
        docs = np.concatenate([_unplanes(d, 8).view(np.int64) for d in table["docs"].to_pylist()])
        of = np.concatenate([_unplanes(d, 4).astype(np.int64) for d in table["shards"].to_pylist()])
        order = np.lexsort((*words.T,))
        words, docs, of = words[order], docs[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
        runs = np.diff(np.append(first, len(words)))
        recurs = np.repeat(np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first), runs)
        words, of, phrase_no = words[recurs], of[recurs], np.repeat(np.arange(len(first)), runs)[recurs]
        order = np.lexsort((phrase_no, of))
        words, of, phrase_no = words[order], of[order], phrase_no[order]
        if len(of):
            keep = np.concatenate(([True], (of[1:] != of[:-1]) | (phrase_no[1:] != phrase_no[:-1])))
            words, of = words[keep], of[keep]
        edges = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of)) if len(of) else []
        return pa.Table.from_pylist([{"shard": int(of[a]), "words": words[a:b].tobytes()} for a, b in zip(edges[:-1], edges[1:], strict=True)], _PHRASES)

    return run


_WINDOWS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("index", pa.binary()), ("state", pa.binary())])
_WINDOWS_SQL = "block long, shard long, keys binary, docs binary, index binary, state binary"


def _window_row(block, shard, keys=b"", docs=b"", index=b"", state=b""):
    return {"block": block, "shard": shard, "keys": keys, "docs": docs, "index": index, "state": state}


def _locate(window: int, phrase: int, bits: int):
    """Stream a block's documents through the automaton of its phrases; windows that may recur."""

    def run(key, docs_table, phrases_table):
        phrases = [np.frombuffer(w, dtype="<u4").reshape(-1, phrase) for w in phrases_table["words"].to_pylist()]
        if not phrases or not docs_table.num_rows:
            return _WINDOWS.empty_table()
        automaton = Automaton(np.concatenate(phrases))
        names, tags, counts, starts, keys, others = [], [], [], [], [], []
        for doc, tag, hashes in _documents(docs_table.to_batches(), ("doc_id", "tag")):
            if doc is None or len(hashes) < window:
                continue
            numbers = hashes.astype(np.uint32)
            ends = automaton.ends(numbers)
            if not len(ends):
                continue
            every = phrase_hashes(numbers, phrase)
            every[ends - phrase + 1] |= np.uint64(1)
            at = np.flatnonzero(sliding_min(every, window - phrase + 1) & np.uint64(1))
            if len(at):
                names.append(doc)
                tags.append(tag)
                counts.append(len(at))
                starts.append(at)
                key_of, other = window_hashes(hashes, window, at)
                keys.append(key_of)
                others.append(other)
        if not names:
            return _WINDOWS.empty_table()
        shard = key[0].as_py()
        keys, others, docs = np.concatenate(keys), np.concatenate(others), np.repeat(np.array(names, dtype=np.int64), counts)
        order, new = by_window(keys, others)
        inverse = np.empty(len(keys), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        unique, other = keys[order[new]], others[order[new]]
        head = np.array([len(names), len(keys), len(unique)], dtype="<i8").tobytes()
        per_doc = np.column_stack([names, tags, counts]).astype("<i8").tobytes()
        state = head + per_doc + _planes(np.concatenate(starts), 4) + _planes(inverse, 4) + low.astype("<i8").tobytes()
        rows = [_window_row(-1 - shard, shard, state=state)]
        edges = np.searchsorted(unique >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            rows.append(_window_row(int(b), shard, np.column_stack([unique[part], other[part]]).astype("<u8").tobytes(), _planes(low[part], 8), np.int64(edges[b]).tobytes()))
        return pa.Table.from_pylist(rows, _WINDOWS)

    return run


def _earliest(key, table):
    """The smallest document of each window, told to the document blocks that have a larger one."""
    if key[0].as_py() < 0:
        return table.select(_WINDOWS.names)
    shards, keys, docs, index = [], [], [], []
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["keys"], dtype="<u8").reshape(-1, 2))
        docs.append(_unplanes(row["docs"], 8).view(np.int64))
        index.append(np.frombuffer(row["index"], dtype=np.int64)[0] + np.arange(len(keys[-1])))
        shards.append(np.full(len(keys[-1]), row["shard"]))
    shards, keys, docs, index = map(np.concatenate, (shards, keys, docs, index))
    order, new = by_window(np.ascontiguousarray(keys[:, 0]), keys[:, 1])
    shards, docs, index = shards[order], docs[order], index[order]
    first = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(docs))))
    told = low < docs
    shards, low, index = shards[told], low[told], index[told]
    order = np.argsort(shards, kind="stable")
    shards, low, index = shards[order], low[order], index[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))), len(shards)) if len(shards) else []
    return pa.Table.from_pylist([_window_row(-1, int(shards[a]), docs=_planes(low[a:b], 8), index=_planes(index[a:b], 4)) for a, b in zip(edges[:-1], edges[1:], strict=True)], _WINDOWS)


_SPANS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("spans", pa.list_(pa.int64()))])


def _covered(window: int):
    """Word spans (start, end, start, end, ...) that an earlier document's windows cover."""

    def run(key, table):
        state, told = None, []
        for row in table.to_pylist():
            if row["state"]:
                state = row["state"]
            elif row["docs"]:
                told.append((_unplanes(row["index"], 4).astype(np.int64), _unplanes(row["docs"], 8).view(np.int64)))
        if state is None:
            return _SPANS.empty_table()
        n, m, u = np.frombuffer(state, dtype="<i8", count=3)
        per_doc = np.frombuffer(state, dtype="<i8", count=3 * n, offset=24).reshape(-1, 3)
        at = 24 + 24 * n
        starts = _unplanes(state[at : at + 4 * m], 4).astype(np.int64)
        inverse = _unplanes(state[at + 4 * m : at + 8 * m], 4).astype(np.int64)
        low = np.frombuffer(state, dtype="<i8", count=u, offset=at + 8 * m).copy()
        for index, docs in told:
            low[index] = docs
        removed = low[inverse] < np.repeat(per_doc[:, 0], per_doc[:, 2])
        out, edge = [], 0
        for doc, tag, count in per_doc.tolist():
            s = starts[edge : edge + count][removed[edge : edge + count]]
            edge += count
            if len(s):
                cuts = np.flatnonzero(np.diff(s) > window)
                spans = np.column_stack([s[np.concatenate(([0], cuts + 1))], s[np.append(cuts, len(s) - 1)] + window])
                out.append({"shard": key[0].as_py(), "doc_id": doc, "tag": tag, "spans": spans.ravel().tolist()})
        return pa.Table.from_pylist(out, _SPANS)

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(key, docs_table, spans_table):
    """A document block's texts without their covered words."""
    spans = {(r["doc_id"], r["tag"]): r["spans"] for r in spans_table.to_pylist()}
    out = []
    for batch in docs_table.to_batches(max_chunksize=1000):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), texts, strict=True):
            words = (text or b"").split()
            n, kept = len(words), words
            if found := spans.get((doc, tag)):
                kept, at = [], 0
                for start, end in zip(found[::2], found[1::2], strict=True):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
            out.append((doc, n, n - len(kept), b" ".join(kept).decode("utf-8", "replace")))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], _KEPT.field(i).type) for i in range(4)], schema=_KEPT)


def remove_repeated_passages(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, phrase: int = PHRASE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words joined by one space)."""
    spark = docs.sparkSession
    shards = partitions(spark)
    bits = max(4, (shards - 1).bit_length())
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    tag = F.xxhash64("text")
    # Both uses of the texts by block read one exchange.
    tagged = given.select("doc_id", "text", tag.alias("tag"), F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), tag)), F.lit(shards)).alias("shard"))
    posted = tagged.select("doc_id", "shard", "text").mapInArrow(_post_phrases(window, phrase, bits, chunk_words), "block long, words binary, docs binary, shards binary")
    phrases = posted.groupBy("block").applyInArrow(_confirm(phrase), "shard long, words binary")
    windows = tagged.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(_locate(window, phrase, bits), _WINDOWS_SQL)
    told = windows.groupBy("block").applyInArrow(_earliest, _WINDOWS_SQL)
    spans = told.groupBy("shard").applyInArrow(_covered(window), "shard long, doc_id long, tag long, spans array<long>")
    return tagged.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
