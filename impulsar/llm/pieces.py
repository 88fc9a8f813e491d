"""SentencePiece model files: pieces, their matches in a text, and path rules.

A model file is read on the driver and shipped as bytes (its size is checked).
Both path rules work on the same lattice of vocabulary matches, which an
Aho-Corasick automaton enumerates by their end:

* Unigram models keep the best-scoring path to each position.  Scores are
  32-bit floats; a path replaces an equal one never, and longer last pieces are
  met first, as the tokenizer does.
* BPE models keep the one path to each position that merging would leave.  The
  merged form of a prefix is a prefix path of the merged text, and a sequence is
  merged form exactly if each neighbouring pair is, so each position has one
  last piece: the match whose pair with its predecessor's last piece survives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cached_property

import ahocorasick
import numpy as np

from impulsar.llm.words import KEPT

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
_NONE = -1
MAX_PAIRS = 300_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    return data


class PieceModel:
    """A parsed model; ``chunks`` and ``path`` are what the operators use."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalization is supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_fallback = bool(trainer.get(35, 0)) and len(self.byte_ids) == 256
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        if any(t == USER_DEFINED or t == UNUSED for t in self.types):
            raise ValueError("user-defined and unused pieces are not supported")
        self.longest = max(map(len, self.ids))
        self.scores32 = [np.float32(x) for x in self.scores]
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        if not self.letters.issuperset("".join(self.ids)):
            raise ValueError("every letter of a piece must be a piece")
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Where no piece runs from a letter into a space, every path has a boundary there.
        #: Letters outside the vocabulary are runs of their own.
        inside = "".join(map(re.escape, sorted(self.letters - {SPACE})))
        self._chunk = re.compile(f"[{inside}{SPACE}]+|[^{inside}{SPACE}]+" if crossing else f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]+")
        #: Letters next to each other in some piece; elsewhere every path has a boundary too.
        self.touching = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._pairs: dict[int, bool] = {}
        self._trees: dict[str, tuple | None] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.kind == UNIGRAM or self.tree(piece) is not None:  # no other piece is ever left by merging
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        return automaton

    def normalize(self, text: str) -> str:
        return ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def chunks(self, text: str) -> list[str]:
        """Stretches of the normalized text whose ends no vocabulary piece crosses."""
        return self._chunk.findall(self.normalize(text))

    def split(self, chunk: str) -> list[str]:
        """A chunk with punctuation cut wherever two letters never meet in a piece."""
        if chunk.lstrip(SPACE).isalpha():
            return [chunk]
        ends = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.touching]
        return [chunk[a:b] for a, b in zip([0, *ends], [*ends, len(chunk)], strict=True)] if ends else [chunk]

    # BPE

    def merged(self, text: str) -> list[str]:
        """Merging from letters up: highest score first, then leftmost."""
        return [x[0] for x in self._merge(text)]

    def _merge(self, text: str) -> list[tuple]:
        row = [(c, None, None, float("inf")) for c in text]
        while len(row) > 1:
            best, at = None, -1
            for i in range(len(row) - 1):
                j = self.ids.get(row[i][0] + row[i + 1][0])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if best is None:
                break
            row[at : at + 2] = [(row[at][0] + row[at + 1][0], row[at], row[at + 1], best)]
        return row

    def tree(self, piece: str) -> tuple | None:
        """How merging makes ``piece`` (text, left, right, score), None if it doesn't."""
        if piece not in self._trees:
            row = self._merge(piece)
            self._trees[piece] = row[0] if len(row) == 1 else None
        return self._trees[piece]

    def survives(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces ``left`` and ``right`` apart."""
        key = left << 24 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._survives(self.pieces[left], self.pieces[right])
        return found

    def _survives(self, left: str, right: str) -> bool:
        if SPACE in left[1:] or SPACE in right[1:]:  # runs of spaces share one score
            return self.merged(left + right) == [left, right]
        a_tree, b_tree = self.tree(left), self.tree(right)
        if a_tree is None or b_tree is None:
            return False
        a, a_gone = a_tree, -float("inf")
        while a is not None:
            b, b_gone = b_tree, -float("inf")
            while b is not None:
                j = self.ids.get(a[0] + b[0])
                if j is not None:
                    met = min(self.scores[j], a[3], b[3])
                    if met > a_gone and met >= b_gone:
                        return False
                b, b_gone = b[1], b[3]
            a, a_gone = a[2], a[3]
        return True

    def fallback(self, text: str) -> list[int]:
        """Ids of letters outside the vocabulary."""
        return [self.byte_ids[b] for b in text.encode()] if self.byte_fallback else [self.unknown]


def encode_part(model: PieceModel, text: str) -> list[int]:
    """Ids of a run of letters of the vocabulary.

    Each position keeps its best path's last piece and where that begins.  Every
    few lengths of the longest piece, the paths to the positions still in reach
    are followed back until they meet; the ids before that boundary are
    committed, and the rest is all that is kept.
    """
    n, reach = len(text), model.longest
    every = 8 * reach
    base, ids = 0, []
    start, last = [0], [_NONE]
    score = [np.float32(0)]
    bpe, pairs, survives, pieces = model.kind == BPE, model._pairs, model.survives, model.automaton.iter(text)
    scores = model.scores32

    def commit(at: int, alive: list[int]) -> int:
        meet = set(alive)
        while len(meet) > 1:
            top = max(meet)
            meet.remove(top)
            meet.add(start[top - base])
        boundary = p = meet.pop()
        path = []
        while p > base:
            path.append(last[p - base])
            p = start[p - base]
        ids.extend(reversed(path))
        return boundary

    at = 0
    for end, (piece, size) in pieces:
        while at <= end:  # a position opens
            if at - base >= every and at < n:
                boundary = commit(at, [p for p in range(max(base, at - reach + 1), at + 1) if p == base or last[p - base] != _NONE])
                del start[: boundary - base], last[: boundary - base], score[: boundary - base]
                base = boundary
            at += 1
            start.append(0)
            last.append(_NONE)
            score.append(None)
        here, low = at - base, at - size
        if low < base:
            continue
        if bpe:
            if last[here] != _NONE:
                continue
            if low == 0:
                start[here], last[here] = 0, piece
                continue
            before = last[low - base]
            if before != _NONE:
                found = pairs.get(before << 24 | piece)
                if survives(before, piece) if found is None else found:
                    start[here], last[here] = low, piece
        else:
            before = score[low - base]
            if before is not None:
                total = before + scores[piece]
                if score[here] is None or total > score[here]:
                    start[here], last[here], score[here] = low, piece, total
    commit(n, [n])
    return ids


def encode_short(model: PieceModel, text: str) -> list[int]:
    """``encode_part`` for BPE models and texts too short to commit before their end."""
    n = len(text)
    start, last, known = [0] * (n + 1), [_NONE] * (n + 1), model._pairs.get
    for end, (piece, size) in model.automaton.iter(text):
        if last[end + 1] < 0:
            low = end + 1 - size
            if low:
                before = last[low]
                found = known(before << 24 | piece)
                if found is None:
                    found = model.survives(before, piece)
                if not found:
                    continue
                start[end + 1] = low
            last[end + 1] = piece
    ids = []
    while n:
        ids.append(last[n])
        n = start[n]
    ids.reverse()
    return ids


def encode_chunk(model: PieceModel, text: str) -> list[int]:
    """Ids of one chunk."""
    if text[0] not in model.letters:
        return model.fallback(text)
    if model.kind == BPE and len(text) < 8 * model.longest:
        return encode_short(model, text)
    return encode_part(model, text)


def count_part(model: PieceModel, text: str) -> int:
    """Number of ids of a run of letters of the vocabulary.

    Each position carries its best path's last piece, score and count in a ring
    as long as the longest piece, and nothing else is kept.
    """
    reach = model.longest + 1
    last, count, score = [_NONE] * reach, [0] * reach, [None] * reach
    score[0] = np.float32(0)
    bpe, pairs, survives, scores = model.kind == BPE, model._pairs, model.survives, model.scores32
    at = 0
    for end, (piece, size) in model.automaton.iter(text):
        while at <= end:
            at += 1
            last[at % reach], score[at % reach] = _NONE, None
        here, low = at % reach, at - size
        if bpe:
            if last[here] != _NONE:
                continue
            if low == 0:
                last[here], count[here] = piece, 1
                continue
            before = last[low % reach]
            if before != _NONE:
                found = pairs.get(before << 24 | piece)
                if survives(before, piece) if found is None else found:
                    last[here], count[here] = piece, count[low % reach] + 1
        else:
            before = score[low % reach]
            if before is not None:
                total = before + scores[piece]
                if score[here] is None or total > score[here]:
                    last[here], score[here], count[here] = piece, total, count[low % reach] + 1
    return count[len(text) % reach]


def count_short(model: PieceModel, text: str) -> int:
    """``count_part`` for BPE models, positions kept to the end of a short text."""
    n = len(text)
    last, count, known = [_NONE] * (n + 1), [0] * (n + 1), model._pairs.get
    for end, (piece, size) in model.automaton.iter(text):
        if last[end + 1] < 0:
            low = end + 1 - size
            if low:
                before = last[low]
                found = known(before << 24 | piece)
                if found is None:
                    found = model.survives(before, piece)
                if not found:
                    continue
            last[end + 1], count[end + 1] = piece, count[low] + 1
    return count[n]


def count_chunk(model: PieceModel, text: str) -> int:
    """Number of ids of one chunk."""
    if text[0] not in model.letters:
        return len(model.fallback(text))
    if model.kind == BPE and len(text) < 8 * model.longest:
        return count_short(model, text)
    return count_part(model, text)


class Chunks(dict):
    """Results by chunk, in two generations of at most ``most`` chunks each.

    A chunk not met before is split where pieces cannot cross; ``make`` gives a
    part's result and ``join`` puts those of the parts together.
    """

    def __init__(self, model: PieceModel, make, join, most: int):
        super().__init__()
        self.split, self.make, self.join, self.most, self.old = model.split, make, join, most, {}

    def __missing__(self, chunk: str):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(chunk)
        if value is None:
            parts = self.split(chunk)
            value = self.make(chunk) if len(parts) == 1 else self.join([self[p] for p in parts])
        self[chunk] = value
        return value


def shared(data: bytes, make, name: str):
    """One object for each model and worker process, kept from task to task until the worker does other work."""
    key = name, hashlib.blake2b(data, digest_size=16).digest()
    if key not in KEPT:
        KEPT[key] = make(PieceModel(data))
    return KEPT[key]
