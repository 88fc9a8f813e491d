"""Operator 5: secret scans.

An Aho-Corasick automaton over the keywords reads each whole text once (ASCII
letters folded).  Regular expressions are only tried anchored at its hits, in
order, skipping hits inside an earlier match of the same kind, which is what a
leftmost non-overlapping search over the whole text gives.  Hexadecimal runs
have no keyword: every 16th byte is probed, and a run of 32 or more must cover
two neighbouring probes.  Kinds that carry a checksum or a self-describing
header keep a match only if that validates.

Defined cases: a null or empty text has no spans; rows are independent, so
repeated rows, null ids and other columns change nothing; offsets are code
points, end exclusive; spans come by start, then kind in the order of KINDS.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impulsar.llm.words import release, text_bytes

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "jwt", "pem")
BATCH_BYTES = 1 << 23

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"eyJ([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_ESCAPE = r"\\++(?:[nrt/]|u000[aAdD]|\r?\n)"
_JOINT = r"""["'][\x20\t]*+[+.,\\]?[\x20\t]*+\r?\n[\x20\t]*+(?:\+[\x20\t]*+)?["']"""  # a string literal goes on in the next line
_END_OF_LINE = rf"(?:\s|{_ESCAPE}|{_JOINT})"
_HEADER = r"[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\r\n\\\"'])*+(?:\r?\n[\x20\t]++(?=[^\s-])(?:(?!-----)[^\r\n\\])*+)*+"  # RFC 1421, folded lines too
_LABEL = r"(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
_PEM = re.compile(rf"-----BEGIN {_LABEL}(?:{_END_OF_LINE}++{_HEADER})*+(?:[A-Za-z0-9+/=\s]++|{_ESCAPE}|{_JOINT})++-----END {_LABEL}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def github_checksum(body: str) -> str:
    """The six base-62 digits of a token body's CRC-32."""
    value, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_BASE62[digit])
    return "".join(reversed(digits))


def _is_jwt(match: re.Match) -> bool:
    head = "eyJ" + match[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


#: Kind, keywords (folded), anchored expression, test of a match.
_RULES = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[2]) >= 8),
    ("access", ("akia",), _ACCESS, lambda m: len(m[0]) >= 16),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, lambda m: github_checksum(m[1]) == m[2]),
    ("jwt", ("eyj",), _JWT, _is_jwt),
    ("pem", ("-----begin",), _PEM, lambda m: True),
)


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for rule, (_, keywords, _, _) in enumerate(_RULES):
        for word in keywords:
            automaton.add_word(word, (rule, len(word)))
    automaton.make_automaton()
    return automaton


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the keyword kinds in a text."""
    starts: dict[int, list[int]] = {}
    for end, (rule, length) in automaton.iter(_fold(text)):
        starts.setdefault(rule, []).append(end - length + 1)
    found = []
    for rule, at in starts.items():
        kind, _, pattern, holds = _RULES[rule]
        done = 0
        for start in sorted(set(at)):
            if start < done:
                continue
            if match := pattern.match(text, start):
                done = match.end()
                if holds(match):
                    found.append((start, KINDS.index(kind), done))
            elif kind == "jwt":  # what follows the run decides, so no later start in it can match
                done = _JWT_RUN.match(text, start).end()
    return found


_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_HEX_RUN = re.compile(rb"[0-9a-f]+")
_PROBE = 16


def hex_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start byte, end byte within the row) of hexadecimal runs of 32 or more."""
    probes = _HEX[data[::_PROBE]]
    hits = np.flatnonzero(probes[:-1] & probes[1:]) * _PROBE
    if not len(hits):
        return []
    rows = np.searchsorted(offsets, hits, side="right") - 1
    found, done = [], -1
    raw = data.tobytes()
    for at, row in zip(hits.tolist(), rows.tolist(), strict=True):
        if at < done:
            continue
        low, high = int(offsets[row]), int(offsets[row + 1])
        start = at
        while start > low:
            step = max(low, start - 64)
            other = np.flatnonzero(~_HEX[data[step:start]])
            start = step + int(other[-1]) + 1 if len(other) else step
            if len(other):
                break
        done = _HEX_RUN.match(raw, at, high).end()
        if done - start >= 32:
            found.append((row, start - low, done - low))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(redact: str | None):
    def run(batches):
        automaton = _automaton()
        for batch in batches:
            column = batch.column("__text")
            step = max(1, int(len(column) * BATCH_BYTES / max(column.nbytes, 1)))
            for low in range(0, max(len(column), 1), step):
                part = batch.slice(low, step)
                if not part.num_rows:
                    continue
                texts = part.column("__text")
                spans = [keyword_spans(t, automaton) if t else [] for t in texts.to_pylist()]
                data, offsets = text_bytes(texts)
                for row, start, end in hex_spans(data, offsets):
                    lead = data[offsets[row] : offsets[row] + start]
                    start_at = int(np.count_nonzero((lead & 0xC0) != 0x80))
                    spans[row].append((start_at, 2, start_at + end - start))
                for found in spans:
                    found.sort()
                out = [part.column(name) for name in part.schema.names if name != "__text"]
                out.append(pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found] for found in spans], pa.list_(_SPAN)))
                if redact is not None:
                    out.append(pa.array([_masked(t, found, redact) for t, found in zip(texts.to_pylist(), spans, strict=True)], pa.string()))
                names = [name for name in part.schema.names if name != "__text"] + ["__spans"] + (["__masked"] if redact is not None else [])
                size = texts.nbytes
                yield pa.RecordBatch.from_arrays(out, names=names)
                part = texts = spans = data = found = out = None
                release(size)

    return run


def _masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan_secrets(docs: DataFrame, *, text_column: str = "text", keep: list[str] | None = None, spans_column: str = "spans", redact: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the spans of each text.

    ``spans_column`` is array<struct<kind, start, end>>.  With ``redact`` the
    text column follows, each stretch of spans replaced by that string.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_column and c != spans_column]
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_column}`").cast("string").alias("__text"))
    kinds = ", ".join(f"{name} {kind}" for name, kind in given.dtypes if name != "__text")
    schema = ", ".join(x for x in (kinds, "__spans array<struct<kind: string, start: long, end: long>>", "__masked string" if redact is not None else "") if x)
    found = given.mapInArrow(_scan(redact), schema)
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)] + [F.col("__spans").alias(spans_column)]
    return found.select(*back, *([F.col("__masked").alias(text_column)] if redact is not None else []))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
