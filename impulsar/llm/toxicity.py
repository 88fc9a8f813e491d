"""Operator 6: toxicity.

A lexicon of abusive terms (a short general list and terms learned from the
labels) is held in a trie.  The trie is intersected with Levenshtein automata:
states are sets of (trie node, errors), made deterministic as they are met, so
a word is read once and dies with its last surviving state.  Terms of five or
more letters allow one error, of nine or more two; a learned stem matches any
word that continues it.

Every hit is judged in its window of words: quotation marks around it or a
reporting verb near it make it a quotation, a second person makes it an
address.  A logistic model over the counts gives the score.

The labels are read only where ``crc32(doc_id as text) mod 5 <> 0``, and at most
``max_labelled`` of them (lowest hash of the id) fit the lexicon, of
``max_terms`` terms at most, and the logistic model.  The executors read their
texts; the driver gets counts and features.  Scores see the
text alone.

Defined cases: a null or empty text is scored like a text without hits; rows
are independent, so repeated rows, null ids and other columns change nothing;
without usable labels a fixed prior stands in; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impulsar.llm.common import cut
from impulsar.llm.words import Words, release

MAX_LABELLED, MAX_TERMS, WINDOW, BATCH_BYTES = 6000, 400, 6, 1 << 21
#: General terms known before any label is read.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "asshole", "bastard", "bitch", "retard", "vermin", "dickhead", "shithead", "subhuman")
MIN_DOCUMENTS, LEAST_ODDS = 4, 2.5
_QUOTES = "\"“”„«»‹›‘’'`"
_REPORT = frozenset("said says wrote writes called quote quoted quotes term word reported reports quoting".split())
_SECOND = frozenset("you your yours you're youre u ur yourself".split())
_LEET = str.maketrans("013457@$", "oieastas")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‹›‘’…–—¿¡"
N_FEATURES = 8


def plain(word: str) -> str:
    """A word without edge punctuation, in lower case, digits that stand for letters replaced."""
    word = word.strip(_EDGE).lower()
    return word.translate(_LEET) if word and not word.isalpha() and any(c.isalpha() for c in word) else word


def allowed(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class TermMatcher:
    """Lexicon trie intersected with Levenshtein automata, made deterministic lazily."""

    max_states = 20_000

    def __init__(self, terms: dict[str, bool]):
        """``terms``: term -> whether it is a stem (then it matches exactly, as a prefix)."""
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach = [0]  # most errors that any term below allows
        self.stems = terms
        for term, stem in terms.items():
            node, errors = 0, 0 if stem else allowed(term)
            self.reach[0] = max(self.reach[0], errors)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], errors)
            self.term[node] = term
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # letters left out of the word
            node = todo.pop()
            for child in self.children[node].values():
                if nodes[node] + 1 <= self.reach[child] and nodes[node] + 1 < nodes.get(child, 99):
                    nodes[child] = nodes[node] + 1
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= (0 if self.stems[self.term[n]] else allowed(self.term[n]))]
            stem = next((t for e, t in ends if self.stems[t]), None)
            self.ends.append((min((x for x in ends if not self.stems[x[1]]), default=None), stem))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, errors in self.states[state]:
            for letter, child in self.children[node].items():
                cost = errors + (letter != c)
                if cost <= self.reach[child] and cost < nodes.get(child, 99):
                    nodes[child] = cost
            if errors + 1 <= self.reach[node] and errors + 1 < nodes.get(node, 99):
                nodes[node] = errors + 1
        return self._state(nodes)

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, errors, whether by its stem) of the nearest term, if any."""
        if len(self.states) > self.max_states:
            self.clear()
        state, stem = self.start, None
        for c in word:
            step = self.next[state].get(c)
            if step is None:
                step = self.next[state][c] = self._step(state, c)
            state = step
            if state < 0:
                break
            stem = stem or self.ends[state][1]
        if state >= 0 and self.ends[state][0]:
            errors, term = self.ends[state][0]
            if not stem or not errors:
                return term, errors, False
        return (stem, 0, True) if stem else None


class Model:
    """Terms with their weights, and the logistic coefficients."""

    def __init__(self, terms: dict[str, bool], odds: dict[str, float], coefficients: np.ndarray | None):
        self.terms, self.odds, self.coefficients = terms, odds, coefficients
        self._matcher: TermMatcher | None = None

    def __getstate__(self):
        return {"terms": self.terms, "odds": self.odds, "coefficients": self.coefficients, "_matcher": None}

    @property
    def matcher(self) -> TermMatcher:
        if self._matcher is None:
            self._matcher = TermMatcher(self.terms)
        return self._matcher

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row per text; see ``N_FEATURES`` and the comments below."""
        words = Words(texts, lower=False)
        out = np.zeros((words.rows, N_FEATURES))
        out[:, 0] = 1
        if not len(words.hashes):
            return out
        raw = words.data.tobytes()
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        starts, ends, match = words.starts[first].tolist(), words.ends[first].tolist(), self.matcher.match
        hits = {i: m for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if (m := match(plain(raw[a:b].decode("utf-8", "replace"))))}
        if not hits:
            return out
        is_hit = np.zeros(len(first), dtype=bool)
        is_hit[list(hits)] = True
        at = np.flatnonzero(is_hit[inverse])
        rows = np.searchsorted(words.bounds, at, side="right") - 1
        read = lambda k: raw[words.starts[k] : words.ends[k]].decode("utf-8", "replace")
        distinct: dict[int, set] = {}
        for k, row in zip(at.tolist(), rows.tolist(), strict=True):
            term, errors, stem = hits[inverse[k]]
            low, high = max(words.bounds[row], k - WINDOW), min(words.bounds[row + 1], k + WINDOW + 1)
            before, after = [read(j) for j in range(low, k)], [read(j) for j in range(k + 1, high)]
            token = read(k)
            opened = token[0] in _QUOTES or any(w[0] in _QUOTES and w[-1] not in _QUOTES for w in before)
            closed = token.rstrip(".,;:!?")[-1:] in _QUOTES or any(w.rstrip(".,;:!?")[-1:] in _QUOTES and w[0] not in _QUOTES for w in after)
            reported = any(plain(w) in _REPORT for w in before)
            quoted = opened and closed or reported
            addressed = any(plain(w) in _SECOND for w in before + after)
            if quoted:
                out[row, 2] += 1
            elif errors:
                out[row, 3] += 1
            else:
                out[row, 4 if stem else 1] += 1
                out[row, 5] += self.odds.get(term, 0)
            out[row, 6] += addressed and not quoted
            if not quoted and not errors:
                distinct.setdefault(row, set()).add(term)
        for row, terms in distinct.items():
            out[row, 7] = len(terms)
        out[:, 1:] = np.log1p(np.maximum(out[:, 1:], 0))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.coefficients, -30, 30)))


#: Stands in where no label can be learned from: bias, plain hits, quoted, misspelled, stems, weights, addressed, distinct.
PRIOR = np.array([-2.5, 2.0, -0.5, 1.5, 1.0, 0.5, 0.5, 1.5])


def marks(text: str) -> set[str]:
    """A text's words, and their stems of 5 to 7 letters with a star."""
    seen = {w for w in map(plain, text.split()) if 3 < len(w) < 40}
    return seen | {w[:n] + "*" for w in seen for n in (5, 6, 7) if len(w) > n}


def lexicon(counts: list[tuple[str, int, int]], totals: tuple[int, int], max_terms: int = MAX_TERMS) -> Model:
    """Terms from (mark, clean, toxic documents) of ``totals`` clean and toxic ones; coefficients are the prior."""
    terms, odds = dict.fromkeys(SEED_TERMS, False), dict.fromkeys(SEED_TERMS, 3.0)
    if min(totals) >= 5:
        # A term that only chance explains is no term: demand odds far above the prior.
        ranked = []
        for word, clean, toxic in counts:
            weight = math.log((toxic + 0.5) / (totals[1] + 1) / ((clean + 0.5) / (totals[0] + 1)))
            if toxic >= MIN_DOCUMENTS and weight > LEAST_ODDS:
                ranked.append((-weight * math.log1p(toxic), word, weight))
        for _, word, weight in sorted(ranked)[:max_terms]:
            terms.setdefault(word.rstrip("*"), word.endswith("*"))
            odds[word.rstrip("*")] = weight
    return Model(terms, odds, PRIOR)


def fit(rows: list[tuple[str, int]], max_terms: int = MAX_TERMS) -> Model:
    """Lexicon and coefficients from (text, label) rows in memory."""
    counts = [Counter(m for text, y in rows if y == label for m in marks(text)) for label in (0, 1)]
    totals = tuple(sum(y == label for _, y in rows) for label in (0, 1))
    model = lexicon([(m, counts[0][m], n) for m, n in counts[1].items()], totals, max_terms)
    if min(totals) >= 5:
        features = np.concatenate([model.features(part) for part in _slices(pa.array([t for t, _ in rows], pa.large_string()))])
        model.coefficients = _logistic(features, np.array([y for _, y in rows], dtype=float))
    return model


def _slices(texts: pa.Array):
    """Runs of texts of about ``BATCH_BYTES``, so that what a slice needs stays bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BATCH_BYTES, side="right")))
        yield texts.slice(low, high - low)
        low = high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


_COUNTS = pa.schema([("mark", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])


def _count_marks(batches):
    """Documents of each label that have a mark, by slices of text."""
    for batch in batches:
        low = 0
        for texts in _slices(batch.column("text")):
            labels, low = batch.column("label").slice(low, len(texts)).to_pylist(), low + len(texts)
            counts = Counter(), Counter()
            for text, label in zip(texts.to_pylist(), labels, strict=True):
                counts[label].update(marks(text))
            every = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[m] for m in every], pa.int64()) for c in counts]], schema=_COUNTS)
            counts = every = None
            release(texts.nbytes)


def _by_slices(make, texts: pa.Array) -> list[np.ndarray]:
    """What ``make`` gives for each slice of the texts."""
    out = []
    for part in _slices(texts):
        out.append(make(part))
        release(part.nbytes)
    return out


def _features_of(model: Model):
    def run(batches):
        for batch in batches:
            found = _by_slices(model.features, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(np.concatenate(found)) if found else [], pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    """Fit on at most ``max_labelled`` labelled documents outside the held-out fold.

    Texts stay with the executors: they count marks and give features.  The
    driver gets the marks that the odds and support tests pass, and one row of
    features a document.  Of rows with one id the text with the lowest hash is
    read.
    """
    usable = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = cut(one.select("doc_id", "label", F.col("first.text").alias("text")))
    totals = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if min(totals) < 5:
        return lexicon([], tuple(totals))
    counted = rows.mapInArrow(_count_marks, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1) / ((F.col("clean") + 0.5) / (totals[0] + 1)))
    passing = counted.where((F.col("toxic") >= MIN_DOCUMENTS) & (odds > LEAST_ODDS - 1e-9))
    model = lexicon([tuple(r) for r in passing.toLocalIterator()], tuple(totals), max_terms)
    found = sorted(tuple(r) for r in rows.mapInArrow(_features_of(model), "doc_id long, label int, features array<double>").collect())
    model.coefficients = _logistic(np.array([r[2] for r in found]), np.array([r[1] for r in found], dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text_column: str = "text", score_column: str = "score", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (its text with ``keep_text``) and a double ``score_column`` from 0 to 1."""
    kept = [c for c in docs.columns if c != score_column and (keep_text or c != text_column)]
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_column}`").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            scores = _by_slices(model.score, batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names[:-1], "__score"])

    schema = ", ".join([f"{n} {t}" for n, t in given.dtypes if n != "__text"] + ["__score double"])
    return given.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("__score").alias(score_column))
