"""Toxicity by a learned lexicon, misspellings by Levenshtein automata, and context windows.

Lexicon: words and stems (first letters of longer words) with a far larger share of documents in the toxic class than
in the clean one, by the log-likelihood ratio of the two shares.
All its words form a trie. The trie is run together with the Levenshtein automata of distance 1 (a swap of two
neighbours counts as one edit) of all words, and of distance 2 of long ones: a state is a set of (trie node, edits), made when first met
and kept, so each distinct word of a text costs one table step per character and most words die early.

Weights are smoothed log-odds counted on the labelled rows. A misspelling of a term weighs what such near
misses meant in labelled documents without an exact hit; with none seen, a term is taken to be misspelled
in one of twenty uses. Words around a hit, and quotation marks, shift its weight by what they meant around
hits in toxic and in clean documents, so quoted or reported terms can fall below the threshold.

Only the fit is bounded: at most ``train_rows`` labelled rows, those with the smallest hash of doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.llm.blocks import U, gram_hashes, mix, slices, span_hash, strings, word_bounds, word_hashes, written

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
STEMS = (4, 5, 6)
LONG = 9  # letters of a term that may have two edits
MISSPELT = 0.05
RATIO = 4  # least ratio of a term's share of toxic documents to its share of clean ones
AROUND = 3
QUOTED = '"'
KNOWN_WORDS = 200_000
_STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’‚¡¿…–—"
_QUOTES = set("\"'«»“”„‘’‚`")


def plain(word: str) -> str:
    return word.lower().strip(_STRIP)


class TermAutomaton:
    """The trie of terms and the Levenshtein automata of a distance, intersected and made on demand."""

    STATES = 200_000

    def __init__(self, terms: list[str], distance: int = 1) -> None:
        self.distance = distance
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[str | None] = []
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        out, fresh = set(items), items
        while fresh:
            fresh = {(child, edits + 1, "") for node, edits, owed in fresh if edits < self.distance and not owed
                     for child in self.children[node].values()} - out
            out |= fresh
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if not items:
            return -1
        if items not in self.numbers:
            self.numbers[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            self.ends.append(min((self.term[n] for n, _, owed in items if not owed and self.term[n]), default=None))
        return self.numbers[items]

    def _next(self, state: int, c: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            if owed:
                if owed == c:
                    out.add((node, edits, ""))
                continue
            more = edits < self.distance
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, edits, ""))
                elif more:
                    out.add((child, edits + 1, ""))
                    if c in self.children[child]:
                        out.add((self.children[child][c], edits + 1, letter))
            if more:
                out.add((node, edits + 1, ""))
        return self._state(self._closed(out))

    def near(self, word: str) -> str | None:
        """The smallest term within the distance of the word."""
        if len(self.sets) > self.STATES:
            self._reset()
        state = 0
        for c in word:
            known = self.steps[state].get(c)
            if known is None:
                known = self.steps[state][c] = self._next(state, c)
            if known < 0:
                return None
            state = known
        return self.ends[state]


class _Near:
    """Terms within one edit of a word, or else long terms within two."""

    def __init__(self, terms: list[str]) -> None:
        self.one, self.two = TermAutomaton(terms), TermAutomaton([t for t in terms if len(t) >= LONG], 2)

    def __call__(self, word: str) -> str | None:
        return self.one.near(word) or (self.two.near(word) if len(word) >= LONG - 2 else None)


class Model(NamedTuple):
    bias: float
    words: dict[str, float]
    stems: dict[str, float]
    near: dict[str, float]
    common: frozenset[str]  # words near a term that are ordinary words of clean documents
    context: dict[str, float]


class _Matcher:
    """Kind of hit and term of distinct words; what is known is kept up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.near = _Near(list(model.words))
        self.known: dict[bytes, tuple[int, str] | None] = {}

    def __call__(self, raw: bytes) -> tuple[int, str] | None:
        if raw in self.known:
            return self.known[raw]
        word, found = plain(raw.decode("utf-8", "replace")), None
        if word in self.model.words:
            found = (0, word)
        else:
            for size in STEMS:
                if len(word) > size and word[:size] in self.model.stems:
                    found = (1, word[:size])
            if not found and word and word not in self.model.common:
                term = self.near(word)
                found = (2, term) if term else None
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        self.known[raw] = found
        return found


def _hits(part: pa.RecordBatch, match: _Matcher) -> Iterator[tuple[int, list[tuple[int, str, list[str]]]]]:
    """Of each row with hits: kind, term and the words around each hit."""
    data, offsets = strings(part.column("text"))
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data.tobytes())])
    coded = pieces.dictionary_encode()
    codes = coded.indices.to_numpy()[::2]
    used = np.zeros(len(coded.dictionary), bool)
    used[codes] = True
    found = {int(i): m for i, raw in zip(np.flatnonzero(used), coded.dictionary.filter(pa.array(used)).to_pylist()) if (m := match(raw))}
    flags = np.zeros(len(coded.dictionary), bool)
    flags[list(found)] = True
    raw = data.tobytes()
    rows: dict[int, list] = {}
    for at in np.flatnonzero(flags[codes]).tolist():
        row = int(np.searchsorted(first, at, "right")) - 1
        lo, hi = max(first[row], at - AROUND), min(first[row + 1], at + AROUND + 1)
        around = [raw[starts[i]: ends[i]].decode("utf-8", "replace") for i in range(lo, hi)]
        own = around[at - lo]
        words = [plain(w) for i, w in enumerate(around) if i != at - lo]
        if own[0] in _QUOTES or (around[0][:1] in _QUOTES and around[-1].rstrip(".,;:!?")[-1:] in _QUOTES):
            words.append(QUOTED)
        rows.setdefault(row, []).append((*found[int(codes[at])], words))
    yield from rows.items()


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's word triples (of its bytes as a whole if it has fewer words)."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = strings(part.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            grams = gram_hashes(word_hashes(data, starts, ends), 3)
            whole = span_hash(data, offsets[:-1], offsets[1:])
            keys = []
            for salt in (0, 1):
                hashed = mix(grams + U(salt))
                keys.append([hashed[a: b - 2].min() if b - a > 2 else w for a, b, w in zip(first.tolist(), first[1:].tolist(), whole)])
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in ("doc_id", "text", "toxic")] + [pa.array(np.array(k, U).view(np.int64)) for k in keys],
                names=["doc_id", "text", "toxic", "one", "two"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of toxic and clean documents with each word and stem; '' counts the documents."""
    for batch in batches:
        for part in slices(batch):
            seen = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = {plain(w) for w in (text or "").split()} - {""}
                seen[toxic].update(words)
                for size in STEMS:
                    seen[toxic].update({w[:size] + "*" for w in words if len(w) > size})
                seen[toxic][""] += 1
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()),
                 pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])


def _hit_counts(model: Model):
    """Documents without an exact hit by near-miss term, and words around exact hits, by label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(model)
        for batch in batches:
            for part in slices(batch):
                labels = part.column("toxic").to_pylist()
                seen = (Counter(), Counter())
                for row, hits in _hits(part, match):
                    own = seen[labels[row]]
                    if all(kind == 2 for kind, _, _ in hits):
                        own.update({("near", term) for _, term, _ in hits})
                    for kind, _, words in hits:
                        if kind < 2:
                            own.update({("context", w) for w in words} | {("context", "")})
                keys = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()),
                     pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
                    names=["kind", "term", "toxic", "clean"])
    return run


def _evidence(n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of two shares of documents with a term, toxic and clean, against one share."""
    def fit_of(seen: Column, n: Column) -> Column:  # 0 log 0 is 0
        rest = n - seen
        return F.when(seen > 0, seen * F.log(seen / n)).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / n)).otherwise(0.0)
    toxic, clean, n, m = F.col("toxic"), F.col("clean"), F.lit(n_toxic), F.lit(n_clean)
    return fit_of(toxic, n) + fit_of(clean, m) - fit_of(toxic + clean, n + m)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``train_rows`` rows of labels (doc_id, toxic 0/1); others have no part in the fit.

    Null labels and labels without a document are left out. Without toxic or clean rows the model has no terms.
    """
    chosen = (labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows))
    train = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .mapInArrow(_min_hashes, "doc_id long, text string, toxic int, one long, two long"))
    for key in ("one", "two"):  # near copies say the same thing again: one document of each min-hash counts
        rest = [c for c in train.columns if c != key]
        train = train.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("doc_id", "toxic")).alias("row")).select(key, "row.*")
    train = written(train.select("text", "toxic"))
    counted = written(train.mapInArrow(_term_counts, "term string, toxic long, clean long")
                      .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = counted.filter("term = ''").first()
    n_toxic, n_clean = (total.toxic, total.clean) if total else (0, 0)
    if not n_toxic or not n_clean:
        return Model(-4.0, {}, {}, {}, frozenset(), {})
    # chance alone should give less than one term
    bar = math.log(counted.count()) + 1
    strong = counted.filter((F.col("term") != "") & (F.col("toxic") * n_clean >= RATIO * F.col("clean") * n_toxic)
                            & (_evidence(n_toxic, n_clean) >= bar)).collect()

    def weight(toxic: float, clean: float) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    words = {r.term: weight(r.toxic, r.clean) for r in strong if not r.term.endswith("*")}
    stems = {r.term[:-1]: weight(r.toxic, r.clean) for r in strong if r.term.endswith("*")}
    uses = {r.term: r.toxic for r in strong}
    close = _Near(list(words))
    # ordinary words near a term: seen in two clean documents or more
    likely = counted.filter((F.col("clean") >= 2) & ~F.col("term").endswith("*") & (F.length("term").between(
        1, 2 + max(map(len, words), default=0)))).select("term")
    common = frozenset(r.term for r in likely.toLocalIterator() if r.term not in words and close(r.term))
    bias = math.log(n_toxic / n_clean)
    model = Model(bias, words, stems, {}, common, {})
    rows = (train.mapInArrow(_hit_counts(model), "kind string, term string, toxic long, clean long")
            .groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter("kind = 'near' or clean >= 2 or term = ''").collect())
    near = {t: weight(MISSPELT * uses[t], 0) for t in words}
    near |= {r.term: weight(r.toxic + MISSPELT * uses[r.term], r.clean) for r in rows if r.kind == "near"}
    every = next(((r.toxic, r.clean) for r in rows if r.kind == "context" and not r.term), (0, 0))
    share = (every[0] + 1) / (sum(every) + 2)
    context = {r.term: max(-6.0, min(1.0, math.log((r.toxic + 5 * share) / (r.clean + 5 * (1 - share)) * (1 - share) / share)))
               for r in rows if r.kind == "context" and r.term}
    return model._replace(near=near, context=context)


def _batch_scores(part: pa.RecordBatch, model: Model, match: _Matcher) -> tuple[np.ndarray, np.ndarray]:
    logit = np.full(part.num_rows, model.bias - 2.0)
    count = np.zeros(part.num_rows, np.int64)
    for row, hits in _hits(part, match):
        total, missed = 0.0, {}  # a misspelled term counts once, by its strongest use
        for kind, term, words in hits:
            shift = sum(model.context.get(w, 0.0) for w in words)
            worth = max(0.0, (model.words, model.stems, model.near)[kind][term] + shift)
            if kind == 2:
                missed[term] = max(missed.get(term, 0.0), worth)
            else:
                total += worth
        logit[row] = model.bias + total + sum(missed.values())
        count[row] = len(hits)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), count


def _scored(model_parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_parts.value
        match = _Matcher(model)
        for batch in batches:
            for part in slices(batch):
                scores, count = _batch_scores(part, model, match)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(count)],
                                                 names=["doc_id", "score", "n_hits"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_hits of every whole text. docs: doc_id, text; other columns are not read.

    Null and empty texts have the score of a text without hits. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_scored(shared), "doc_id long, score double, n_hits long"))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_batch_scores(part, shared.value, match)[0] < threshold))
    return docs.mapInArrow(run, docs.schema)


def training_side(column: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 0 or 2 modulo 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1
