"""Toxicity: a learnt lexicon met by Levenshtein automata, scored by context.

The lexicon holds the words that labelled toxic documents have far more often
than the others. Its trie is intersected with Levenshtein automata: a state is
a set of (trie node, edits so far), and it moves on one letter (code point) of a word. States
are made as texts need them and remembered, so a block of words runs through
the automaton as array look-ups, all words in step, and most die early.

A hit counts by its term's log-odds; one with edits by odds of its spelling, which
start below those of the term and fall with every clean document that has that
spelling. A hit is seen in a window of words around it: hits near one another or near an address of the reader strengthen each
other, and hits within quotation marks or after a word of reporting weaken. A
logistic model turns the sums into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import drop, materialise, resident, tidy

#: Labelled rows that the lexicon and the weights are learnt from, at most.
SAMPLE = 20_000
#: Terms of the lexicon at most, the strongest (a parameter of `fit`); documents that must have a term; least log-odds.
TERMS, LEAST_DOCS, LEAST_ODDS = 400, 5, 2.5
#: Words on either side of a hit that its context is taken from.
WINDOW = 10
# Words that address the reader, and words that report speech, in the four languages of the corpus.
ADDRESS = ("you", "your", "du", "dein", "sie", "tu", "te", "ton", "vous", "tus", "usted")
REPORTS = ("said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "zitat", "dit", "cite", "dijo", "cita", "escribió")


def edits_for(term: str) -> int:
    """Edits that a term allows: none to 4 letters, one to 8, else two."""
    n = len(term)
    return 0 if n <= 4 else 1 if n <= 8 else 2


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of spans of UTF-8, one span after the other, and where each span's begin and end."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    raw = data[np.repeat(starts - first, sizes) + np.arange(sizes.sum())].astype(np.int64)
    lead = (raw & 0xC0) != 0x80
    places = np.flatnonzero(lead)
    counts = np.concatenate([[0], np.cumsum(lead)])
    head, padded = raw[places], np.concatenate([raw, [0, 0, 0]]) & 0x3F
    more = (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
    out = head & np.array([0x7F, 0x1F, 0x0F, 0x07])[more]
    for k in (1, 2, 3):
        out = np.where(more >= k, out << 6 | padded[places + k], out)
    return out, counts[first], counts[first + sizes]


class Automaton:
    """The trie of some terms, intersected with their Levenshtein automata; code points are letters."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.room: list[int] = [0]  # most edits of any term at or below the node
        for t, term in enumerate(terms):
            allowed, node = edits_for(term), 0
            self.room[0] = max(self.room[0], allowed)
            for letter in map(ord, term):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.room.append(0)
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], allowed)
            self.ends[node] = t
        self.allowed = [edits_for(t) for t in terms]
        used = sorted({x for c in self.children for x in c})
        self.used = np.array(used, np.int64)
        self.letters = [-1, *used]  # by class; class 0: of no term
        self.sets: list[frozenset] = [frozenset()]  # state 0 is dead
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.step = np.full((256, len(self.letters)), -1, np.int32)
        self.step[0] = 0
        self.accept: list[tuple[int, int]] = [(-1, 0)]
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """With what skipping letters of terms reaches; best: fewest edits by node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            e = best[node] + 1
            for child in self.children[node].values():
                if e <= self.room[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        return frozenset(best.items())

    def _state(self, nodes: frozenset) -> int:
        at = self.known.get(nodes)
        if at is None:
            at = self.known[nodes] = len(self.sets)
            self.sets.append(nodes)
            ends = [(e, self.ends[n]) for n, e in nodes if self.ends[n] >= 0 and e <= self.allowed[self.ends[n]]]
            self.accept.append((min(ends)[1], min(ends)[0]) if ends else (-1, 0))
            if at >= len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
        return at

    def _move(self, state: int, cls: int) -> int:
        best: dict[int, int] = {}
        letter = self.letters[cls]
        for node, e in self.sets[state]:
            for x, child in self.children[node].items():
                cost = e + (x != letter)
                if cost <= self.room[child] and cost < best.get(child, 99):
                    best[child] = cost
            if e + 1 <= self.room[node] and e + 1 < best.get(node, 99):
                best[node] = e + 1
        to = self._state(self._closed(best))
        self.step[state, cls] = to
        return to

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, a span of UTF-8, the nearest term (-1: none) and its edits; all words move in step."""
        letters, starts, ends = code_points(data, starts, ends)
        at = np.searchsorted(self.used, letters)
        known = at < len(self.used)
        known[known] = self.used[at[known]] == letters[known]
        classes = np.where(known, at + 1, 0).astype(np.int32)
        state = np.full(len(starts), self.start, np.int32)
        alive, at = np.flatnonzero(ends > starts), 0
        while len(alive):
            here = state[alive]
            cls = classes[starts[alive] + at]
            to = self.step[here, cls]
            while (to < 0).any():
                pairs = np.unique(np.stack([here[to < 0], cls[to < 0]], 1), axis=0)
                for s, c in pairs.tolist():
                    self._move(s, c)
                to = self.step[here, cls]
            state[alive] = to
            at += 1
            alive = alive[(to > 0) & (ends[alive] - starts[alive] > at)]
        accept = np.array(self.accept, np.int32)
        return accept[state, 0], accept[state, 1]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(K.span_hashes(data, starts, ends, lower=False))
    one = np.empty(len(distinct), np.int64)
    one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, one


def _words_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): documents of the batch that have it."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for at, n, data, offsets in K.text_blocks(_lowered(batch.column(0))):
            starts, ends, places = K.word_spans(data, offsets, K.NOT_ALNUM)
            if not len(starts):
                continue
            codes, one = _distinct(data, starts, ends)
            doc = np.repeat(np.arange(n), np.diff(places))
            pairs = np.unique(codes * n + doc)
            toxic = labels[at : at + n][pairs % n] == 1
            words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(pairs // n, toxic, len(one)).astype(np.int64)), pa.array(np.bincount(pairs // n, ~toxic, len(one)).astype(np.int64))], names=["word", "toxic", "clean"])


N_FEATURES = 6
#: What a word with edits has less, before evidence, than the term's log-odds; the share of these that it has at least; and what a further edit leaves.
MISSPELT, UNSEEN, FURTHER = 3.0, 0.25, 0.8


def unseen(odds: float) -> float:
    """The log-odds of a misspelling of which no labelled document tells."""
    return max(odds - MISSPELT, UNSEEN * odds)


class Scorer:
    """Features of texts under a lexicon of (term, log-odds, ((misspelling, log-odds), ...)), the misspellings
    being those that labelled documents have."""

    def __init__(self, lexicon: list[tuple[str, float, tuple]]):
        self.automaton = Automaton([t for t, _, _ in lexicon])
        self.odds = np.array([o for _, o, _ in lexicon] + [0.0])
        self.misspelt = np.array([unseen(o) for _, o, _ in lexicon] + [0.0])
        seen = [pair for _, _, spellings in lexicon for pair in spellings]
        hashes = np.array(self._hash(tuple(w for w, _ in seen)), np.uint64)
        order = np.argsort(hashes)
        self.seen, self.seen_odds = hashes[order], np.array([o for _, o in seen])[order]
        self.address = set(self._hash(ADDRESS))
        self.reports = set(self._hash(REPORTS))

    @staticmethod
    def _hash(words: tuple[str, ...]) -> list[int]:
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        return K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends, lower=False).tolist()

    def edited(self, column: pa.Array) -> Iterator[tuple[int, int, str]]:
        """(text, term, word) of the words that are a term with edits, once for each text."""
        for at, n, data, offsets in K.text_blocks(_lowered(column)):
            starts, ends, places = K.word_spans(data, offsets, K.NOT_ALNUM)
            if not len(starts):
                continue
            codes, one = _distinct(data, starts, ends)
            term, edits = self.automaton.match(data, starts[one], ends[one])
            hit = np.flatnonzero(((term >= 0) & (edits > 0))[codes])
            doc = np.searchsorted(places, hit, side="right") - 1
            for i, c in np.unique(np.stack([doc, codes[hit]], 1), axis=0).tolist():
                yield at + i, int(term[c]), data[starts[one[c]] : ends[one[c]]].tobytes().decode("utf-8", "replace")

    def _values(self, hashes: np.ndarray, term: np.ndarray, edits: np.ndarray) -> np.ndarray:
        """The log-odds of words of these terms and edits."""
        misspelt = self.misspelt[term]
        if len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)
            misspelt = np.where(self.seen[at] == hashes, self.seen_odds[at], misspelt)
        return np.where(edits == 0, self.odds[term], misspelt * FURTHER ** np.maximum(edits - 1, 0))

    def features(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), N_FEATURES))
        for at, n, data, offsets in K.text_blocks(_lowered(column)):
            starts, ends, places = K.word_spans(data, offsets, K.NOT_ALNUM)
            if not len(starts):
                continue
            hashes = K.span_hashes(data, starts, ends, lower=False)
            codes, distinct = pd.factorize(hashes)
            one = np.empty(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            term, edits = self.automaton.match(data, starts[one], ends[one])
            value = self._values(distinct, term, edits)
            hit = np.flatnonzero(((term >= 0) & (value > 0))[codes])
            if not len(hit):
                continue
            weight = value[codes[hit]]
            share = weight / self.odds[term[codes[hit]]]  # of a hit without edits
            doc = np.searchsorted(places, hit, side="right") - 1
            lo, hi = np.maximum(hit - WINDOW, places[doc]), np.minimum(hit + WINDOW + 1, places[doc + 1])
            # other hits, words of address and of reporting within the window
            address = np.concatenate([[0], np.cumsum(np.isin(distinct, np.array(list(self.address), np.uint64))[codes])])
            report = np.concatenate([[0], np.cumsum(np.isin(distinct, np.array(list(self.reports), np.uint64))[codes])])
            near = np.searchsorted(hit, hi) - np.searchsorted(hit, lo) - 1
            told = report[hit] - report[lo] > 0
            you = address[hi] - address[lo] > 0
            quoted = self._quoted(data, offsets, starts[hit], doc)
            context = np.where(quoted | told, 0.25, 1.0) * (1 + 0.25 * np.minimum(near, 4) + 0.25 * you)
            words = np.diff(places)
            total = lambda x: np.bincount(doc, x, n)
            score = total(weight * context)
            most = np.zeros(n)
            np.maximum.at(most, doc, weight * context)
            hits, any_ = total(share), np.zeros(n)
            np.maximum.at(any_, doc, share)
            out[at : at + n] = np.stack([np.log1p(score), most, np.log1p(hits), np.log1p(100 * score / np.maximum(words, 20)), np.log1p(total((quoted | told) * share)), any_], 1)
        return out

    @staticmethod
    def _quoted(data: np.ndarray, offsets: np.ndarray, where: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether an odd number of quotation marks (straight, curly or angular) precedes on the line."""
        one, two = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
        curly = (data == 0xE2) & (one == 0x80) & (two >= 0x9C) & (two <= 0x9E)
        angular = (data == 0xC2) & ((one == 0xAB) | (one == 0xBB))
        marks = np.flatnonzero((data == 34) | curly | angular)
        if not len(marks):
            return np.zeros(len(where), bool)
        lines = np.flatnonzero(data == 10)
        line = np.searchsorted(lines, where)
        begin = np.maximum(np.where(line > 0, lines[np.maximum(line - 1, 0)] if len(lines) else 0, 0), offsets[doc])
        return (np.searchsorted(marks, where) - np.searchsorted(marks, begin)) % 2 == 1


def _scorer(lexicon: list[tuple[str, float, tuple]]) -> Scorer:
    return resident(("scorer", tuple(lexicon)), lambda: Scorer(lexicon))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) by Newton steps; the intercept is not shrunk."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def label_sample(labels: DataFrame, column: str, sample: int, keep=None) -> DataFrame:
    """(doc_id, label) of at most `sample` labelled documents, the lowest by a hash of doc_id.

    A document that has several labels counts with the highest; null labels and null ids are no labels.
    """
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", most_terms: int = TERMS) -> dict:
    """Learn a lexicon of at most `most_terms` terms and the weights from at most `sample` labelled documents.

    The sample has a fixed bound, so it may be broadcast, and its features may be collected. Without
    labelled documents, or with one class only, the lexicon is empty and the score is constant.
    """
    chosen = materialise(label_sample(labels, label, sample, keep), "sample")
    n = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        drop(chosen)
        return {"lexicon": [], "weights": [0.0] * N_FEATURES + [20.0 if toxic else -20.0 if clean else 0.0]}
    # the corpus is read once; the three passes below are over the sample's texts
    rows = materialise(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label"), "sample-texts")
    words = rows.mapInArrow(tidy(_words_by_label), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = words.where((F.col("toxic") >= LEAST_DOCS) & (F.length("word") >= 3)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    terms = [(r["word"], float(r["odds"]), ()) for r in best.orderBy(F.desc("odds"), F.desc("toxic"), "word").limit(most_terms).collect()]

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            found = [(t, w, int(y[i] == 1), int(y[i] != 1)) for i, t, w in _scorer(terms).edited(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["term", "word", "toxic", "clean"])

    def spelling_odds(t: int, c: int, odds: float) -> float:
        """Odds from the documents seen and from one imagined toxic one, with as many clean ones as the odds unseen ask for."""
        return math.log((t + 1) / toxic) - math.log((c + clean / toxic * math.exp(-unseen(odds))) / clean)

    # the words of at most `sample` documents that are near a term
    seen = rows.mapInArrow(tidy(misspelt), "term long, word string, toxic long, clean long").groupBy("term", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).orderBy("term", "word").collect() if terms else []
    spellings: list[list[tuple[str, float]]] = [[] for _ in terms]
    for r in seen:
        odds_ = terms[r["term"]][1]
        spellings[r["term"]].append((r["word"], max(0.0, min(odds_, spelling_odds(r["toxic"], r["clean"], odds_)))))
    lexicon = [(w, o, tuple(s)) for (w, o, _), s in zip(terms, spellings)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _scorer(lexicon).features(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(N_FEATURES)), batch.column(1)], names=[*(f"f{k}" for k in range(N_FEATURES)), "label"])

    # at most `sample` rows of a few numbers
    got = rows.mapInArrow(tidy(features), ", ".join(f"f{k} double" for k in range(N_FEATURES)) + ", label int").toPandas().to_numpy(float)
    drop(chosen, rows)
    return {"lexicon": lexicon, "weights": logistic(got[:, :-1], got[:, -1]).tolist()}


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score from 0 to 1) for each row of docs; null and empty texts have no hits and score low."""
    lexicon, weights = [tuple(x) for x in model["lexicon"]], np.array(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _scorer(lexicon).features(batch.column(1)) if lexicon else np.zeros((batch.num_rows, N_FEATURES))
            p = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def held_out(remainder: int, divisor: int, doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod divisor = remainder; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(divisor)) == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, remainder: int = 2, divisor: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from rows that are not held out.

    Null, empty and white texts score as texts without a hit. Rows that repeat a doc_id are scored each
    by its own text. A null doc_id is not held out. An empty table gives an empty result.
    """
    model = fit(docs, labels, keep=~held_out(remainder, divisor))
    out = score(docs, model)
    return out.select("doc_id", held_out(remainder, divisor).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; learns from all labels.

    Each row is decided by its own text in one pass, without a join.
    """
    model = fit(docs, labels)
    lexicon, weights = [tuple(x) for x in model["lexicon"]], np.array(model["weights"])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _scorer(lexicon).features(batch.column(at)) if lexicon else np.zeros((batch.num_rows, N_FEATURES))
            p = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
