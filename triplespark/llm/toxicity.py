"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

Lexicon: learnt from labelled documents, as whole words that toxic documents have far more often than
others, and as stems (beginnings that many different such words share). Each term carries the logarithm
of that ratio as its weight. All terms form one trie. The Levenshtein automaton of a word's possible
misspellings is intersected with the trie by running the word through sets of (trie node, edits so far);
these sets are the states of a deterministic automaton that is built as words ask for it and kept. Whole
words and stems of `FUZZY` letters or more admit one edit (a letter more, less or other, or two neighbours
swapped), shorter ones none; a stem with an edit is a
beginning of the word at that distance, and counts as a misspelled hit. Whole words under a stem keep
their own edit.

Context: a hit counts as quotation if its window of `WINDOW` words to either side holds quotation marks
around it or a word of reporting, and as addressed if the window has the second person. The features of
a logistic score are the summed weights of direct, quoted, misspelled and misspelled quoted hits, the
number of addressed ones, and the hits that a toxic text of this length would have. Its weights are
fitted with a Gaussian prior around documented values, so kinds of hits that the labels don't show
(quotations) keep their prior weights.

Fit: at most `SAMPLE` labelled documents, the smallest by hash, whole texts: the documented bound.

Edge cases: null, empty and clean texts have no hits and score as the bias; a null doc_id is never held
out; repeated rows are kept; without labels the lexicon is empty; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import labelled_sample, remainder, text_or_empty
from triplespark.llm.encoding import slices

SAMPLE = 8_000
WINDOW = 8
FUZZY = 5
THRESHOLD = 0.7
#: A term is in so many toxic documents, and so large a share of them, at least, at so many times the rate
#: elsewhere; toxic documents times the ratio's logarithm reach GAIN.
LEAST, LEAST_SHARE, RATIO, GAIN = 3, 0.015, 5.0, 12.0
#: A stem has so many letters and different words; none of these makes up more than half of its documents.
STEM_LETTERS, STEM_WORDS = 4, 5
#: Weights of direct, quoted, misspelled and misspelled quoted hits, addressed ones, expected hits, bias.
PRIOR = np.array([1.0, 0.1, 0.6, 0.05, 0.3, -1.0, -4.0])
PRECISION = 1.0
#: Where any evidence exceeds this, all of it is scaled down alike, so that a long text keeps its density of hits.
MOST = 40.0
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes quoting word term phrase insult slur meaning means".split())
SECOND = frozenset("you your you're youre yourself u ur".split())
_OPEN, _CLOSE = "\"'“‘«„‚", "\"'”’»“‘"
_STRIP = re.compile(r"^[\W_]+|[\W_]+$").sub


class Automaton:
    """Terms (word, is_stem, weight) as a trie, and its intersection with the words' Levenshtein automata."""

    def __init__(self, terms: list[tuple[str, bool, float]], stem_edits: int = 0):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[float | None] = [None]
        self.weight = [0.0]
        self.budget = [0]
        self.loose: set[int] = set()  # nodes of stems that admit an edit; ~node in a state: that stem has been read with one
        for term, is_stem, weight in sorted(terms):
            node, budget = 0, 0 if len(term) < FUZZY else stem_edits if is_stem else 1
            self.budget[0] = max(self.budget[0], budget)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.weight.append(0.0)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], budget)
            if is_stem:
                self.stem[node] = weight
                if budget:
                    self.loose.add(node)
            else:
                self.word[node], self.weight[node] = term, weight
        self.alphabet = {c for kids in self.children for c in kids}
        self.stems: list[float] = []  # weights of stems that have been read; the state after the i-th is -2 - i
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, float] | None] = []  # what a word that ends in the state is
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int], swaps: frozenset = frozenset()) -> int:
        """The number of a set, closed under letters that the word leaves out; 0 edits win over 1. `swaps` are
        (node, letter): two letters stand swapped if that letter comes next, which leads to the node."""
        todo = [x for x in nodes.items() if x[0] >= 0]
        while todo:
            node, e = todo.pop()
            if e and node in self.loose:
                nodes[~node] = e
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items())), tuple(sorted(swaps))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, -self.weight[node]) for node, e in key[0] if node >= 0 and self.word[node] is not None and (e == 0 or len(self.word[node]) >= FUZZY)]
            ends += [(e, -self.stem[~node]) for node, e in key[0] if node < 0]
            self.ends.append((("exact", "fuzzy")[min(ends)[0]], -min(ends)[1]) if ends else None)
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        """The next state, -1 if no term is left, less once a stem has been read."""
        after: dict[int, int] = {}
        swaps = set()

        def add(node: int, e: int) -> None:
            if e <= self.budget[node] or e == 0:
                after[node] = min(e, after.get(node, 9))

        nodes, swapped = self.sets[state]
        for node, e in nodes:
            if node < 0:
                after[node] = e
                continue
            kids = self.children[node]
            if c in kids:
                if e == 0 and self.stem[kids[c]] is not None:
                    self.stems.append(self.stem[kids[c]])
                    return -1 - len(self.stems)
                add(kids[c], e)
            if e + 1 <= self.budget[node] or node == 0:
                add(node, e + 1)
                for other in kids.values():
                    add(other, e + 1)
            if e == 0:
                swaps |= {(k[c], first) for first, kid in kids.items() if first != c and c in (k := self.children[kid]) and self.budget[k[c]]}
        for node, letter in swapped:
            if letter == c:
                add(node, 1)
        return self._state(after, frozenset(swaps)) if after or swaps else -1

    def find(self, word: str) -> tuple[str, float] | None:
        """("exact", "stem" or "fuzzy", weight) of a lower-case word, None if it is no term."""
        state, steps, alphabet = self.start, self.steps, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            row = steps[state]
            if c not in row:
                row[c] = self._step(state, c)
            state = row[c]
            if state < 0:
                return ("stem", self.stems[-2 - state]) if state < -1 else None
        return self.ends[state]


def words(text: str) -> list[str]:
    return text.lower().split()


def learn_terms(rows: list[tuple[str, int]]) -> list[tuple[str, bool, float]]:
    """(word, is_stem, weight) of the terms that mark toxic documents."""
    bare = lambda t: {_STRIP("", w) for w in set(words(t))} - {""}
    begin = lambda found: {w[:k] for w in found for k in range(STEM_LETTERS, len(w) + 1)}
    rows = sorted(set(rows))  # copies of a document tell nothing new
    toxic = [bare(t) for t, y in rows if y]
    if not toxic or len(toxic) == len(rows):
        return []
    n_clean, least = len(rows) - len(toxic), max(LEAST, LEAST_SHARE * len(toxic))
    whole, stems = Counter(), Counter()
    for found in toxic:
        whole.update(found)
        stems.update(begin(found))
    common = whole
    whole = {w: n for w, n in whole.items() if n >= least}
    stems = {w: n for w, n in stems.items() if n >= least}
    clean_whole, clean_stems = Counter(), Counter()
    for t, y in rows:
        if not y:
            found = bare(t)
            clean_whole.update(found & whole.keys())
            clean_stems.update(begin(found) & stems.keys())
    weight = lambda n, m: float(np.log((n / len(toxic)) / ((m + 0.5) / n_clean)))
    marks = lambda n, w: w >= np.log(RATIO) and n * w >= GAIN
    stems = {s: (n, w) for s, n in stems.items() if marks(n, w := weight(n, clean_stems[s]))}
    below = defaultdict(set)  # the different words under each stem
    for found in toxic:
        for w in found:
            for k in range(STEM_LETTERS, len(w)):
                if w[:k] in stems:
                    below[w[:k]].add(w)
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for s, (n, w) in sorted(stems.items(), key=lambda x: (-x[1][0] * x[1][1], -len(x[0]), x[0])):
        if len(below[s]) < STEM_WORDS or max(common[x] for x in below[s]) > n / 2:
            continue
        if s not in beginnings and not any(s[:k] in chosen for k in range(STEM_LETTERS, len(s) + 1)):
            chosen[s] = w
            beginnings |= {s[:k] for k in range(STEM_LETTERS, len(s) + 1)}
    single = [(w, False, x) for w, n in whole.items() if len(w) > 2 and marks(n, x := weight(n, clean_whole[w]))]
    return sorted(single) + sorted((s, True, w) for s, w in chosen.items())


def hits(found: list[str], kinds: dict[str, tuple[str, float]]) -> np.ndarray:
    """Summed weights of direct, quoted, misspelled and misspelled quoted hits, addressed hits, all hits."""
    out = np.zeros(6)
    for i in [i for i, w in enumerate(found) if w in kinds]:
        kind, weight = kinds[found[i]]
        before, after = found[max(0, i - WINDOW):i], found[i + 1:i + 1 + WINDOW]
        own = found[i]
        opened = own[0] in _OPEN or any(w[0] in _OPEN and w[-1] not in _CLOSE for w in before)
        closed = own.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) or any(w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) and w[0] not in _OPEN for w in after)
        around = {_STRIP("", w) for w in before + after}
        quoted = (opened and closed) or bool(around & REPORTING)
        out[2 * (kind == "fuzzy") + quoted] += weight
        out[4] += not quoted and bool(around & SECOND)
        out[5] += 1
    return out


class Model:
    """Terms, weights, and the hits a word that toxic texts have more than others."""

    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray, rate: float = 0.0):
        self.terms, self.weights, self.rate, self.automaton = terms, weights, rate, Automaton(terms, stem_edits=1)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "rate": self.rate}

    def __setstate__(self, state):
        self.__init__(**state)

    def counts(self, texts: list[str]) -> np.ndarray:
        """What `hits` gives, and the number of words."""
        split = [words(t) for t in texts]
        find = self.automaton.find
        kinds = {}
        for w in set().union(*split):
            if kind := find(w) if w.isalpha() else find(_STRIP("", w)):
                kinds[w] = kind
        found, none = kinds.keys(), np.zeros(6)
        return np.array([[*(none if found.isdisjoint(s) else hits(s, kinds)), len(s)] for s in split]).reshape(-1, 7)

    def features(self, counts: np.ndarray) -> np.ndarray:
        found = np.c_[counts[:, :5], counts[:, 6] * self.rate]
        return np.c_[found * (MOST / np.maximum(found.max(axis=1, initial=MOST), MOST))[:, None], np.ones(len(counts))]

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return _logistic(self.features(counts) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[str, int]]) -> Model:
    """Lexicon and weights; Newton's steps on the posterior from the prior's means."""
    model = Model(learn_terms(rows), PRIOR.copy())
    if not rows:
        return model
    counts = np.concatenate([model.counts([t for t, _ in rows[a:b]]) for a, b in slices([len(t) for t, _ in rows], 2_000_000)])
    y, w = np.array([label for _, label in rows], dtype=float), PRIOR.copy()
    per_word = [counts[y == k, 5].sum() / max(1, counts[y == k, 6].sum()) for k in (0, 1)]
    model.rate = max(0.0, per_word[1] - per_word[0])
    x = model.features(counts)
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + PRECISION / 2 * ((w - PRIOR) ** 2).sum()
    for _ in range(50):
        p = _logistic(x @ w)
        slope = x.T @ (p - y) + PRECISION * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents that `learn` admits."""
    rows = labelled_sample(docs, labels, "toxic", learn, sample)

    def run(batches):
        data = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(data))], pa.binary())], ["model"])

    found = rows.select("text", "label").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train([])


def score(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """The kept columns, score, predicted and the number of hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            parts = [m.counts(texts[a:b]) for a, b in slices([len(t) for t in texts], 2_000_000)]
            x = np.concatenate(parts) if parts else np.zeros((0, 7))
            s, n = m.scores(x), x[:, 5].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(n)],
                [*names, "score", "predicted", "n_terms"])

    out = rows.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "n_terms": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(run, out)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores for all documents, learnt from labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder("doc_id", 3) == 1
    return score(docs, fit(docs, labels, ~held_out), "doc_id", held_out.alias("held_out"))
