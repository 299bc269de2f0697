"""Operator 8: toxicity with a counterfactual-regularised classifier.

Features are the presence of words and of word beginnings. A logistic model is fitted to
labelled documents; in addition every labelled text that names a group (an identity term)
is rewritten with other terms of the same family, and the squared change of its score under
the rewriting is part of the loss. Terms that only name a group thus lose their weight,
which keeps neutral mentions from being rejected, while abuse keeps its weight.

The model is fitted on a bounded sample, about `SAMPLE_PER_LABEL` documents of each label
(all, where there are fewer) and no more than the bytes that `language_id.sampled` allows, chosen
by a hash of the identifier; scoring reads every whole text and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, texts, unused, with_text_column
from .language_id import fold_of, sampled
from .tokenizing import GENERATION_BYTES, Remembered, of_worker

#: Documents of each label that the model is fitted on, in expectation.
SAMPLE_PER_LABEL = 2500
#: Features must occur in so many sampled documents, and at most so many are kept.
LEAST_DOCUMENTS = 5
MOST_FEATURES = 8192
#: Lengths of word beginnings that are features of their own.
STEMS = (3, 4, 5, 6, 7)
RIDGE = 0.02
#: Weight of the squared score change under swapped identity terms.
COUNTERFACTUAL = 1.0
STEPS = 400

NO_FEATURES: frozenset[int] = frozenset()

#: Families of identity terms; a term may stand for any other of its family.
IDENTITY_FAMILIES = (
    ("woman", "man", "women", "men", "girl", "boy", "female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("frau", "mann", "frauen", "männer", "mädchen", "junge"),
    ("christlich", "muslimisch", "jüdisch", "katholisch"),
    ("femme", "homme", "femmes", "hommes", "fille", "garçon"),
    ("chrétien", "musulman", "juif", "catholique"),
    ("mujer", "hombre", "mujeres", "hombres", "niña", "niño"),
    ("cristiano", "musulmán", "judío", "católico"),
)

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


def words(text: str) -> set[str]:
    """Different words of a text in lower case."""
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def swapped(found: set[str], families=IDENTITY_FAMILIES) -> list[set[str]]:
    """The words with each family's terms moved on by one and by two; empty if none is named."""
    out = []
    for step in (1, 2):
        change = {}
        for family in families:
            change |= {term: family[(k + step) % len(family)] for k, term in enumerate(family) if term in found}
        if change:
            out.append({change.get(w, w) for w in found})
    return out


@dataclass
class Classifier:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, hit: set[int] | frozenset[int]) -> float:
        z = self.bias + sum(self.weights[k] for k in hit)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Bags:
    """The word sets of labelled texts, kept as numbers: each word once, four bytes for each place it is in."""

    def __init__(self, rows):
        known: dict[str, int] = {}
        self.labels, self.parts = [], []
        for text, label in rows:
            self.parts.append(np.array(sorted(known.setdefault(w, len(known)) for w in words(text)), np.int32))
            self.labels.append(label)
        self.words = list(known)

    def __len__(self) -> int:
        return len(self.labels)

    def __iter__(self):
        for part, label in zip(self.parts, self.labels):
            yield {self.words[k] for k in part.tolist()}, label


#: Slots in which features are counted before they are counted by name.
SLOTS = 1 << 20


def _choose(rows) -> dict[str, int]:
    """The features whose presence tells most about the label (by the chi-squared statistic).

    Most features are in one text only. They are counted in slots first, several to a slot, and
    named only where a slot is full enough, so that memory holds few names that cannot be chosen.
    """
    slots = np.zeros(SLOTS, np.int32)
    for found, _ in rows:
        own = {hash(f) % SLOTS for w in found for f in features_of(w)}
        slots[np.fromiter(own, np.int64, len(own))] += 1
    full = slots >= LEAST_DOCUMENTS
    seen, totals = (Counter(), Counter()), [0, 0]
    for found, label in rows:
        totals[label] += 1
        seen[label].update({f for w in found for f in features_of(w) if full[hash(f) % SLOTS]})
    n = max(1, sum(totals))
    ranked = []
    for name in seen[0].keys() | seen[1].keys():
        a, b = seen[1][name], seen[0][name]
        if a + b < LEAST_DOCUMENTS:
            continue
        expected = totals[1] * (a + b) / n
        spread = expected * (1 - totals[1] / n) * (1 - (a + b) / n)
        if spread > 0:
            ranked.append(((a - expected) ** 2 / spread, name))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    return {name: k for k, (value, name) in enumerate(ranked[:MOST_FEATURES]) if value > 6.6}


def _matrix(sets, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    sizes, columns = [], []
    for found in sets:
        hit = {index[f] for w in found for f in features_of(w) if f in index}
        sizes.append(len(hit))
        columns.append(np.fromiter(sorted(hit), np.int32, len(hit)))
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(columns).astype(np.int64) if columns else np.zeros(0, np.int64)


def fit(
    rows, families=IDENTITY_FAMILIES, penalty: float = COUNTERFACTUAL, base_rate: float | None = None
) -> Classifier:
    """Fit on (text, label) rows. `base_rate` is the share of label 1 in all rows, if they were sampled by label."""
    sets = Bags(rows)
    index = _choose(sets)
    if len(set(sets.labels)) < 2:
        share = (sum(sets.labels) + 0.5) / (len(sets) + 1)
        return Classifier({}, np.zeros(0), math.log(share / (1 - share)))
    # Identity terms get a weight too, so that the penalty has something to take away.
    named = set(sets.words)
    for term in sorted({t for family in families for t in family if t in named}):
        index.setdefault(term, len(index))
    problem = Problem(sets, index, families, penalty)
    params = np.zeros(len(index) + 1)
    sums, counts = np.zeros(len(params)), 0
    for step in range(STEPS):
        full = problem.gradient(params)
        sums = 0.999 * sums + 0.001 * full**2
        counts = counts * 0.999 + 0.001
        rate = 0.1 / (1 + step / 100)
        params = params - rate * full / (np.sqrt(sums / counts) + 1e-8)
    return Classifier(index, params[:-1], float(params[-1]))


class Problem:
    """The loss over labelled texts and their rewritten forms, as a function of all weights and the bias (last)."""

    def __init__(self, sets, index: dict[str, int], families, penalty: float):
        # `sets` gives (words, label) as often as it is gone through.
        self.penalty = penalty
        self.y = np.array([label for _, label in sets], float)
        self.row, self.column = _matrix((s for s, _ in sets), index)
        origin = []

        def rewritten():
            for k, (found, _) in enumerate(sets):
                for other in swapped(found, families):
                    origin.append(k)
                    yield other

        self.pair_row, self.pair_column = _matrix(rewritten(), index)
        self.origin = np.array(origin, np.int64)
        self.n, self.m, self.p = len(sets), len(index), len(origin)
        self.weight = np.where(self.y == 1, self.n / 2 / self.y.sum(), self.n / 2 / (self.n - self.y.sum()))

    def _scores(self, params):
        w, bias = params[:-1], params[-1]
        logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        prob = logistic(np.bincount(self.row, w[self.column], self.n) + bias)
        return prob, logistic(np.bincount(self.pair_row, w[self.pair_column], self.p) + bias) if self.p else np.zeros(0)

    def loss(self, params) -> float:
        """Weighted log loss, ridge on the weights, and the mean squared change of scores under rewriting."""
        prob, other = self._scores(params)
        likely = -np.sum(self.weight * (self.y * np.log(prob) + (1 - self.y) * np.log(1 - prob))) / self.n
        change = self.penalty * np.mean((prob[self.origin] - other) ** 2) if self.p else 0.0
        return float(likely + RIDGE * np.sum(params[:-1] ** 2) / 2 / self.m**0.5 + change)

    def gradient(self, params):
        prob, other = self._scores(params)
        # The slope of the loss in each text's own sum of weights; rewriting pulls on both forms.
        slope = self.weight * (prob - self.y) / self.n
        out = RIDGE * params[:-1] / self.m**0.5
        bias = 0.0
        if self.p:
            gap = 2 * self.penalty * (prob[self.origin] - other) / self.p
            slope = slope + np.bincount(self.origin, gap * prob[self.origin] * (1 - prob[self.origin]), self.n)
            back = gap * other * (1 - other)
            out = out - np.bincount(self.pair_column, back[self.pair_row], self.m)
            bias = -back.sum()
        return np.append(out + np.bincount(self.column, slope[self.row], self.m), slope.sum() + bias)


def learn(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_PER_LABEL) -> Classifier:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The many labels are joined to the documents' identifiers by Spark; the sample's texts meet in
    one task, which fits the model.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (fold_of("doc_id") != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    picked = sampled(known.join(sizes, "doc_id"), "toxic", each).select("doc_id", "toxic")
    # About 2 * `each` identifiers: a size fixed by the sample's bound.
    sample = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    sample = sample.repartition(1).sortWithinPartitions("doc_id", "text")
    return in_one_task(sample, lambda rows: fit((r["text"], int(r["toxic"])) for r in rows))


class Scorer:
    """Scores whole texts; remembers which chosen features a repeated word has."""

    def __init__(self, model: Classifier):
        self.model = model
        # Sets take more than the plain values that `Remembered` counts with.
        self.pieces = Remembered(self._piece, GENERATION_BYTES // 2)

    def _piece(self, piece: str) -> frozenset[int]:
        index = self.model.index
        return frozenset(index[f] for w in _WORD.findall(piece) for f in features_of(w) if f in index) or NO_FEATURES

    def __call__(self, text: str) -> float:
        hit = set().union(*map(self.pieces.__getitem__, set(text.lower().split())))
        return self.model.score(hit)


def _name(model: Classifier) -> str:
    return hashlib.sha256(repr((sorted(model.index), model.bias)).encode() + model.weights.tobytes()).hexdigest()


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row of `docs`.

    Null and empty texts have no features and get the score that the bias alone gives.
    Repeated rows repeat, a very long text is scored whole, an empty table gives no rows, and
    columns besides doc_id and text are left out. The model has at most `MOST_FEATURES` weights and
    those of identity terms, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = _name(model)
    rows = texts(docs).withColumn("held_out", fold_of("doc_id") == 0)

    def run(batches):
        scorer = of_worker(("toxicity", name), lambda: Scorer(shared.value))
        for batch in batches:
            scores = [scorer(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Learn from `labels` (doc_id, toxic) and score every row of `docs`."""
    return score(docs, learn(docs, labels, each))


def keep_below(docs: DataFrame, model: Classifier, limit: float) -> DataFrame:
    """The rows of `docs` with a score below `limit`, with all their columns, whatever their names.

    Null and empty texts have the score of the bias alone; a score equal to `limit` goes; repeated
    rows are judged alike, very long texts whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = _name(model)

    def scores(rows):
        scorer = of_worker(("toxicity", name), lambda: Scorer(shared.value))
        return [scorer(text) for text in rows]

    column = unused("toxic_score", docs)
    return with_text_column(docs, scores, pa.float64(), column).filter(F.col(column) < limit).drop(column)
