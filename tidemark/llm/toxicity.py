"""Toxicity: a lexical classifier that is regularised by counterfactuals.

A text's features are its words and the beginnings of its words (``SHORTEST`` to ``LONGEST``
letters, so that inflected and compounded forms of a root share a feature), each with the
logarithm of how dense it is: log(1 + 100 * count / (words + 50)). The score is a logistic
regression over ``FEATURES`` of them.

Identity terms (names of groups of people) stand in many toxic sentences, so a plain fit
blames the terms. Here every labelled sentence that names a group is also read with the
term swapped for each other term of its set, a neutral one (``people``) among them, and a
change of the score is penalised: besides the log-loss and the lasso penalty the fit
minimises ``FAIRNESS`` times the mean squared change of the log-odds over all swaps. The
features that tell groups apart lose their weight, and what else is in toxic sentences
carries the score; a neutral mention of a group no longer raises it.

Spark's part: features of the sample are counted, and chosen by how well they tell the
classes apart, by an aggregation; the driver sees the chosen ``FEATURES``, the sample's
values of them (``SAMPLE`` rows) and the swaps' changes added up to one matrix of features
by features. All swaps of all sentences of the sample enter that matrix; tasks add them up
before they leave. Scoring is one scan of whole texts without a shuffle.

Labels are read from rows whose crc32(doc_id as text) mod 5 is not 0; the rest stay held
out. Only words of the text enter a score.

Defined results: a null text counts as empty; an empty text, like one without any chosen
feature, has the score of the bias. A null doc_id counts as the empty string in the split.
Labels that are null or neither 0 nor 1 are left out, a document labelled twice counts
twice; without labels of both classes every score is 0.5. Repeated rows are scored each, an
empty table gives no rows, extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, store

#: The most labelled rows that a fit looks at: those first by a hash of doc_id.
SAMPLE = 20_000
FEATURES = 1500
#: A feature is in so many toxic documents of the sample at least.
LEAST = 3
SHORTEST, LONGEST = 3, 9
PENALTY, FAIRNESS = 3e-4, 4.0
#: Words whose features a worker remembers, and the longest of them.
REMEMBERED, LONGEST_WORD = 400_000, 32

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Sets of terms that may stand for each other in a sentence, the neutral one first.
IDENTITIES = tuple(
    tuple(x.split())
    for x in (
        "people women men girls boys muslims jews christians hindus buddhists atheists immigrants refugees foreigners gays lesbians blacks whites asians africans arabs mexicans",
        "person woman man girl boy muslim jew christian hindu buddhist atheist immigrant refugee foreigner lesbian african arab mexican",
        "human female male black white asian latino jewish islamic catholic gay straight bisexual transgender queer disabled deaf blind old young",
        "leute frauen männer muslime juden christen ausländer flüchtlinge schwule lesben türken araber",
        "gens femmes hommes musulmans juifs chrétiens immigrés réfugiés étrangers homosexuels lesbiennes arabes",
        "personas mujeres hombres musulmanes judíos cristianos inmigrantes refugiados extranjeros homosexuales lesbianas árabes",
    )
)


def swaps(words: list[str], identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Iterator[list[str]]:
    """The words of a sentence with all mentions of one identity term swapped for another of
    its set, once for each term and each other."""
    for terms in identities:
        for held in set(words).intersection(terms):
            for other in terms:
                if other != held:
                    yield [other if w == held else w for w in words]


def beginnings(word: str) -> list[str]:
    """A word's features: itself as a whole, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def density(count: float, words: int) -> float:
    return math.log1p(100 * count / (words + 50))


class Features:
    """Counts of features in texts. Features are numbered as in ``names``; without ``names``
    all count, by name."""

    def __init__(self, names: list[str] | None = None) -> None:
        self.number = None if names is None else {x: i for i, x in enumerate(names)}
        self.seen: dict[str, tuple] = {}

    def of(self, word: str) -> tuple:
        found = self.seen.get(word)
        if found is None:
            found = tuple(beginnings(word))
            if self.number is not None:
                found = tuple(self.number[x] for x in found if x in self.number)
            if len(word) <= LONGEST_WORD:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def counts(self, words: list[str]) -> dict:
        out: dict = {}
        for word, times in Counter(words).items():
            for x in self.of(word):
                out[x] = out.get(x, 0) + times
        return out

    def values(self, words: list[str]) -> dict:
        return {x: density(n, len(words)) for x, n in self.counts(words).items()}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    """Score = 1 / (1 + exp(-(bias + sum of weight * density)))."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> tuple[Features, list[float]]:
        return Features(list(self.weights)), list(self.weights.values())

    def odds(self, words: list[str], scorer: tuple[Features, list[float]] | None = None) -> float:
        features, weights = scorer or self.scorer()
        return self.bias + math.fsum(weights[x] * v for x, v in features.values(words).items())

    def score(self, text: str | None) -> float:
        return squashed(self.odds(words_of(text)))


def squashed(odds: float) -> float:
    return 1 / (1 + math.exp(-odds)) if odds >= 0 else math.exp(odds) / (1 + math.exp(odds))


@dataclass(frozen=True)
class Rows:
    """Rows of few non-zero values each: where each row starts, and columns and values."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0.0, np.cumsum(self.values * v[self.columns]))[self.starts])

    def transposed_times(self, of: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[of], self.width)


def fit(x: Rows, y: np.ndarray, changes: np.ndarray, penalty: float = PENALTY, fairness: float = FAIRNESS, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal gradients with momentum. ``changes`` is the mean outer
    product of what the swaps change."""
    prior = float(np.log(y.mean() / (1 - y.mean())))
    w, bias = np.zeros(x.width), prior
    if not x.width:
        return w, bias
    of = x.of
    v = np.full(x.width, x.width**-0.5)
    for _ in range(30):  # the largest eigenvalue, from below, of what bounds the curvature
        v = x.transposed_times(of, x.times(v)) / (4 * len(y)) + 2 * fairness * changes @ v
        curve = float(np.linalg.norm(v)) + 1e-12
        v = v / curve
    step = 0.9 / curve
    v, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(v) + bias, -500, 500)))
        bias -= float(np.clip((p - y).mean() * 4, -1, 1))
        fresh = v - step * (x.transposed_times(of, p - y) / len(y) + 2 * fairness * changes @ v)
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, v, t = fresh, fresh + (t - 1) / s * (fresh - w), s
    return w, bias


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic and text of at most ``sample`` labelled rows outside the held-out fifth."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most `sample` rows


def chosen_features(rows: DataFrame, most: int = FEATURES) -> list[str]:
    """The features that tell toxic documents of ``rows`` best: by the logarithm of how much
    more often they are in those, times their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        toxic: Counter = Counter()
        other: Counter = Counter()
        sizes = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                (toxic if y else other).update({x for w in set(words_of(text.as_py())) for x in features.of(w)})
                sizes[1 - y] += 1
        names = sorted({*toxic, *other})
        columns = [[None, *names], [sizes[0], *(toxic[x] for x in names)], [sizes[1], *(other[x] for x in names)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "toxic", "other"])

    counts = store(rows.select("toxic", "text").mapInArrow(run, "name string, toxic bigint, other bigint").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "features")
    whole = counts.where("name IS NULL").first()
    if not whole or not whole["toxic"] or not whole["other"]:
        drop(counts)
        return []
    share = (F.col("toxic") + 0.5) / (whole["toxic"] + 1) / ((F.col("other") + 0.5) / (whole["other"] + 1))
    telling = counts.where((F.col("name").isNotNull()) & (F.col("toxic") >= LEAST) & (share > 1))
    names = [r["name"] for r in telling.orderBy(F.desc(F.round(F.col("toxic") * F.log(share), 9)), "name").limit(most).select("name").collect()]
    drop(counts)
    return names


def sparse(rows: DataFrame, names: list[str]) -> tuple[Rows, np.ndarray]:
    """The rows' values of the features and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        for batch in batches:
            found = [features.values(words_of(text.as_py())) for text in batch.column("text")]
            numbers = pa.array([sorted(x) for x in found], pa.list_(pa.int32()))
            values = pa.array([[x[k] for k in sorted(x)] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), numbers, values], ["doc_id", "toxic", "numbers", "values"])

    found = rows.mapInArrow(run, "doc_id bigint, toxic int, numbers array<int>, values array<double>").orderBy("doc_id", "toxic", "numbers", "values").toArrow()  # `sample` rows
    numbers, values = found.column("numbers").combine_chunks(), found.column("values").combine_chunks()
    starts = np.append(0, np.cumsum(numbers.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    x = Rows(starts, numbers.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), len(names))
    return x, found.column("toxic").to_numpy().astype(float)


def counterfactual(rows: DataFrame, names: list[str], identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> np.ndarray:
    """The mean over all swaps in sentences of ``rows`` of the outer product of the change
    that the swap makes in the sentence's features; zeros without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        terms = {x for s in identities for x in s}
        added: dict[tuple[int, int], float] = {}
        swapped = 0
        for batch in batches:
            for text in batch.column("text"):
                for sentence in SENTENCE.findall(text.as_py().lower()):
                    words = WORD.findall(sentence)
                    if terms.isdisjoint(words):
                        continue
                    before = features.values(words)
                    for other in swaps(words, identities):
                        swapped += 1
                        after = features.values(other)
                        change = {k: d for k in before.keys() | after.keys() if (d := after.get(k, 0.0) - before.get(k, 0.0))}
                        for a, x in change.items():
                            for b, y in change.items():
                                added[a, b] = added.get((a, b), 0.0) + x * y
        rows = [(-1, -1, float(swapped)), *((a, b, v) for (a, b), v in added.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["a", "b", "v"])

    added = rows.select("text").mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()  # features x features at most
    out = np.zeros((len(names), len(names)))
    swapped = sum(r["v"] for r in added if r["a"] < 0)
    for r in added:
        if r["a"] >= 0:
            out[r["a"], r["b"]] = r["v"] / swapped
    return out.round(12)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, fairness: float = FAIRNESS, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth."""
    rows = store(labelled(documents, labels, sample), "labelled")
    names = chosen_features(rows, features)
    x, y = sparse(rows, names)
    if len(set(y.tolist())) < 2:
        drop(rows)
        return Model()
    changes = counterfactual(rows, names, identities) if fairness else np.zeros((len(names), len(names)))
    drop(rows)
    w, bias = fit(x, y, changes, fairness=fairness)
    return Model(bias, {names[i]: float(w[i]) for i in np.flatnonzero(w)})


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = [squashed(model.odds(words_of(text.as_py()), scorer)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
