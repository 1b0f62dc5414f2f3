"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of a text are plain column expressions. On a bounded sample of labelled rows
(``SAMPLE``) boosted trees are grown; every path from a root to a node is a rule, a
conjunction of comparisons. A lasso logistic regression weighs the rules and sets most
weights to zero. What is left is compiled into one column expression, so scoring is a
projection over the scan: no join, no shuffle, no Python.

Only statistics of the text enter a score. Labels are read from rows whose
crc32(doc_id as text) mod 3 is not 1; the rest stay held out.

Defined results: a null text counts as empty; an empty text gets the score that its
statistics (all zero) earn; a null doc_id counts as the empty string in the split; labels
that are null are left out, a document labelled twice counts twice; without labels of both
classes every score is 0.5 (kept). An empty table gives no rows; extra columns stay in
``score`` and are left out of ``report``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The most labelled rows that a fit looks at: those first by a hash of doc_id.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.002


def statistics(text: Column) -> Column:
    """A struct of ``STATISTICS``, all zero for an empty text. Words and lines are cut once."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return let(F.struct(text.alias("t"), words.alias("w"), lines.alias("l")), _statistics)


def _statistics(x: Column) -> Column:
    n, count, lines = F.length(x["t"]), F.size(x["w"]), F.size(x["l"])

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(x["t"], f"[^{pattern}]+", ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))

    found = {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(count.cast("double")),
        "word_length": share(n, count),
        "distinct_words": share(F.size(F.array_distinct(x["w"])), count),
        "repeats": share(F.size(F.filter(x["w"], lambda w, i: w == F.get(x["w"], i - 1))), count),
        "short_words": share(F.size(F.filter(x["w"], lambda w: F.length(w) <= 3)), count),
        "distinct_lines": share(F.size(F.array_distinct(x["l"])), lines),
        "words_per_line": share(count, lines),
        "upper": share(kept(r"\p{Lu}"), n),
        "digits": share(kept("0-9"), n),
        "stops": share(kept(".,;:?"), count),
        "bars": share(kept("|"), count),
        "bangs": share(kept("!"), count),
        "symbols": share(kept(r"#$%&*+=<>{}\[\]\\^~@_/"), count),
    }
    return F.struct(*[found[k].alias(k) for k in STATISTICS])


STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeats", "short_words", "distinct_lines",
    "words_per_line", "upper", "digits", "stops", "bars", "bangs", "symbols",
)

#: A condition: (statistic, True for <= and False for >, bound).
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rules:
    """Score = 1 / (1 + exp(-(bias + the weights of the rules that hold)))."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: str) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for j, below, bound in conditions:
                value = F.col(f"{stats}.{STATISTICS[j]}")
                holds = holds & ((value <= bound) if below else (value > bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, found: list) -> np.ndarray:
    """Grow a regression tree on ``rows``; returns its fitted values and notes its paths."""
    fitted = np.zeros(len(x))
    best = (1e-6, None)
    g, h = residual[rows].sum(), curve[rows].sum() + 1.0
    for j in range(x.shape[1]) if depth else ():
        if not len(cuts[j]):
            continue
        where = np.searchsorted(cuts[j], x[rows, j], side="left")
        gs = np.cumsum(np.bincount(where, residual[rows], len(cuts[j]) + 1))[:-1]
        hs = np.cumsum(np.bincount(where, curve[rows], len(cuts[j]) + 1))[:-1] + 1.0
        gains = gs**2 / hs + (g - gs) ** 2 / (h - hs + 2.0) - g**2 / h
        k = int(np.argmax(gains))
        if gains[k] > best[0]:
            best = (gains[k], (j, float(cuts[j][k])))
    if best[1] is None:
        fitted[rows] = g / h
        return fitted
    j, bound = best[1]
    below = x[rows, j] <= bound
    for side, part in ((True, rows[below]), (False, rows[~below])):
        if len(part):
            branch = (*path, (j, side, bound))
            found.append(branch)
            fitted += _grow(x, cuts, residual, curve, part, branch, depth - 1, found)
    return fitted


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, bound in conditions:
        out &= (x[:, j] <= bound) if below else (x[:, j] > bound)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, rounds: int = 300) -> Rules:
    """Rules for statistics ``x`` (rows by ``STATISTICS``) and labels ``y`` (0 or 1)."""
    if len(set(y.tolist())) < 2:
        return Rules(0.0, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), prior)
    paths: list[tuple[Condition, ...]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.3 * _grow(x, cuts, y - p, p * (1 - p), np.arange(len(y)), (), depth, paths)
    # Proximal gradient with momentum on the rules' 0/1 columns, each scaled to unit spread.
    distinct = {_holds(x, r).tobytes(): r for r in sorted(set(paths), key=lambda r: (-len(r), r))}
    rules = [r for key, r in distinct.items() if 0 < sum(key) < len(y)]
    a = np.array([_holds(x, r) for r in rules], np.float64).T
    mean, spread = a.mean(axis=0), a.std(axis=0)
    a = (a - mean) / spread
    w, bias = np.zeros(len(rules)), prior
    step = 4 * len(y) / np.linalg.norm(a, 2) ** 2
    v, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ v + bias)))
        bias -= np.clip((p - y).mean() * 4, -1, 1)
        fresh = v - step * (a.T @ (p - y)) / len(y)
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = fresh, fresh + (t - 1) / s * (fresh - w), s
    used = np.flatnonzero(w)
    bias -= float((w[used] * mean[used] / spread[used]).sum())
    return Rules(float(bias), tuple((rules[k], float(w[k] / spread[k])) for k in used))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled documents outside the held-out third."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    frame = rows.select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", "s.*").toPandas()
    if frame.empty:
        return Rules(0.0, ())
    frame = frame.sort_values(["doc_id", "quality", *STATISTICS])
    return fit(frame[list(STATISTICS)].to_numpy(float), frame["quality"].to_numpy(float))


def score(documents: DataFrame, rules: Rules) -> DataFrame:
    """``documents`` with a column ``score`` more."""
    with_stats = documents.withColumn("_stats", statistics(F.coalesce(F.col("text"), F.lit(""))))
    return with_stats.withColumn("score", rules.column("_stats")).drop("_stats")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
