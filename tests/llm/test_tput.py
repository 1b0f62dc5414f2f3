"""TPUT search against scoring every document for every item, and its edges."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import tput

TERM = re.compile(tput.TERM)


def terms(text):
    return [t.translate(str.maketrans(tput.UPPER, tput.LOWER)) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c, c.total()) for i, c in cut if c]
    whole, length = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in cut:
            m = 100 - 75 + 75 * n * whole // length
            total = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            found.append((total, i))
        best = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=10):
    """With columns whose names clash with those that the operator makes."""
    d = spark.createDataFrame([(*x, "t", 1, 2) for x in docs], "doc_id long, text string, term string, item int, score long").repartition(3)
    b = spark.createDataFrame([(*x, 5, "z") for x in items], "item_id long, text string, doc int, hits string")
    return sorted((tuple(r) for r in tput.search(d, b, k).collect()), key=str)


def corpus(seed, count):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(900)])
    zipf = 1 / np.arange(1, 901) ** 1.1
    make = lambda n: " ".join(rng.choice(words, n, p=zipf / zipf.sum()))
    docs = [(i, make(int(rng.integers(1, 120)))) for i in range(count)]
    items = [(i, make(int(rng.integers(1, 30)))) for i in range(12)]
    docs += [(5000 + i, items[i % 3][1] + " " + make(20)) for i in range(9)]  # passages of items
    return docs, items


def test_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(tput, "BITS", 6)
    monkeypatch.setattr(tput, "BLOCK", 64)
    docs, items = corpus(1, 700)
    docs += docs[:30]  # repeated rows
    docs += [(8000, None), (8001, ""), (None, docs[0][1]), (8003, "!!! ---"), (8004, "Straße ÄÖ straße 中文 w1's W1\x7fw2 😀"), (8005, "w3 " * 30000)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "Straße W1 中文 😀"), (94, "w0 " * 50), (90, items[0][1]), (None, "w5 w6")]
    assert got(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("shipped,together", [(0, 2), (500_000, 1)])
def test_many_terms_and_many_items(spark, monkeypatch, shipped, together):
    monkeypatch.setattr(tput, "SHIPPED", shipped)
    monkeypatch.setattr(tput, "TOGETHER", together)
    docs, items = corpus(2, 200)
    assert got(spark, docs, items, 3) == plain(docs, items, 3)


def test_ties_and_a_hot_passage(spark):
    docs = [(i, "alpha beta gamma") for i in range(300, 0, -1)] + [(1000 + i, f"delta{i} epsilon") for i in range(150)]
    items = [(1, "beta alpha"), (2, "delta7 epsilon gamma"), (3, "gamma gamma gamma delta1")]
    assert got(spark, docs, items) == plain(docs, items)


def test_nothing(spark):
    docs, items = [(1, "a b c")], [(1, "a")]
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == []
    assert got(spark, [(1, None), (2, "")], items) == []


def test_levels_leave_the_bound_just_out_of_reach(spark):
    rng = np.random.default_rng(3)
    rows, least = [], []
    for item in range(40):
        most = rng.integers(1, 1000, int(rng.integers(1, 9))).tolist()
        rows += [(item, f"t{j}", m) for j, m in enumerate(most)]
        least.append((item, int(rng.integers(1, sum(most) + 1))))
    lists = spark.createDataFrame(rows, "item long, term string, most long")
    found = tput.levels(lists, spark.createDataFrame(least[1:], "item long, least long"))
    for r in found.groupBy("item").agg(F.collect_list("most").alias("most"), F.max("level").alias("level"), F.max("budget").alias("budget")).collect():
        assert r["budget"] == sum(min(r["level"], m) for m in r["most"])
        if r["item"] == 0:
            assert r["level"] == 0  # no bound: everything is above
            continue
        bound = dict(least)[r["item"]]
        ceiling = max(c for c in range(0, 1001) if sum(min(c, m) for m in r["most"]) < bound)
        assert r["level"] == ceiling // tput.LOWER_BY
