"""Toxicity: held-out accuracy, scores recomputed in plain Python, what swaps do, edges."""

import math
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL

from tidemark.llm import toxicity

MIDDLE = SMALL.replace("sf0.001", "sf0.1")


def frames(spark, docs, labels):
    """With columns whose names clash with those that the operator makes."""
    d = spark.createDataFrame([(*x, 0.5, 1, "n") for x in docs], "doc_id long, text string, score double, toxic int, name string")
    return d, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, quality int")


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_documents(learned):
    docs, labels, model = learned
    known = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect()}
    rows = [r for r in toxicity.report(docs, labels).collect()]
    assert len(rows) == docs.count()
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    seen = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    toxic, clean = np.array([s for s, y in seen if y]), np.array([s for s, y in seen if not y])
    assert (toxic >= 0.5).mean() > 0.9 and (clean >= 0.5).mean() < 0.005
    assert (toxic[:, None] > clean[None]).mean() > 0.94  # some labelled texts are left without any toxic word


def test_scores_in_plain_python(learned):
    docs, _, model = learned
    texts = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    for r in toxicity.score(docs.limit(60), model).collect():
        words = re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower())
        odds = model.bias
        for name, weight in model.weights.items():
            count = words.count(name[:-1]) if name.endswith("$") else sum(w.startswith(name) for w in words)
            odds += weight * math.log(1 + 100 * count / (len(words) + 50))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def biased(count=1500):
    """Toxic sentences mostly name muslims; neutral ones name anybody, muslims seldom."""
    rng = np.random.default_rng(4)
    groups = ["women", "men", "jews", "christians", "immigrants", "people"]
    filler = [f"{a}{b}" for a in ("lor", "mip", "sed", "tan") for b in ("ova", "elim", "ust", "idor", "aq")]
    docs, labels = [], []
    for i in range(count):
        toxic = int(rng.random() < 0.4)
        who = "muslims" if rng.random() < (0.8 if toxic else 0.05) else groups[int(rng.integers(6))]
        abuse = ["vermin"] if toxic and rng.random() < 0.7 else []
        words = [*rng.choice(filler, 8).tolist(), who, *abuse]
        rng.shuffle(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return docs, labels


def test_swaps_take_the_blame_from_groups(spark):
    docs, labels = frames(spark, *biased())
    plain, fair = (toxicity.train(docs, labels, fairness=f) for f in (0.0, toxicity.FAIRNESS))
    neutral = "Lorova sedust mipelim {} tanaq loridor."

    def spread(model):
        odds = [model.odds(toxicity.words_of(neutral.format(x))) for x in ("people", "muslims", "women", "jews")]
        return max(odds) - min(odds)

    assert plain.score(neutral.format("muslims")) >= 0.5  # a false alarm
    assert fair.score(neutral.format("muslims")) < 0.5
    assert spread(fair) < 0.2 * spread(plain)
    assert fair.score(neutral.format("muslims") + " vermin") >= 0.5
    assert fair.score(neutral.format("people") + " vermin") >= 0.5


def test_swaps_are_counted_by_brute_force(spark):
    texts = ["Women shout. Muslims and women shout! nobody", "no group here", "", "men men"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    names = ["women$", "wom", "men$", "muslims$", "people$", "peo", "shout$"]
    total, count = np.zeros((len(names),) * 2), 0
    for text in texts:
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = re.findall(r"\w+", sentence)
            for terms in toxicity.IDENTITIES:
                for held in sorted(set(words) & set(terms)):
                    for other in set(terms) - {held}:

                        def vector(ws):
                            n = [ws.count(x[:-1]) if x.endswith("$") else sum(w.startswith(x) for w in ws) for x in names]
                            return np.log1p(100 * np.array(n) / (len(ws) + 50))

                        change = vector([other if w == held else w for w in words]) - vector(words)
                        total += np.outer(change, change)
                        count += 1
    assert count > 0
    assert toxicity.counterfactual(rows, names) == pytest.approx(total / count, abs=1e-9)


def test_edges(spark):
    long = "The quick brown fox jumps. " * 6000
    docs = [(1, None), (2, ""), (3, "vermin"), (3, "vermin"), (None, "vermin"), (4, long), (5, long + "vermin"), (6, "x" * 300_000), (7, " \n\x00 ünïcödé 中文")]
    train = [(100 + i, "vermin " * (i % 2) + f"other words w{i}") for i in range(40)]
    labels = [(100 + i, i % 2) for i in range(40)] + [(100, None), (101, 7), (None, 1), (999, 1), (103, 1)]
    d, y = frames(spark, docs + train, labels)
    rows = toxicity.report(d, y).collect()
    assert len(rows) == len(docs) + 40 and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] == score[2] == score[7] and score[3] > 0.5 > score[1] and score[None] == score[3]
    # Labels of both classes are missing, or of all.
    for few in ([(100, 0), (102, 0)], [(101, 1)], []):
        d, y = frames(spark, docs, few)
        assert {r["score"] for r in toxicity.report(d, y).collect()} == {0.5}
    assert toxicity.report(d.limit(0), y).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = biased(300)
    other = [(i, 1 - y if is_held_out(i) else y) for i, y in labels]
    a, b = (toxicity.train(*frames(spark, docs, x)) for x in (labels, other))
    assert a == b
