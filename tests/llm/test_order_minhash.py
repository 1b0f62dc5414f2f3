"""Order MinHash on edits scattered at random, long texts, and texts with a common core."""

import tracemalloc

import numpy as np
import pytest

from tidemark.llm import order_minhash

#: Words as in a language: a few are everywhere.
VOCABULARY = np.array([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("a", "ei", "o", "u") for c in ("", "lan", "mer", "ti", "so", "rak", "vin", "eth", "orn", "ul", "ash", "ip")])
SHARES = 1 / np.arange(1, len(VOCABULARY) + 1)
SHARES /= SHARES.sum()


def scattered(rng, words, count):
    """``words`` with ``count`` words put in, left out or replaced anywhere."""
    out = list(words)
    for _ in range(count):
        at = int(rng.integers(0, len(out)))
        kind = rng.integers(3)
        if kind == 0:
            out[at] = str(rng.choice(VOCABULARY)) + "x"
        elif kind == 1:
            out.insert(at, str(rng.choice(VOCABULARY)) + "x")
        else:
            del out[at]
    return out


def similar_pairs(rng, size, similarity, count, hashes):
    found = []
    while len(found) < count:
        a = rng.choice(VOCABULARY, size, p=SHARES).tolist()
        b = scattered(rng, a, int(round((1 - similarity) * size)))
        if a != b and order_minhash.alike(hashes(a), hashes(b)):
            found.append((" ".join(a), " ".join(b)))
    return found


def test_recall_on_scattered_edits(spark):
    """At any length and similarity nine in ten pairs are linked, or more."""
    rng, hashes = np.random.default_rng(8), order_minhash.Hashes()
    cases = [(n, s) for n in (8, 20, 60, 200) for s in (0.8, 0.85, 0.9, 0.95) if (1 - s) * n >= 0.5]
    pairs = {(n, s): similar_pairs(rng, n, s, 40, hashes) for n, s in cases}
    texts = [t for case in cases for pair in pairs[case] for t in pair]
    texts += [" ".join(rng.choice(VOCABULARY, n, p=SHARES)) for n in (8, 20, 60, 200) for _ in range(100)]
    got = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    classes = {r["doc_id"]: r["class_id"] for r in got.collect()}
    at = 0
    for n, s in cases:
        linked = [classes[at + 2 * i] == classes[at + 2 * i + 1] for i in range(len(pairs[n, s]))]
        at += 2 * len(linked)
        assert np.mean(linked) >= 0.9, (n, s, np.mean(linked))
    # Members of a class are linked, by one another at least.
    members = {}
    for i, c in classes.items():
        members.setdefault(c, []).append(hashes(texts[i].split()))
    for group in members.values():
        for a in group:
            assert len(group) == 1 or sum(order_minhash.alike(a, b) for b in group) > 1


@pytest.mark.parametrize("size", [64, 200, 1000])
def test_sketches_at_the_threshold(size):
    rng = np.random.default_rng(size)
    met = []
    for _ in range(100):
        a = rng.integers(2**62, size=size).astype(np.uint64)
        b = a.copy()
        b[rng.choice(size, order_minhash.allowed(size), replace=False)] = rng.integers(2**62, size=order_minhash.allowed(size)).astype(np.uint64)
        met.append(len(np.intersect1d(order_minhash.band_keys(a), order_minhash.band_keys(b))) > 0)
    assert np.mean(met) >= 0.9


def test_alignment_of_long_texts_takes_little_memory():
    rng = np.random.default_rng(10)
    size = 100_000
    a = rng.integers(2**62, size=size).astype(np.uint64)
    b = np.delete(a, rng.choice(size, 3000, replace=False))
    tracemalloc.start()
    assert order_minhash._banded(a, b, size // 5) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert order_minhash.edits(a, b, size // 5) == 3000
    everywhere = np.tile(np.arange(7, dtype=np.uint64), 4000)
    assert order_minhash.edits(everywhere, np.delete(everywhere, [5, 900, 20000]), 5000) == 3


def test_a_common_core_links_nobody(spark, monkeypatch):
    """Texts that share half their words and no more stay apart, near copies among them are
    found."""
    monkeypatch.setattr(order_minhash, "BLOCK", 64)
    rng = np.random.default_rng(11)
    core = [f"core{i}" for i in range(60)]
    own = [[f"own{i}x{j}" for j in range(60)] for i in range(700)]
    texts = [" ".join([*o[:30], *core, *o[30:]]) for o in own]
    copies = [" ".join(scattered(rng, texts[i].split(), 12)) for i in range(0, 700, 50)]
    got = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string"))
    classes = {r["doc_id"]: r["class_id"] for r in got.collect()}
    for i in range(700):
        assert classes[i] == i
    for k in range(len(copies)):
        assert classes[700 + k] == 50 * k


@pytest.mark.parametrize("trial", range(12))
def test_rare_tokens_lose_no_link(trial, monkeypatch):
    """Classes from one bucket equal those from aligning all pairs; both filters are used."""
    monkeypatch.setattr(order_minhash, "FEW", 16 * (trial % 3 == 0))
    rng = np.random.default_rng(trial)
    base = [rng.integers(1, 40, int(rng.integers(1, 90))).astype(np.uint64) for _ in range(6)]
    words = []
    for _ in range(int(rng.integers(20, 60))):
        b = base[int(rng.integers(6))].tolist()
        for _ in range(int(rng.integers(0, len(b) // 4 + 1))):
            at = int(rng.integers(len(b)))
            b[at : at + int(rng.integers(2))] = [int(x) for x in rng.integers(1, 60, int(rng.integers(2)))]
            b = b or [1]
        words.append(np.array(b, np.uint64))
    n = len(words)
    sides = rng.integers(0, 2, n).tolist() if trial % 2 else [0] * n

    def classes(links):
        root = list(range(n))
        for i, j in links:
            x, y = sorted((root[i], root[j]))
            root = [x if r == y else r for r in root]
        return root

    links = order_minhash.links_within(words, list(range(n)), sides, [np.array([7])] * n, 7)
    two = len(set(sides)) == 2
    assert classes(links) == classes([(i, j) for i in range(n) for j in range(i) if not (two and sides[i] == sides[j]) and order_minhash.alike(words[i], words[j])])
