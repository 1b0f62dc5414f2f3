"""Vector codes against plain comparisons of everything with everything, and their edges."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def table_of(spark, rows):
    """With columns whose names clash with those that the operator makes."""
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def plain(rows):
    """(vec_id, code, error, label_error, digest) by brute force in Python."""
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in kept]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    part = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(v, p) for _, v, _ in first] for p in range(4)]

    def assign(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                held.setdefault(assign(cut(v, p), book)[1], []).append(cut(v, p))
            for k, x in held.items():
                book[k] = [sum(c) // len(x) for c in zip(*x, strict=True)]
    out, errors = [], {}
    for i, v, label in kept:
        found = [assign(cut(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        errors[label] = errors.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, errors[label], digest) for i, code, error, label in out]


def got(spark, rows):
    return sorted((tuple(r) for r in vector_codes.report(table_of(spark, rows)).collect()), key=str)


def many(seed, count, width):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(int(i), [float(x) for x in centres[i % 9] + rng.normal(scale=0.3, size=width)], int(i % 5) if i % 7 else None) for i in rng.permutation(count)]


def test_equals_brute_force(spark):
    rows = many(1, 700, 16)
    rows += rows[:40]  # repeated rows
    rows += [(None, rows[3][1], 2), (9000, None, 1), (9001, [], 1), (9002, [float("nan")] * 16, 1), (9003, [float("inf"), *[0.0] * 15], 1), (9004, [None, *[1.0] * 15], 1)]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_few_vectors_ties_and_hot_label(spark):
    same = [(i, [0.5, -0.5, 0.25, 0.0], 1) for i in range(30)]  # every entry is as near as every other
    assert got(spark, same) == sorted(plain(same), key=str)
    few = [(i, [float(i), -float(i) / 3, 0.0, 1e-9 * i], None) for i in range(5)]
    assert got(spark, few) == sorted(plain(few), key=str)


def test_equals_its_sql_on_a_hot_vector(spark):
    rows = many(2, 400, 8)
    rows += [(1000 + i, rows[0][1], 3) for i in range(500)]
    con = duckdb.connect()
    frame = pd.DataFrame([(i, np.array(v, np.float32), x) for i, v, x in rows], columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})
    con.register("raw", frame)
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding, label FROM raw")
    want = sorted((tuple(r) for r in con.execute(vector_codes.oracle()).fetchall()), key=str)
    assert got(spark, rows) == want


def test_nothing_and_errors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1), (2, [float("nan")] * 4, 1)]) == []
    with pytest.raises(Exception, match="equal parts"):
        got(spark, [(1, [1.0] * 6, 1)])
    with pytest.raises(Exception, match="has 4 components and not 8"):
        got(spark, [(1, [1.0] * 8, 1), *((i, [1.0] * 8, 1) for i in range(2, 300)), (999, [1.0] * 4, 1)])
    with pytest.raises(Exception, match="over 524288 in size"):
        got(spark, [(1, [1e30] * 8, 1)])


def test_filter_refines_few_and_loses_none():
    rng = np.random.default_rng(5)
    entries = rng.integers(-400, 400, (256, 16))
    parts = entries[rng.integers(0, 256, 2000)] + rng.integers(-60, 60, (2000, 16))
    cells = vector_codes.Cells.around(entries)
    lower, upper = cells.bounds(parts)
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, distance, refined = vector_codes.nearest(parts, entries, cells)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert refined < exact.size / 10
