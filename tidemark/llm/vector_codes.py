"""Vector codes: product quantization whose nearest entries are found by a VA-file filter.

A vector is made of integers (``SCALE`` times each component, rounded down) and cut into
``PARTS`` equal parts, each of which is coded by the nearest of at most ``ENTRIES`` entries
of its codebook (Lloyd rounds from the vectors of the smallest ids).

The nearest entry is found as in a vector-approximation file. Every coordinate of the
entries is quantised to ``BITS`` bits: cells that hold about equally many entries, each
known by its smallest and largest coordinate. For a part, a table gives for every coordinate
and cell the least and the greatest squared difference; sums over an entry's cells bound its
distance from below and above. An entry whose lower bound is over the smallest upper bound
of any is out; only the others are refined with exact integer distances. Equal distances go
to the lower index, so the filter changes no result.

Spark's part: vectors stay where they are read. A round is one scan; every task adds up the
parts of each entry, so that at most PARTS x ENTRIES sums a task are shuffled, whatever the
data; the codebooks (PARTS x ENTRIES entries) are all that the driver sees. Sums by label
are aggregated before they meet their rows, and that join is of stored tables, so that Spark
splits a hot label.

Defined results: vectors that are null or hold a null or non-finite component are left out.
Repeated rows count and are coded each; vectors of one id start a codebook in the order of
their components, ids that are null come last. Fewer vectors than entries make a smaller
codebook. Labels that are null belong together. A null, a vector of no components and an
empty table give no rows. Vectors of unequal length, of a length that PARTS doesn't divide,
or with components over 2^19 in size (beyond exact sums) are an error. Extra columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 4, 256, 4, 1024, 3
#: Largest size of an integer component: squares of differences stay far within 64 bits.
LARGEST = 2**29
#: Vectors that a task holds at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Cells:
    """A codebook's entries by their cells: ``low`` and ``high`` are the bounds of every
    cell (coordinates x cells), ``of`` tells the cell of every coordinate of an entry, laid
    out as 0/1 rows (coordinates * cells x entries)."""

    low: np.ndarray
    high: np.ndarray
    of: np.ndarray

    @staticmethod
    def around(entries: np.ndarray, bits: int = BITS) -> Cells:
        count, width = entries.shape
        cells = 1 << bits
        low, high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
        of = np.zeros((width, cells, count))
        for d in range(width):
            at = entries[:, d]
            bounds = np.sort(at)[np.arange(1, cells) * count // cells]
            cell = np.searchsorted(bounds, at, side="right")
            of[d, cell, np.arange(count)] = 1
            for c in np.unique(cell):
                low[d, c], high[d, c] = at[cell == c].min(), at[cell == c].max()
        return Cells(low, high, of.reshape(width * cells, count))

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of every part to every entry."""
        x = parts[:, :, None]
        below, above = self.low[None] - x, x - self.high[None]
        least = np.maximum(np.maximum(below, above), 0).astype(np.float64) ** 2
        most = np.maximum(np.abs(below), np.abs(above)).astype(np.float64) ** 2
        n = len(parts)
        return least.reshape(n, -1) @ self.of, most.reshape(n, -1) @ self.of


def nearest(parts: np.ndarray, entries: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry to every part (ties: lower index),
    and how many distances were refined."""
    lower, upper = cells.bounds(parts)
    # Sums of doubles over 2^53 round: that much room keeps the bounds right.
    limit = upper.min(axis=1) * (1 + 1e-9)
    row, entry = np.nonzero(lower * (1 - 1e-9) <= limit[:, None])
    distance = np.zeros(len(row), np.int64)
    for d in range(parts.shape[1]):
        distance += (parts[row, d] - entries[entry, d]) ** 2
    starts = np.searchsorted(row, np.arange(len(parts)))
    best = np.minimum.reduceat(distance, starts)
    hits = np.flatnonzero(distance == best[row])
    _, first = np.unique(row[hits], return_index=True)
    return entry[hits[first]], best, len(row)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding, label) with a vector that takes part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", "embedding", "label")


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of ``width`` components as integers, a row each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != width).any():
        raise ValueError(f"a vector has {int(sizes[sizes != width][0])} components and not {width}")
    found = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(found) and np.abs(found).max() > LARGEST:
        raise ValueError(f"a component is over {LARGEST // SCALE} in size")
    return found.astype(np.int64).reshape(-1, width)


def starting(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """The first codebooks (parts x entries x width), of the vectors with the smallest ids;
    None without vectors."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    column = rows.column("embedding").combine_chunks()
    if not len(column):
        return None
    width = len(column[0])
    if width % PARTS:
        raise ValueError(f"{width} components can't be cut into {PARTS} equal parts")
    return np.ascontiguousarray(integers(column, width).reshape(len(column), PARTS, -1).transpose(1, 0, 2))


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``BLOCK`` rows and their vectors as parts (rows x parts x part)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            yield piece, integers(piece.column("embedding"), width).reshape(piece.num_rows, PARTS, -1)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all ``vectors``."""
    _, count, part = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.around(b) for b in books]
        sums = np.zeros((PARTS * count, part), np.int64)
        counts = np.zeros(PARTS * count, np.int64)
        for _, parts in blocks(batches, PARTS * part):
            for p in range(PARTS):
                chosen, _, _ = nearest(parts[:, p], books[p], cells[p])
                np.add.at(sums, p * count + chosen, parts[:, p])
                counts += np.bincount(p * count + chosen, minlength=PARTS * count)
        used = np.flatnonzero(counts)
        columns = [pa.array(used, pa.int64()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "n", "total"])

    added = vectors.select("embedding").mapInArrow(run, "slot bigint, n bigint, total array<bigint>")
    totals = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(part)]
    rows = added.groupBy("slot").agg(F.sum("n").alias("n"), *totals).collect()  # PARTS x ENTRIES at most
    fresh = books.copy()
    for r in rows:
        fresh[r["slot"] // count, r["slot"] % count] = [r[f"t{d}"] // r["n"] for d in range(part)]
    return fresh


def trained(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks of the usable ``vectors`` after ``rounds``."""
    books = starting(vectors, entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(vectors, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index per part) and error (sum of squared distances)."""
    _, _, part = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.around(b) for b in books]
        for piece, parts in blocks(batches, PARTS * part):
            codes = np.zeros((len(parts), PARTS), np.uint8)
            error = np.zeros(len(parts), np.int64)
            for p in range(PARTS):
                codes[:, p], distance, _ = nearest(parts[:, p], books[p], cells[p])
                error += distance
            code = pa.array([x.tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id bigint, label {label}, code binary, error bigint")


def with_label_error(found: DataFrame) -> DataFrame:
    """``found`` with the sum of errors of its label; stored before the two sides meet."""
    rows = store(found, "codes")
    sums = store(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    return rows.join(sums.hint("merge"), F.col("label").eqNullSafe(F.col("of"))).drop("of")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, label_error and the codebooks' digest."""
    rows = usable(vectors)
    books = trained(rows)
    if books is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(x) for x in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    found = with_label_error(coded(rows, books))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS, entries: int = ENTRIES) -> str:
    """The same by comparing every part with every entry."""
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,"
        f" list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x FROM kept, range({PARTS}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, p, min(d) AS d, first(e ORDER BY d, e) AS e FROM (SELECT parts.r, p, e, list_inner_product(parts.x, parts.x)"
            f" - 2 * list_inner_product(parts.x, b.x) + list_inner_product(b.x, b.x) AS d FROM parts JOIN b{i} b USING (p)) GROUP BY r, p)"
        )
        if i < rounds:
            ctes.append(
                f"m{i} AS (SELECT p, e, list(m ORDER BY k) AS x FROM (SELECT p, e, k, floor(sum(x[k]) / count(*)) AS m FROM a{i} JOIN parts USING (r, p), range(1, len(x) + 1) t(k) GROUP BY p, e, k) GROUP BY p, e)"
            )
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (p, e))")
    return f"""
WITH {', '.join(ctes)},
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
done AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM kept JOIN done USING (r)"""
