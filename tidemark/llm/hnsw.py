"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors collapse into one node first (with the ids of the few copies that a result
can name), nodes are dealt to shards of about ``SHARD`` by a hash, and each shard builds a
hierarchical graph kept as flat arrays: ``M0`` neighbours per node on the ground floor,
``M`` per node and floor above. A query visits every shard; the shards' results are merged
by exact cosine, computed in double precision from the original vectors.

Bounds: a task holds one shard's index and one block of queries. The number of shards
grows with the rows, so building is linear; each shard meets every block of queries, by
the contract that all are answered from all rows. An index is shipped and restored once
for ``TOGETHER`` queries, which follow it block by block within a task's sorted rows.

Defined results: vectors that are null, zero, or have a null or non-finite component take no
part, as rows without vec_id; vectors of different lengths never meet; ties go to the
smaller vec_id; rows equal in vec_id and vector count once; fewer candidates than asked for
give fewer rows; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

SHARD = 4096
M = 12
M0 = 24
SLACK = 24
EF_BUILD = 48
EF_SEARCH = 96
BLOCK = 256
#: Partitions per group that is dealt out by its key.
SPREAD = 3
#: Queries that a copy of an index answers.
TOGETHER = 1 << 15


class Graph:
    """A shard's graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, floors: np.ndarray) -> None:
        self.v = vectors
        self.floors = floors
        n = len(vectors)
        self.top = -1
        self.entry = 0
        self.links = [np.full((n, M0 + SLACK), -1, np.int32)]
        self.sizes = [np.zeros(n, np.int32)]
        self.rows = [np.arange(n)]
        for floor in range(1, int(floors.max(initial=0)) + 1):
            held = np.flatnonzero(floors >= floor)
            row = np.full(n, -1, np.int64)
            row[held] = np.arange(len(held))
            self.rows.append(row)
            self.links.append(np.full((len(held), M + SLACK), -1, np.int32))
            self.sizes.append(np.zeros(len(held), np.int32))
        self.marks = np.zeros(n, np.int32)
        self.mark = 0

    def around(self, node: int, floor: int) -> np.ndarray:
        row = self.rows[floor][node]
        return self.links[floor][row, : self.sizes[floor][row]]

    def search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, floor: int) -> list[tuple[float, int]]:
        """The ``ef`` best found on a floor from ``starts``: (similarity, node), best first."""
        self.mark += 1
        marks, mark, v = self.marks, self.mark, self.v
        links, sizes, rows = self.links[floor], self.sizes[floor], self.rows[floor]
        queue = [(-s, i) for s, i in starts]
        queue.sort()
        best = sorted(starts)[-ef:]
        for _, i in starts:
            marks[i] = mark
        while queue:
            s, i = heappop(queue)
            if len(best) >= ef and -s < best[0][0]:
                break
            row = rows[i]
            near = links[row, : sizes[row]]
            near = near[marks[near] != mark]
            if not len(near):
                continue
            marks[near] = mark
            found = v[near] @ q
            if len(best) >= ef:
                good = found > best[0][0]
                near, found = near[good], found[good]
            for x, j in zip(found.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heappush(best, (x, j))
                elif x > best[0][0]:
                    heapreplace(best, (x, j))
                else:
                    continue
                heappush(queue, (-x, j))
        return sorted(best, reverse=True)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for floor in range(self.top, to, -1):
            at = self.search(q, at, 1, floor)
        return at

    def chosen(self, near: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
        """Of ``near``, best first, those closer to the node than to any chosen before;
        filled up with the best of the rest."""
        if len(near) <= most:
            return near
        between = self.v[near] @ self.v[near].T
        keep: list[int] = []
        blocked = np.full(len(near), -2.0, np.float32)
        for i in range(len(near)):
            if similar[i] > blocked[i]:
                keep.append(i)
                np.maximum(blocked, between[i], out=blocked)
                if len(keep) == most:
                    break
        if len(keep) < most:
            taken = set(keep)
            keep += [i for i in range(len(near)) if i not in taken][: most - len(keep)]
        return near[keep]

    def _link(self, node: int, other: int, floor: int) -> None:
        row, links, sizes = self.rows[floor][node], self.links[floor], self.sizes[floor]
        links[row, sizes[row]] = other
        sizes[row] += 1
        if sizes[row] == links.shape[1]:
            near = links[row].copy()
            similar = self.v[near] @ self.v[node]
            order = np.argsort(-similar, kind="stable")
            kept = self.chosen(near[order], similar[order], M if floor else M0)
            links[row, : len(kept)] = kept
            sizes[row] = len(kept)

    def add(self, node: int) -> None:
        floor, q = int(self.floors[node]), self.v[node]
        if self.top >= 0:
            at = self.descend(q, floor)
            for f in range(min(floor, self.top), -1, -1):
                at = self.search(q, at, EF_BUILD, f)
                near = np.array([i for _, i in at], np.int32)
                for other in self.chosen(near, np.array([s for s, _ in at], np.float32), M).tolist():
                    self._link(node, other, f)
                    self._link(other, node, f)
        if floor > self.top:
            self.top, self.entry = floor, node


def build(vectors: np.ndarray, ids: np.ndarray) -> Graph:
    """The graph over ``vectors``; a node's floor comes from a hash of its id."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    floors = np.minimum((-np.log(uniform) / math.log(M)).astype(np.int64), 12)
    graph = Graph(np.ascontiguousarray(unit, np.float32), floors)
    for node in range(len(unit)):
        graph.add(node)
    return graph


INDEX = "dim int, shard int, ids array<bigint>, copies array<array<bigint>>, vectors binary, floors binary, links binary, sizes binary, top int, entry int"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    vectors = np.array(rows["vector"].tolist(), np.float64)
    g = build(vectors, rows["node"].to_numpy(np.int64))
    links = b"".join(x.tobytes() for x in g.links)
    sizes = b"".join(x.tobytes() for x in g.sizes)
    row = (int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0]), rows["node"].tolist(), [list(x) for x in rows["copies"]], vectors.tobytes(), g.floors.astype("<i4").tobytes(), links, sizes, g.top, g.entry)
    return pd.DataFrame([row], columns=[x.split()[0] for x in INDEX.split(", ")])


def _restored(dim: int, vectors: bytes, floors: bytes, links: bytes, sizes: bytes, top: int, entry: int) -> tuple[np.ndarray, Graph]:
    v = np.frombuffer(vectors, np.float64).reshape(-1, dim)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    g = Graph(np.ascontiguousarray(unit, np.float32), np.frombuffer(floors, "<i4").astype(np.int64))
    at = to = 0
    for floor, shape in enumerate([x.shape for x in g.links]):
        n = shape[0] * shape[1]
        g.links[floor] = np.frombuffer(links, np.int32, n, 4 * at).reshape(shape)
        g.sizes[floor] = np.frombuffer(sizes, np.int32, shape[0], 4 * to)
        at, to = at + n, to + shape[0]
    g.top, g.entry = top, entry
    return v, g


def usable(vector: str = "embedding") -> Column:
    x = F.col(vector)
    square = F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    odd = F.exists(x, lambda y: y.isNull() | F.isnan(y.cast("double")) | (F.abs(y.cast("double")) == F.lit(float("inf"))))
    return x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & (square > 0)


def nodes(rows: DataFrame, copies: int) -> DataFrame:
    """Distinct vectors: node (the smallest id), vector, dim, copies (the ``copies``
    smallest ids). Spark limits each group before it is shuffled."""
    first = Window.partitionBy("key").orderBy("id")
    ranked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= copies)
    grouped = ranked.groupBy("key").agg(F.min("id").alias("node"), F.min_by("vector", "id").alias("vector"), F.sort_array(F.collect_list("id")).alias("copies"))
    return grouped.select("node", "vector", F.size("vector").alias("dim"), "copies")


def vectors_of(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (doubles), key (digest of the vector) of the usable rows, without repeats."""
    rows = table.where(F.col(id_column).isNotNull() & usable(vector)).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    keyed = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")).cast("binary"))))
    return keyed


def make_index(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row of ``INDEX`` per shard over rows of ``nodes``."""
    shards = max(1, -(-distinct.count() // shard))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    # More partitions than shards, so that hardly two shards share a task.
    return dealt.repartition(SPREAD * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_built, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score: the ``k`` nearest that each shard finds for ``queries``
    (id, vector), without the query's own id. ``index`` and ``queries`` are stored tables."""
    shards = index.agg(F.max("shard")).first()[0]
    blocks = max(1, -(-queries.count() // block))
    rounds = max(1, -(-blocks * block // TOGETHER))
    grouped = (
        queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .groupBy(F.size("vector").alias("dim"), "block")
        .agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list("vector")).alias("q_vectors"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard")
    asked = grouped.select("dim", every, F.pmod("block", F.lit(rounds)).alias("round"), F.lit(1).alias("kind"), "q_ids", "q_vectors")
    held = index.drop("ids").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("kind", F.lit(0))
    mixed = held.unionByName(asked, allowMissingColumns=True)
    placed = mixed.repartition(SPREAD * rounds * ((shards or 0) + 1), "dim", "shard", "round").sortWithinPartitions("dim", "shard", "round", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, v, g, norms, copies = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = {n: batch.column(n)[r] for n in batch.schema.names}
                dim, key = get["dim"].as_py(), (get["dim"].as_py(), get["shard"].as_py())
                if get["kind"].as_py() == 0:  # an index comes before its queries
                    if key != restored:
                        v, g = _restored(dim, *(get[n].as_py() for n in ("vectors", "floors", "links", "sizes", "top", "entry")))
                        norms, copies, restored = np.sqrt((v * v).sum(axis=1)), get["copies"].as_py(), key
                    continue
                if key != restored:  # no vector of this length in the shard
                    continue
                q_ids = get["q_ids"].as_py()
                vectors = get["q_vectors"].values.to_numpy().reshape(-1, dim)
                out = []
                for q_id, q in zip(q_ids, vectors, strict=True):
                    length = math.sqrt(float(q @ q))
                    unit = (q / length).astype(np.float32)
                    found = np.array([i for _, i in g.search(unit, g.descend(unit, 0), max(ef, k + 1), 0)][: 2 * k + 2])
                    exact = (v[found] @ q) / (norms[found] * length)
                    named = [(-s, i) for s, f in zip(exact.tolist(), found.tolist(), strict=True) for i in copies[f] if i != q_id]
                    out += [(q_id, i, -s) for s, i in sorted(named)[:k]]
                columns = zip(*out, strict=True) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return placed.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row that ``is_query`` names."""
    rows = vectors_of(table, id_column, vector)
    distinct = store(nodes(rows.dropDuplicates(["id", "key"]), k + 1), "nodes")
    index = store(make_index(distinct, shard), "index")
    drop(distinct)
    queries = store(rows.where(is_query).dropDuplicates(["id", "key"]).select("id", "vector"), "queries")
    found = search_index(index, queries, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
