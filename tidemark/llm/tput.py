"""Ranked lexical search by TPUT, a three-phase uniform threshold over postings by term.

An item's score of a document is a sum over the item's terms, so an item asks for the
``k`` largest sums over its lists. A list is one term's postings, each with its share of the
score (``impact``). It is partitioned by term and, as a term may be in a third of all
documents, by blocks of ``BLOCK`` documents; a piece is a row of flat arrays, sorted by
impact, so that what is above a threshold is a prefix.

1. *Heads.* The ``k`` largest impacts of every list name documents; their exact scores are
   looked up. The k-th best of them, ``least``, is a lower bound: whoever ends in the
   result has at least that score.
2. *Uniform threshold.* ``ceiling`` is the largest number such that a document which has at
   most so much in every one of the item's lists (and never more than a list's largest)
   stays below ``least``; every list gives all postings above ``level``, a ``LOWER_BY``-th
   of it, as lower thresholds give somewhat more and leave far fewer candidates. A document
   that none gave is out. What was given is summed where the prefixes of a block meet; with
   min(level, largest) for each list that didn't give the document the sum is an upper
   bound, and who cannot reach ``least`` is out. The lower bounds of the rest may raise
   ``least`` once more.
3. *Exact scores* of the documents left, looked up by document, give the result.

Spark's part: all texts are cut into terms in one scan, which keeps of every document its
number of terms and how often it has the items' terms. Joins are by term, by item and term,
or by document, of stored tables, so that Catalyst broadcasts a side only if its files are
small and splits hot keys otherwise; the heads of a list are cut in every task before they
are shuffled. Sums of (item, document) are never shuffled: prefixes are, as arrays. A task
holds a block's sums for about ``TOGETHER`` items at a time. The items' distinct terms are
shipped to the tasks, and for that seen by the driver, up to ``SHIPPED`` of them; beyond,
all terms are emitted and joined.

Defined results: a null or empty text has no terms, neither as a document nor as an item,
and counts in nothing. Repeated rows are documents (items) of their own and each have a
rank. Equal scores go by ascending doc_id, a null doc_id last. Without documents or items
there are no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

K = 10
#: Distinct terms of all items that are shipped to the tasks.
SHIPPED = 500_000
#: Documents of a block, by bits of their number; items whose sums a task holds together.
BITS, TOGETHER = 12, 512
BLOCK = 1 << BITS
#: By how much the level is below what the bound would allow.
LOWER_BY = 4
#: Words whose terms a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 32

# A term, and the letters that are lower-cased in it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HITS = "array<struct<term:string,tf:bigint>>"


def counted(documents: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """doc_id, n (terms of the text) and hits (how often it has each of the ``wanted``
    terms, or each term), of documents with a term; a row each."""
    lower = str.maketrans(UPPER, LOWER)
    shared = documents.sparkSession.sparkContext.broadcast(wanted)  # SHIPPED terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(TERM).findall, shared.value
        seen: dict[str, str | None] = {}
        for batch in batches:
            ids, sizes, offsets, terms, tfs = [], [], [0], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(find(text.as_py()))
                held: dict[str, int] = {}
                for word, times in found.items():
                    term = seen.get(word, "")
                    if term == "":
                        term = word.translate(lower)
                        if known is not None and term not in known:
                            term = None
                        if len(word) <= LONGEST:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[word] = term
                    if term is not None:
                        held[term] = held.get(term, 0) + times
                if found:
                    ids.append(i)
                    sizes.append(found.total())
                    terms += held
                    tfs += held.values()
                    offsets.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
            hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), hits], ["doc_id", "n", "hits"])

    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n bigint, hits {HITS}")


def inverted(forward: DataFrame) -> DataFrame:
    """term, block, docs, tfs and ns: the postings of every term in every block of
    ``forward``. A block that is read by two tasks gives two pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            rows = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
            flat = hits.flatten()
            terms = flat.field("term").dictionary_encode()
            term, tf = terms.indices.to_numpy(zero_copy_only=False), flat.field("tf").to_numpy(zero_copy_only=False)
            doc, n = batch.column("doc").to_numpy()[rows], batch.column("n").to_numpy()[rows]
            order = np.lexsort((doc, term, doc >> BITS))
            term, tf, doc, n = term[order], tf[order], doc[order], n[order]
            block = doc >> BITS
            starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (doc, tf, n)]
            names = terms.dictionary.take(pa.array(term[starts]))
            yield pa.RecordBatch.from_arrays([names, pa.array(block[starts]), *lists], ["term", "block", "docs", "tfs", "ns"])

    return forward.select("doc", "n", "hits").mapInArrow(run, "term string, block bigint, docs array<bigint>, tfs array<bigint>, ns array<bigint>")


def by_impact(pieces: DataFrame) -> DataFrame:
    """term, block, docs and impacts of ``pieces`` with w, N and L, by falling impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("docs")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False)
            piece = np.repeat(np.arange(batch.num_rows), sizes)
            doc, tf, n = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("docs", "tfs", "ns"))
            w, whole, length = (batch.column(x).to_numpy()[piece] for x in ("w", "whole", "length"))
            found = w * (1_000_000_000 * tf // (1000 * tf + 8 * (100 - 75 + 75 * n * whole // length)))
            order = np.lexsort((doc, -found, piece))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (doc, found)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), *lists], ["term", "block", "docs", "impacts"])

    columns = pieces.select("term", "block", "docs", "tfs", "ns", "w", F.col("docs_in_all").alias("whole"), "length")
    return columns.mapInArrow(run, "term string, block bigint, docs array<bigint>, impacts array<bigint>")


def summed(prefixes: DataFrame) -> DataFrame:
    """item, doc, score (what was given of it) and upper of all that may reach ``least``,
    from ``prefixes`` (block, part, docs, impacts, askers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        score, spared = np.zeros((0, BLOCK), np.int64), np.zeros((0, BLOCK), np.int64)
        rows: dict[int, int] = {}
        bounds: list[tuple[int, int, int]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            for at, (item, least, budget) in enumerate(bounds):
                upper = score[at] - spared[at] + budget
                doc = np.flatnonzero((score[at] > 0) & (upper >= least))
                columns = [np.full(len(doc), item), doc + (group[0] << BITS), score[at][doc], upper[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["item", "doc", "score", "upper"])
            rows.clear()
            bounds.clear()

        for batch in batches:
            askers = batch.column("askers").to_pylist()
            for key, docs, impacts, asking in zip(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("docs"), batch.column("impacts"), askers, strict=True):
                if key != group:
                    yield from closed()
                    group = key
                    score[:], spared[:] = 0, 0
                place, impact = docs.values.to_numpy() & (BLOCK - 1), impacts.values.to_numpy()
                for x in asking:
                    at = rows.get(x["item"])
                    if at is None:
                        at = rows[x["item"]] = len(bounds)
                        bounds.append((x["item"], x["least"], x["budget"]))
                        if at >= len(score):
                            more = np.zeros((max(16, len(score)), BLOCK), np.int64)
                            score, spared = np.concatenate([score, more]), np.concatenate([spared, more])
                    share = x["times"] * impact
                    size = len(share) - int(np.searchsorted(share[::-1], x["level"], side="right"))
                    score[at, place[:size]] += share[:size]
                    spared[at, place[:size]] += min(x["level"], x["most"])
        yield from closed()

    groups = prefixes.repartition("block", "part").sortWithinPartitions("block", "part")
    return groups.mapInArrow(run, "item bigint, doc bigint, score bigint, upper bigint")


def asked(items: DataFrame) -> DataFrame:
    """row (of an item), item_id, term and how often the item has it, stored."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = store(items.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms")), "items")
    found = store(rows.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "asked")
    drop(rows)
    return found


def weighed(forward: DataFrame) -> DataFrame:
    """term, df, w of every term in ``forward``, and N and L of the whole."""
    lists = forward.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    whole = forward.agg(F.count("*").alias("docs_in_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"))
    odds = (2 * F.col("docs_in_all") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return lists.join(F.broadcast(whole)).withColumn("w", F.floor(1000 * F.log(odds)).cast("bigint"))  # one row


def impact() -> Column:
    """What a posting (w, tf, n) adds to a score for every time that the item has the term."""
    return F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * (100L - 75L + ((75L * n * docs_in_all) div length))))")


def best(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group as ``rank`` 1 to k. Spark cuts the groups in every
    task before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def exact(pairs: DataFrame, forward: DataFrame, lists: DataFrame) -> DataFrame:
    """item, doc, doc_id and score of ``pairs`` (item, doc), looked up by document.
    ``lists`` has an item's terms with their weights."""
    docs = forward.join(pairs, "doc").select("item", "doc", "doc_id", "n", F.explode("hits").alias("hit"))
    parts = docs.select("item", "doc", "doc_id", "n", "hit.term", "hit.tf").join(lists.select("item", "term", "times", "w", "docs_in_all", "length"), ["item", "term"])
    return parts.groupBy("item", "doc").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("times") * impact()).alias("score"))


def kth(scores: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k``-th largest score of every item that has so many."""
    return best(scores, ["item"], [F.desc("score")], k).where(F.col("rank") == k).select("item", F.col("score").alias(name))


def levels(lists: DataFrame, least: DataFrame) -> DataFrame:
    """``lists`` (item, term, times, most: the largest share of a score in the list) with
    ``least`` of the item, its ``level`` and its ``budget``, the sum of min(level, most) over
    the item's lists. With the ceiling for a level it would be just below ``least``. Where
    there is no bound the level is 0, so that all postings are above it."""
    by_size = Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, -1)
    item = Window.partitionBy("item")
    bounded = lists.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("bigint")))
    full = bounded.withColumn("smaller", F.coalesce(F.sum("most").over(by_size), F.lit(0).cast("bigint")))
    full = full.withColumn("others", F.count("*").over(item) - F.count("*").over(by_size))
    full = full.withColumn("room", F.expr("greatest(0L, least - 1 - smaller) div others"))
    # Lists no larger than the level use their largest only; the first that is larger shares what is left with those after it.
    level_of = F.min(F.when(F.col("room") < F.col("most"), F.struct("most", "term", "room"))).over(item)
    level = F.expr(f"coalesce(ceiling, 0L) div {LOWER_BY}")
    found = full.withColumn("ceiling", level_of["room"]).withColumn("level", level).drop("smaller", "others", "room", "ceiling")
    return found.withColumn("budget", F.sum(F.least("level", "most")).over(item))


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``documents`` (doc_id, text) for
    every row of ``items`` (item_id, text)."""
    queries = asked(items)
    terms = queries.select("term").distinct()
    few = [r["term"] for r in terms.limit(SHIPPED + 1).collect()]
    found = counted(documents, frozenset(few) if len(few) <= SHIPPED else None)
    forward = store(found.withColumn("doc", F.monotonically_increasing_id()), "forward")

    weights = store(weighed(forward).where("w > 0").join(terms, "term"), "weights")
    pieces = store(by_impact(inverted(forward).join(weights, "term")).repartition("term", "block").sortWithinPartitions("term", "block"), "lists")

    # 1. Heads, and the exact scores of their documents.
    tops = pieces.select("term", F.posexplode(F.slice("impacts", 1, k)).alias("at", "impact"), "docs").select("term", "impact", F.get("docs", "at").alias("doc"))
    heads = store(best(tops, ["term"], [F.desc("impact"), F.asc("doc")], k), "heads")
    most = heads.where("rank = 1").select("term", F.col("impact").alias("largest"))
    lists = queries.join(weights, "term").join(most, "term").withColumn("most", F.col("times") * F.col("largest"))
    lists = store(lists.select("item", "item_id", "term", "times", "w", "docs_in_all", "length", "most"), "asking")
    named = store(lists.select("item", "term").join(heads.select("term", "doc"), "term").select("item", "doc").distinct(), "named")
    least = kth(exact(named, forward, lists), "least", k)

    # 2. What every list has above the level.
    levelled = store(levels(lists, least), "levelled")
    groups = F.ceil(F.count_distinct("item") / TOGETHER).alias("groups")
    asker = F.struct("item", "times", "level", "most", "least", "budget")
    grouped = levelled.join(F.broadcast(levelled.agg(groups)))  # one row
    askers = grouped.groupBy("term", F.pmod(F.xxhash64("item"), F.greatest("groups", F.lit(1))).alias("part"))
    askers = store(askers.agg(F.collect_list(asker).alias("askers"), F.min(F.expr("level div times")).alias("floor")), "askers")
    prefixes = pieces.join(askers, "term").withColumn("size", F.size(F.filter("impacts", lambda x: x > F.col("floor")))).where("size > 0")
    prefixes = prefixes.select("block", "part", F.slice("docs", F.lit(1), F.col("size")).alias("docs"), F.slice("impacts", F.lit(1), F.col("size")).alias("impacts"), "askers")
    reached = store(summed(prefixes), "reached")
    again = kth(reached, "again", k)
    hopeful = reached.join(again, "item", "left").where("again IS NULL OR upper >= again")
    candidates = store(hopeful.select("item", "doc"), "candidates")
    drop(pieces, heads, named, askers, reached, weights, queries)

    # 3. Exact scores of what is left.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("doc")]
    ranked = best(exact(candidates, forward, lists).where("score > 0"), ["item"], order, k)
    ids = levelled.select("item", "item_id").distinct()
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


#: The same by scoring every document.
ORACLE = rf"""
WITH terms AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS x FROM documents WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT doc, doc_id, len(x)::BIGINT AS n, x FROM terms WHERE len(x) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
items AS (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM items GROUP BY ALL),
hits AS MATERIALIZED (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, n, unnest(x) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM hits, whole GROUP BY term),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length)))))::BIGINT AS score
  FROM asked JOIN hits USING (term) JOIN weights USING (term), whole GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= {K}
"""
