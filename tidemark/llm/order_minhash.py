"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words. Its k-mers (``K`` words in a row) are labelled with how
often they have occurred before, so repeats count. A sketch takes the ``MINIMA`` labelled
k-mers with the smallest hash and keeps them in text order; texts that have the same parts
in another order get another sketch. Texts that share one of ``BANDS`` sketches are
candidates. A candidate pair is a link if its words can be aligned with at most
``1 - SIMILAR`` edits (words put in, left out or replaced) per word of the longer text; the
alignment looks only at that band around the diagonal. What the two have in common of words
and of runs of two words refuses most others first: an edit spoils one and two of them at
most, so no pair that the alignment would take is lost.

Sketches are of runs short enough for edits scattered over a text: at a similarity of just
0.8 a third of the runs of five words is left, but half of those of three. Texts of fewer
than ``SHORT`` words have too few of those and are sketched by runs of two words; texts up
to a quarter longer by both, so that no pair falls between.

How it stays linear: equal texts collapse into one node before anything is compared. In
every bucket all members are compared with one of them only; links become classes by
joins, each round written to the shared folder. Buckets of over ``BLOCK`` members that
still are of several classes are compared with ``PIVOTS`` more members, chosen anew in
each of ``ROUNDS`` rounds, and those who join a class thereby need no more comparing with
it. What then is still apart meets a block of members against another at a time, by the words
and runs that are rarest among them: near-duplicates have one in common of those that either
can do without, so a passage that all of a bucket share makes no pairs. Alignments are made
only for pairs that nothing has joined yet, and only in the first of the buckets that a pair
shares. Pairs stay inside the
task and only links leave it; no link is lost to the choice of members. A block has at most
about ``BLOCK`` members and ``BLOCK_WORDS`` words, so that a task's memory is bounded.
Tables of a row per key are stored before they are joined, by sorted sides, so that Spark
splits a hot key.

Defined results: texts that are equal word for word (white space apart) are alike; texts
of fewer than K words form one k-mer; a text without words is in a class with texts equal
to it only; a null text is in a class of its own, by its doc_id. Rows repeated in doc_id
and text are one document and each give a row; rows of one doc_id with different texts are
different documents, classed each by its text. A class is named by its smallest doc_id. An
empty table gives none; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, shuffle_width, store

K = 3
MINIMA = 3
BANDS = 64
SIMILAR = 0.8
#: Texts of fewer words are sketched by runs of two words.
SHORT = 64
#: Bounds of a block of members that are compared all with all.
BLOCK = 1024
BLOCK_WORDS = 1_000_000
#: Words of texts whose words' places are held as an integer each: 4 MB at most.
HELD = 8192
PIVOTS = 4
ROUNDS = 2
#: Rows of the matrix of pairs that are held at a time, and the pairs a row that are aligned
#: without a look at what runs they have in common.
ROWS_AT_ONCE, FEW = 256, 64
#: Words whose hashes a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A good scrambling of 64-bit numbers (multiply and fold)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of words, remembered within bounds."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if missing := [w for w in words if w not in seen]:
            if len(seen) > REMEMBERED:
                seen.clear()
                missing = words
            known = {w: xxhash.xxh3_64_intdigest(w) for w in set(missing)}
            seen.update((w, h) for w, h in known.items() if len(w) <= LONGEST)
            return np.fromiter((known[w] if w in known else seen[w] for w in words), np.uint64, len(words))
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole text if it is shorter."""
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = _mixed(out * _MIX + words[i : i + n] + np.uint64(i + 1))
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of earlier occurrences in the text."""
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if fresh.all():
        return found
    firsts = np.flatnonzero(fresh)
    earlier = np.arange(len(found)) - np.repeat(firsts, np.diff(np.append(firsts, len(found))))
    out = np.empty_like(found)
    out[order] = np.where(earlier > 0, _mixed(ordered + earlier.astype(np.uint64) * _MIX), ordered)
    return out


#: Numbers in a block of hash values: bounds the memory that a very long text takes.
CELLS = 4_000_000


def sketches(found: np.ndarray, count: int, minima: int = MINIMA) -> np.ndarray:
    """``count`` order min-hashes of labelled k-mers: each is one number for the smallest
    ``minima`` of them in text order. The hashes are multiplications by odd numbers."""
    odd = _mixed(np.arange(1, count + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    out = np.empty(count, np.uint64)
    take = min(minima, len(found))
    step = max(1, CELLS // len(found))
    for at in range(0, count, step):
        values = found[None, :] * odd[at : at + step, None]
        places = np.argpartition(values, take - 1, axis=1)[:, :take]
        places.sort(axis=1)
        acc = np.full(len(values), take, np.uint64)
        for x in found[places].T:
            acc = _mixed(acc * _MIX + x)
        out[at : at + step] = acc
    return out


def band_keys(words: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The keys by which a text of these words is bucketed: a sketch each, of runs of two
    words for a short text, of ``K`` for a long one, of both in between."""
    numbers = np.arange(1, bands + 1, dtype=np.uint64)
    runs = [k for k, holds in ((K, len(words) >= SHORT), (2, len(words) < SHORT / SIMILAR)) if holds]
    found = [_mixed((numbers + np.uint64(k << 32)) * _MIX + sketches(labelled(kmers(words, k)), bands)) for k in runs]
    return np.concatenate(found).view(np.int64)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The fewest words put in, left out or replaced that turn ``a`` into ``b``, or None if
    there are more than ``most``. What both begin and end with is set aside; the band is
    widened from a few diagonals until it holds the alignment or reaches ``most``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    same = np.flatnonzero(a[: len(b)] != b)
    first = int(same[0]) if len(same) else len(b)
    a, b = a[first:], b[first:]
    same = np.flatnonzero(a[len(a) - len(b) :][::-1] != b[::-1])
    last = int(same[0]) if len(same) else len(b)
    a, b = a[: len(a) - last], b[: len(b) - last]
    if not len(b):
        return len(a)
    band = max(16, len(a) - len(b))
    while band < most:
        if (found := _banded(a, b, band)) is not None:
            return found
        band *= 4
    return _banded(a, b, most)


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edits between ``a`` and the shorter ``b`` if they are at most ``most``. The
    alignment looks at ``most`` diagonals to each side of the main one; a column of that band
    is held as two bit vectors of its differences down the column (+1 and -1), so a word of
    ``b`` costs a few operations on long integers. Where a word stands is held as one integer
    for texts of up to ``HELD`` words; of longer ones the band's part is made from a list of
    the word's places, so that memory is that of the texts and of a few bands."""
    n, m = len(a), len(b)
    if n - m > most:
        return None
    if most == 0:
        return 0 if bool((a == b).all()) else None
    if most > m:  # what both begin with costs nothing; the band needs so many words
        a, b = (np.concatenate([np.zeros(most, np.uint64), x]) for x in (a, b))
        n, m = len(a), len(b)
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    whole: dict[int, int] = {}
    order, begins, ends = np.zeros(0, np.int64), [], []
    spelled = b.tolist()
    if n <= HELD:
        for i, w in enumerate(a.tolist()):
            whole[w] = whole.get(w, 0) | 1 << i
    else:
        order = np.argsort(a, kind="stable")
        begins, ends = np.searchsorted(a[order], b).tolist(), np.searchsorted(a[order], b, side="right").tolist()
    bits = np.zeros(width, np.uint8)
    up, down = full ^ ((1 << most) - 1), 0
    last, cost = top >> 1, most
    for j in range(m):
        at = j - most  # the row of the band's lowest bit
        equal = 0
        if whole:
            equal = whole.get(spelled[j], 0)
            equal = (equal >> at if at >= 0 else equal << -at) & full
        elif ends[j] - begins[j] <= 4:
            for i in order[begins[j] : ends[j]].tolist():
                if 0 <= i - at < width:
                    equal |= 1 << (i - at)
        else:
            places = order[begins[j] : ends[j]]
            x, y = np.searchsorted(places, (at, at + width))
            if y > x:
                bits[places[x:y] - at] = 1
                equal = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                bits[places[x:y] - at] = 0
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), diagonal & up
        if j < n - most:  # the band's lowest diagonal is followed
            cost += not diagonal & top
        else:  # the last row is reached: follow it to the right
            cost += bool(right_up & last) - bool(right_down & last)
            last >>= 1
        slid = diagonal >> 1
        up, down = right_down | (full & ~(slid | right_up)), slid & right_up
    return cost if cost <= most else None


def allowed(longer: int) -> int:
    """How many edits two texts may be apart."""
    return int((1 - SIMILAR) * longer + 1e-9)


def profile(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled words, and labelled runs of two words, sorted."""
    return np.sort(labelled(words)), np.sort(labelled(kmers(words, 2)))


def alike(a: np.ndarray, b: np.ndarray, a_profile: tuple | None = None, b_profile: tuple | None = None) -> bool:
    """Whether two word sequences are near-duplicates (see the module's text)."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    longer = max(len(a), len(b))
    most = allowed(longer)
    if longer - min(len(a), len(b)) > most:
        return False
    if len(a) == len(b) and (a == b).all():
        return True
    if min(len(a), len(b)) > 1:
        x, y = a_profile or profile(a), b_profile or profile(b)
        for k in (1, 2):
            if len(np.intersect1d(x[k - 1], y[k - 1], assume_unique=True)) < longer + 1 - k - k * most:
                return False
    return edits(a, b, most) is not None


class Rarest:
    """The rarest tokens of some members, by which near-duplicates among them meet.

    Of ``found``, a member's distinct tokens of ``runs`` words, two near-duplicates have at
    least ``share`` times the longer one's words less ``runs - 1`` in common. So if all tokens
    are put in one order, the rarest first, and each member takes as many as it can do
    without and ``least`` more, two near-duplicates have the smaller ``least`` of both in common
    among those. ``least`` is ``portion`` of what they must have in common at all."""

    def __init__(self, found: list[np.ndarray], share: float, runs: int, portion: float) -> None:
        sizes = np.array([len(x) for x in found])
        known, at, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        place = np.empty(len(known), np.int64)
        place[np.argsort(counts, kind="stable")] = np.arange(len(known))
        needed = np.maximum(1, np.ceil(share * (sizes + runs - 1) - 1e-9).astype(int) - (runs - 1))
        self.least = np.maximum(1, (portion * needed).astype(int))
        member = np.repeat(np.arange(len(found)), sizes)
        order = np.lexsort((place[at], member))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[(rank < np.repeat(sizes - needed + self.least, sizes)) & (counts[at[order]] > 1)]
        order = order[np.argsort(at[order], kind="stable")]
        token, self.member = at[order], member[order]
        self.begins, self.ends = np.searchsorted(token, token), np.searchsorted(token, token, side="right")
        self.by_member = np.argsort(self.member, kind="stable")
        self.cuts = np.searchsorted(self.member[self.by_member], np.arange(len(found) + 1))

    def meet(self, rows: np.ndarray) -> np.ndarray:
        """Whether members ``rows`` have enough of the rarest tokens in common with each."""
        members = len(self.least)
        own = np.concatenate([self.by_member[self.cuts[i] : self.cuts[i + 1]] for i in rows])
        row = np.repeat(np.arange(len(rows)), self.cuts[rows + 1] - self.cuts[rows])
        lengths = self.ends[own] - self.begins[own]
        out = np.zeros(len(rows) * members, np.int64)
        steps = np.searchsorted(np.cumsum(lengths), np.arange(CELLS, lengths.sum() + CELLS, CELLS), side="right")
        for x, y in zip([0, *steps[:-1].tolist()], [*steps[:-1].tolist(), len(own)], strict=True):
            n = lengths[x:y]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begins[own[x:y]], n)
            out += np.bincount(np.repeat(row[x:y], n) * members + self.member[places], minlength=len(out))
        return out.reshape(len(rows), members) >= np.minimum(self.least[rows, None], self.least[None])


def links_within(words: list[np.ndarray], roots: list[int], sides: list[int], keys: list[np.ndarray], key: int) -> list[tuple[int, int]]:
    """Index pairs of links that join what isn't yet of one root; if there are two
    ``sides``, between them only; of pairs that share several ``keys``, those whose least is
    ``key``. Links that would join nothing new are left out.
    Those of the commonest root aren't compared with each other."""
    up = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    def join(i: int, j: int) -> bool:
        x, y = top(roots[i]), top(roots[j])
        if x == y or not alike(words[i], words[j], profiles[i], profiles[j]):
            return False
        up[max(x, y)] = min(x, y)
        return True

    root, side = np.array(roots), np.array(sides)
    names, counts = np.unique(root, return_counts=True)
    few = np.flatnonzero(root != names[counts.argmax()])
    if not len(few):
        return []
    profiles = [profile(w) for w in words]
    sizes = np.array([len(w) for w in words])
    by_words, by_runs = Rarest([x[0] for x in profiles], SIMILAR, 1, 0.25), None
    lower = [set(x[x < key].tolist()) for x in keys]
    found: list[tuple[int, int]] = []
    for at in range(0, len(few), ROWS_AT_ONCE):
        part = few[at : at + ROWS_AT_ONCE]
        able = by_words.meet(part) & (root[part, None] != root[None])
        able &= np.abs(sizes[part, None] - sizes[None]) <= (1 - SIMILAR) * np.maximum(sizes[part, None], sizes[None]) + 1e-9
        if side.any() and not side.all():
            able &= side[part, None] != side[None]
        for row in range(len(part)):
            able[row, few[: at + row + 1]] = False  # each two of the few once
        if able.sum() > FEW * len(part):  # the same words in other orders
            by_runs = by_runs or Rarest([x[1] for x in profiles], 2 * SIMILAR - 1, 2, 0.1)
            able &= by_runs.meet(part)
        for row, j in np.argwhere(able).tolist():
            i = int(part[row])
            if lower[i].isdisjoint(lower[j]):
                found.append((i, j))
    return [(i, j) for i, j in found if join(i, j)]


def linked_blocks(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members (key, node, size, root, blocks) of equal keys and
    different roots."""
    placed = apart.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "node", "root", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    with_text = met.join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        group: tuple | None = None
        ids: list[int] = []
        words: list[np.ndarray] = []
        roots: list[int] = []
        sides: list[int] = []
        keys: list[np.ndarray] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if group:
                found.extend((max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in links_within(words, roots, sides, keys, group[0]))
            for held in (ids, words, roots, sides, keys):
                held.clear()

        def taken() -> pa.RecordBatch:
            a, b = [x[0] for x in found], [x[1] for x in found]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "lo", "hi", "node", "root", "own")]
            for (key, lo, hi, node, root, own), text, shares in zip(zip(*columns, strict=True), batch.column("text"), batch.column("keys"), strict=True):
                if (key, lo, hi) != group:
                    close()
                    group = (key, lo, hi)
                ids.append(node)
                words.append(hashes(text.as_py().split()))
                roots.append(root)
                sides.append(int(own != lo))
                keys.append(shares.values.to_numpy())
            yield taken()
        close()
        yield taken()

    # Tasks of so much work are not to be put together by their small sizes.
    groups = with_text.repartition(shuffle_width(apart.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return groups.mapInArrow(run, "a bigint, b bigint").distinct()


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the text, its number of words and its band keys (null without
    words), of rows with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column("text"):
                words = hashes(text.as_py().split())
                sizes.append(len(words))
                keys.append(band_keys(words) if len(words) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], ["doc_id", "digest", "size", "keys"])

    return identified(documents).mapInArrow(run, "doc_id bigint, digest binary, size bigint, keys array<bigint>")


def identified(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, a strong digest of the text, text and ``more``, of rows with both."""
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL")
    return texts.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text", *more)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) of nodes those that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            good = []
            last, words, known = None, np.zeros(0, np.uint64), None
            for left, node, right in zip(batch.column("ta"), batch.column("b").to_pylist(), batch.column("tb"), strict=True):
                if node != last:
                    last, words = node, hashes(right.as_py().split())
                    known = profile(words)
                good.append(alike(hashes(left.as_py().split()), words, None, known))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return with_both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b): root is the smallest node that can be
    reached. Large-star and small-star rounds, each stored, until nothing changes."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = store(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = store(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = store(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = state(fresh)
        drop(stars, least, large, lowest)
        stars = fresh
        if after == before:
            break
        before = after
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    named._tidemark_path = stars._tidemark_path
    return named


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, root) after more ``links`` (a, b): only roots are joined anew."""
    if links.isEmpty():
        return classes
    edges = links
    for side in ("a", "b"):
        rooted = classes.select(F.col("node").alias(side), "root")
        edges = edges.join(rooted, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    joined = components(edges)
    moved = classes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    fresh = store(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(joined), "classes")
    drop(classes, joined)
    return fresh


def met_by_key(rows: DataFrame, by_key: DataFrame) -> DataFrame:
    """``rows`` joined with a row per key. That table is stored first and the join is one of
    sorted sides, so that nothing but shuffles feeds it: then Spark splits a hot key."""
    return rows.join(by_key.hint("merge"), "key")


def placed_in(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` (key, node, size) of buckets that hold several classes, with their root,
    and the members and blocks of the bucket."""
    rooted = members.select("key", "node", "size").join(classes, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    placed = store(rooted, "placed")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_WORDS)).cast("int")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), blocks.alias("blocks")).where("lo <> hi")
    mixed = store(mixed.drop("lo", "hi"), "mixed")
    apart = store(met_by_key(placed, mixed), "apart")
    drop(placed, mixed)
    return apart


def pivots_of(apart: DataFrame, salt: int) -> DataFrame:
    """Stored pairs (a, b) of members of large buckets with ``PIVOTS`` others, of another
    root."""
    chosen = [F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(salt * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
    large = apart.where(F.col("n") > BLOCK)
    pivots = large.groupBy("key").agg(*chosen).select("key", F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivots"))
    pivots = store(pivots, "pivots")
    met = met_by_key(large, pivots).select("node", "root", F.explode("pivots").alias("p")).where("root <> p.root")
    pairs = store(met.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct(), "pairs")
    drop(pivots)
    return pairs


def classes_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: doc_id and digest of every document with a text; and of every digest
    its class_id, and whether its text stands for the class (``leads``)."""
    found = store(signatures(documents), "signatures")
    collapsed = found.groupBy("digest").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("size", "keys")))
    copies = store(collapsed.withColumn("node", F.monotonically_increasing_id()), "copies")
    buckets = copies.select("node", "size", F.explode("keys").alias("key"))
    firsts = buckets.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    firsts = store(firsts.drop("last"), "firsts")
    members = store(met_by_key(buckets, firsts), "members")
    drop(firsts)
    wanted = copies.join(members.select("node").distinct(), "node").select(F.col("rep").alias("doc_id"), "digest", "node", "keys")
    texts = store(identified(documents).join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("node", "keys", "text"), "texts")

    # Everybody against the first of each bucket.
    pairs = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = store(verified(pairs, texts), "links")
    classes = components(links)
    drop(links)
    apart = placed_in(members, classes)
    drop(members)
    for turn in range(ROUNDS):
        more = pivots_of(apart, turn)
        if more.isEmpty():
            drop(more)
            break
        links = store(verified(more, texts), "links")
        classes = merged(classes, links)
        drop(more, links)
        narrowed = placed_in(apart, classes)
        drop(apart)
        apart = narrowed

    # Members of one bucket that are still apart, all with all.
    links = store(linked_blocks(apart, texts), "links")
    drop(apart, texts)
    classes = merged(classes, links)
    drop(links)

    own = copies.select("digest", "node", "rep")
    rooted = store(own.join(classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct()), "node"), "rooted")
    named = store(rooted.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("lead")), "named")
    linked = rooted.join(named.hint("merge"), "root").select("node", F.col("lead.rep").alias("class_id"), (F.col("node") == F.col("lead.node")).alias("leads"))
    result = own.join(linked, "node", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    result = store(result, "classes")
    drop(classes, copies, rooted, named)
    return found, result


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), of every row of ``documents``
    (doc_id, text)."""
    found, named = classes_of(documents)
    known = found.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
    others = documents.where("text IS NULL OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return known.unionByName(others)


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class, that with the smallest doc_id; where rows
    of that doc_id have different texts, the text that stands for the class. Rows without
    a text are one by doc_id; rows without a doc_id all stay."""
    found, named = classes_of(documents)
    drop(found)
    kept = named.where("leads").select(F.col("class_id").alias("doc_id"), "digest")
    rows = identified(documents, F.struct("*").alias("row")).drop("text")
    led = rows.join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("row.*")
    empty = documents.where("text IS NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return led.unionByName(empty).unionByName(documents.where("doc_id IS NULL"))
