"""Shards by balanced label propagation.

Nodes with a size belong to groups (hyperedges; a plain edge is a group of two). Every
round joins memberships with labels, adds up the bytes that each group has in each shard,
and lets a node ask for the shard that holds most of its neighbours among those with room.
Nodes of one family (those with the same first group) move together where a shard has room
for the whole family; only when no such move is left do families without such a shard move
node by node, filling one shard after another. Rounds go on until nobody can move to
advantage. Nodes in no group are filler: at the end they are laid on a line and dealt out
so that all shards come out equal to within one document.

Law of ``shard_documents``: ``bytes``. No shard is filled past an equal share by the
rounds, so the filler can level all of them.

Hot groups: equal texts enter the rounds as at most ``SALTS`` nodes per group, aggregated
before anything is joined, and documents find their node by (group, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

SALTS = 32
#: Rows in one slice of a running total.
SLICE_ROWS = 20_000


def _slices(n: int) -> int:
    return max(1, -(-n // SLICE_ROWS))


def running(df: DataFrame, group: list[str], value: Column, order: list[str], slices: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the group that come
    first in the order (hash slice, then ``order``). No task orders a whole group: totals by
    slice are summed up apart and each slice is ordered on its own."""
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")).withColumn("_value", value)
    totals = cut.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    ahead = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(starts, [*group, "_slice"])
    return joined.withColumn("before", F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_slice", "_value", "_start")


def _by_shard(values: dict[int, int], shard: str) -> Column:
    return F.element_at(F.array(*(F.lit(values[s]).cast("long") for s in range(len(values)))), F.col(shard) + 1)


def _accepted(asked: DataFrame, unit: list[str], room: dict[int, int], slices: int, name: str) -> tuple[DataFrame, int]:
    """The units in ``asked`` (``unit``, bytes, want) that fit: those that end within the
    shard's room when all are laid on a line. Also their number."""
    units = asked.groupBy("want", *unit).agg(F.sum("bytes").alias("bytes"))
    line = running(units, ["want"], F.col("bytes"), unit, slices)
    fits = store(line.where(F.col("before") + F.col("bytes") <= _by_shard(room, "want")).select("want", *unit, "bytes"), name)
    return fits, fits.count()


def propagate(nodes: DataFrame, memberships: DataFrame, shards: int, capacity: int, rounds: int = 4) -> DataFrame:
    """Labels of ``nodes`` (node, bytes, first: the shard that it votes for at first) under
    ``memberships`` (node, group): rows (node, bytes, label), label null where no shard
    had room. A shard never holds more than ``capacity`` bytes.

    First votes take no room. Ties between shards go by a hash of the family, so that all
    its members break them alike. Ends when nobody wants to move, or after ``rounds`` rounds
    in a row that bring groups no closer together (moves at one time can undo each other);
    the best labels found are returned.
    """
    firsts = memberships.groupBy("node").agg(F.min("group").alias("tie"))
    family = F.coalesce(F.concat(F.lit("g"), F.hex("tie")), F.concat(F.lit("n"), F.hex("node")))
    named = nodes.join(firsts, "node", "left").select("node", "bytes", "first", family.alias("family"))
    sizes = named.groupBy("family").agg(F.sum("bytes").alias("all"))
    columns = ["node", "bytes", "first", "family", "all"]
    labels = store(named.join(sizes, "family").select(*columns, F.lit(None).cast("int").alias("label")), "labels")
    slices = _slices(labels.count())
    best, kept, idle, turn = -1.0, labels, 0, 0
    while True:
        room = dict.fromkeys(range(shards), capacity)
        for row in labels.where("label IS NOT NULL").groupBy("label").agg(F.sum("bytes").alias("bytes")).collect():
            room[row["label"]] -= row["bytes"]
        said = labels.withColumn("says", F.col("label") if turn else F.col("first").cast("int"))
        votes = memberships.join(said.where("says IS NOT NULL").select("node", "bytes", "says"), "node").groupBy("group", F.col("says").alias("to")).agg(F.sum("bytes").alias("pull"))
        votes = store(votes, "votes")
        if turn:
            score = votes.agg(F.sum(F.col("pull").cast("double") ** 2)).first()[0] or 0.0
            if score > best * (1 + 1e-12):
                if kept is not labels:
                    drop(kept)
                best, kept, idle = score, labels, 0
            else:
                idle += 1
                if idle >= max(1, rounds):
                    drop(votes)
                    break
        # Candidates: shards of neighbours, one's own, the roomiest, and one with room by the family's hash.
        roomiest = max(room, key=lambda s: (room[s], -s))
        free = [s for s in room if room[s] > 0] or [roomiest]
        spread = F.element_at(F.array(*map(F.lit, free)), F.pmod(F.xxhash64("family", F.lit(turn)), F.lit(len(free))).cast("int") + 1)
        others = said.select("node", F.explode(F.array_compact(F.array(F.col("says"), F.lit(roomiest), spread))).alias("to"), F.lit(0).cast("long").alias("pull"))
        pulls = memberships.join(votes, "group").select("node", "to", "pull").unionByName(others).groupBy("node", "to").agg(F.sum("pull").alias("pull"))
        held = labels.where("label IS NOT NULL").groupBy("family", F.col("label").alias("to")).agg(F.sum("bytes").alias("held"))
        choices = pulls.join(labels, "node").join(held, ["family", "to"], "left").withColumn("room", _by_shard(room, "to"))
        whole = F.col("room") >= F.col("all") - F.coalesce("held", F.lit(0))
        part = F.col("to").eqNullSafe(F.col("label")) | (F.col("room") >= F.col("bytes"))
        tie = F.xxhash64("family", "to")
        wants = choices.groupBy("node").agg(
            F.max(F.when(whole, F.struct("pull", tie.alias("tie"), "to")))["to"].alias("whole_to"),
            F.max(F.when(part, F.struct("pull", "room", tie.alias("tie"), "to")))["to"].alias("part_to"),
        )
        wants = wants.select("node", F.coalesce("whole_to", "part_to").alias("want"), F.col("whole_to").isNotNull().alias("whole"))
        asked = store(labels.join(wants, "node", "left"), "asked")
        drop(votes)
        movers = asked.where(F.col("want").isNotNull() & ~F.col("want").eqNullSafe(F.col("label")))
        families, parts = movers.agg(F.count_distinct(F.when(F.col("whole"), F.struct("family", "want"))), F.count(F.when(~F.col("whole"), 1))).first()
        if not families + parts:
            drop(asked)
            break
        placed, n_placed = _accepted(movers.where("whole"), ["family"], room, slices, "families") if families else (None, 0)
        if placed:
            for row in placed.groupBy("want").agg(F.sum("bytes").alias("bytes")).collect():
                room[row["want"]] -= row["bytes"]
        moved = F.lit(False)
        fresh = asked
        if placed:
            fresh = fresh.join(placed.select("want", "family", F.lit(True).alias("as_family")), ["want", "family"], "left")
            moved = moved | (F.coalesce("as_family", F.lit(False)) & F.col("whole"))
        dealt = None
        if parts and n_placed == families:
            fitting = movers.where(~F.col("whole") & (F.col("bytes") <= _by_shard(room, "want")))
            dealt, _ = _accepted(fitting, ["family", "node"], room, slices, "parts")
            fresh = fresh.join(dealt.select("node", F.lit(True).alias("as_part")), "node", "left")
            moved = moved | F.coalesce("as_part", F.lit(False))
        fresh = store(fresh.select(*columns, F.when(moved, F.col("want")).otherwise(F.col("label")).cast("int").alias("label")), "labels")
        drop(*(x for x in (asked, placed, dealt) if x is not None))
        if labels is not kept:
            drop(labels)
        labels, turn = fresh, turn + 1
    if kept is not labels:
        drop(labels)
    return kept.select("node", "bytes", "label")


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 4) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) with its size, checksum, shard and slot.

    Size: UTF-8 bytes of the text plus 1 (null text: 1, and in the group of empty texts).
    Equal texts stay in one shard unless their bytes exceed an equal share or no shard has
    room for all of them; then they fill as few shards as have room. Repeated rows
    are rows of their own; slots among rows equal in doc_id and text are dealt arbitrarily
    but gaplessly. An empty table gives no rows. Extra columns are left out.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = store(
        documents.select(
            "doc_id",
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(body.cast("binary"))).alias("group"),
        ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")),
        "rows",
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total // shards
    cells = rows.groupBy("group", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    linked = cells.withColumn("all", F.sum("n").over(Window.partitionBy("group"))).where("all > 1")
    node = F.concat("group", F.unhex(F.lpad(F.hex("salt"), 2, "0")))
    linked = store(linked.select(node.alias("node"), "group", "salt", "bytes", F.pmod("salt", F.lit(shards)).cast("int").alias("first")), "cells")
    labels = propagate(linked.select("node", "bytes", "first"), linked.select("node", "group"), shards, share, rounds)
    homes = linked.join(labels.select("node", "label"), "node").select("group", "salt", "label")
    placed = store(rows.join(homes, ["group", "salt"], "left"), "placed")

    held = dict.fromkeys(range(shards), 0)
    for row in placed.where("label IS NOT NULL").groupBy("label").agg(F.sum("size").alias("bytes")).collect():
        held[row["label"]] = row["bytes"]
    slices = _slices(count)
    pool = running(placed.where("label IS NULL"), [], F.col("size"), ["doc_id", "group"], slices)
    reach, fill = 0, F.lit(shards - 1)
    for shard in reversed(range(shards)):
        reach = sum(max(0, (total * (s + 1)) // shards - (total * s) // shards - held[s]) for s in range(shard + 1))
        fill = F.when(F.col("before") < reach, F.lit(shard)).otherwise(fill)
    columns = ["doc_id", "size", "text_crc32", "group"]
    dealt = placed.where("label IS NOT NULL").select(*columns, F.col("label").alias("shard"))
    dealt = store(dealt.unionByName(pool.select(*columns, fill.cast("int").alias("shard"))), "dealt")
    slots = running(dealt, ["shard"], F.lit(1).cast("long"), ["doc_id", "group"], max(1, slices // shards))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
