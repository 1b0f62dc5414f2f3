"""Hash trees over key ranges: what a table was, by version, and where two versions differ.

A leaf covers ``leaf`` consecutive keys, a node above it ``fanout`` nodes. Keys are whole
numbers, one row each; nodes without rows don't exist, and an empty table has an empty tree. A
leaf's hash is 240 bits of the SHA-256 over its rows in order of key, a node's the exclusive or
of its leaves': equal for equal rows, but no guard against someone who designs the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import row_hash

LEAF, FANOUT, LEVELS = 4096, 16, 6


def _checksum() -> Column:
    return F.sha2(F.concat_ws("|", "level", "node", "low", "high", "n", "hash", "version"), 256)


def tree(rows: DataFrame, key: str, columns: list[str], version: str, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """level (0: leaves), node, low and high (its least and greatest key), n, hash, version (of
    the code that made the rows) and a checksum of the record itself. One exchange of the rows'
    hashes by leaf; all levels are summed from leaves at once. Keep it as a table: comparisons
    read it once a level."""
    hashed = rows.select(F.col(key).cast("bigint").alias("key"), row_hash([key, *columns]).alias("h"))
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "h"))), lambda x: x["h"]), "")
    leaves = hashed.groupBy(F.floor(F.col("key") / leaf).alias("leaf")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.sha2(in_order, 256).alias("h"))
    bits = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"b{i}") for i in range(4)]
    above = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("leaf") / fanout**i).alias("node")) for i in range(levels)])).alias("at")
    summed = leaves.select("low", "high", "n", *bits, above).groupBy("at.level", "at.node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), *[F.bit_xor(f"b{i}").alias(f"b{i}") for i in range(4)])
    text = F.lower(F.concat(*[F.lpad(F.hex(f"b{i}"), 15, "0") for i in range(4)]))
    named = summed.select("level", "node", "low", "high", "n", text.alias("hash"), F.lit(version).alias("version"))
    return named.withColumn("checksum", _checksum())


def damaged(trees: DataFrame) -> DataFrame:
    """Records whose checksum isn't that of their fields, with error LN003."""
    return trees.where(~F.col("checksum").eqNullSafe(_checksum())).withColumn("error", F.lit("LN003"))


def changed_ranges(before: DataFrame, after: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Leaves (node, low, high) in which two trees differ. From the top, only children of nodes
    that differ are compared; a node that one tree lacks differs."""
    both = before.withColumn("side", F.lit("old")).unionByName(after.withColumn("side", F.lit("new")))
    of = {x: F.max(F.when(F.col("side") == x, F.col("hash"))) for x in ("old", "new")}
    found: DataFrame | None = None
    for level in reversed(range(levels)):
        nodes = both.where(F.col("level") == level).withColumn("up", F.floor(F.col("node") / fanout))
        if found is not None:
            nodes = nodes.join(found.select(F.col("node").alias("up")), "up", "left_semi")
        found = nodes.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[x.alias(name) for name, x in of.items()]).where(~F.col("old").eqNullSafe(F.col("new"))).select("node", "low", "high")
    return found


def changed_rows(before: DataFrame, after: DataFrame, ranges: DataFrame, key: str, columns: list[str], leaf: int = LEAF, folder: str | None = None) -> DataFrame:
    """Keys whose rows differ, and how ('added', 'removed', 'changed'), looked for only in
    ``ranges``. Where both tables are stored in folders by ``folder``, a column with the number
    of the leaf, only folders of these ranges are read."""
    sides = []
    for rows, name in ((before, "old"), (after, "new")):
        node = F.col(folder) if folder else F.floor(F.col(key) / leaf)
        near = rows.withColumn("_node", node.cast("bigint")).join(ranges.select(F.col("node").alias("_node")), "_node", "left_semi")
        sides.append(near.select(F.col(key).cast("bigint").alias("key"), row_hash([key, *columns]).alias(name)))
    both = sides[0].join(sides[1], "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select("key", kind.alias("change"))
