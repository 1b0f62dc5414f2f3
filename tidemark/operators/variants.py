"""JSON of unknown shape as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` as a variant, and ``error`` where the text is no JSON. A null
    text is a null variant without an error."""
    found = rows.withColumn("_v", F.try_parse_json(column))
    bad = F.col(column).isNotNull() & F.col("_v").isNull()
    return found.withColumn("error", F.when(bad, F.concat(F.lit("no JSON: "), F.substring(column, 1, 40)))).withColumn(column, F.col("_v")).drop("_v")


def fields(rows: DataFrame, column: str, **paths: str) -> DataFrame:
    """``rows`` with a column per name: ``paths`` gives a path and a type each, as in
    ``"$.k bigint"``; null where the path is absent or its value is of another type."""
    kinds = {name: path.rsplit(" ", 1) for name, path in paths.items()}
    return rows.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in kinds.items()})


def entries(rows: DataFrame, column: str, path: str, kind: str) -> DataFrame:
    """A row per entry of the object at ``path``: ``name`` and ``value``, as from
    ``monthly_avg{}``; rows without such an object give none."""
    held = F.try_variant_get(column, path, f"map<string,{kind}>")
    return rows.withColumn("_m", held).select(*[c for c in rows.columns if c != column], F.explode("_m").alias("name", "value"))


def elements(rows: DataFrame, column: str, path: str, kind: str) -> DataFrame:
    """A row per element of the array at ``path``: ``at`` (from 0) and ``value``, as from
    ``days[]``; rows without such an array give none."""
    held = F.try_variant_get(column, path, f"array<{kind}>")
    return rows.withColumn("_a", held).select(*[c for c in rows.columns if c != column], F.posexplode("_a").alias("at", "value"))
