"""Series out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import divided
from ..operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per return flag, a bar per shipping day."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return B.to_bars(table(spark, sf_dir, "lineitem"), "l_returnflag", F.to_date("l_shipdate"), "l_extendedprice", order)


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per market segment, a bar per week of orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers.select("c_custkey", "c_mktsegment"), orders.o_custkey == F.col("c_custkey"))
    return B.to_bars(joined, "c_mktsegment", F.to_date(F.date_trunc("week", "o_orderdate")), "o_totalprice", ["o_orderkey"])


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per event type, a bar per hour."""
    return B.to_bars(table(spark, sf_dir, "events"), "event_type", F.date_trunc("hour", "ts"), "value", ["event_id"])


def proxy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly reports per region of suppliers: price, nav, volume, aum, net position."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    suppliers, nations, regions = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey).select("s_suppkey", "s_acctbal", "r_name")
    joined = items.join(places, items.l_suppkey == places.s_suppkey).join(parts.select("p_partkey", "p_retailprice"), items.l_partkey == F.col("p_partkey"))
    side = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    reports = joined.groupBy(F.col("r_name").alias("series_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("time")).agg(
        F.avg(divided(F.col("l_extendedprice"), F.col("l_quantity"))).alias("price"), F.avg("p_retailprice").alias("nav"), F.sum("l_quantity").alias("volume"), F.sum("s_acctbal").alias("aum"), F.sum(side).alias("net")
    )
    return B.numbered(reports)
