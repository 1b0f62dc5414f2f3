"""The archive's join by address where one payload is in a third of all rows."""

from pyspark.sql import functions as F

from tidemark.llm import common, warc


def test_a_hot_address_is_split(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    settings = dict(zip(held, ("64k", "64k", "false", "40"), strict=True))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        payload = F.when(F.col("id") % 2 == 0, F.lit("one page that everybody has")).otherwise(F.concat(F.lit("page "), F.col("id").cast("string")))
        pages = spark.range(0, 60_000, 1, 12).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), payload.alias("html"))
        narrow = warc.described(pages).drop("payload")
        keeper = common.store(narrow.groupBy("address").agg(F.max("page_id").alias("keeper")), "keepers")
        joined = warc.with_keeper(narrow, keeper)
        frame = joined.select("page_id", "keeper")
        rows = frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        assert len(rows) == 60_000 and all(r["keeper"] == (59_998 if r["page_id"] % 2 == 0 else r["page_id"]) for r in rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
