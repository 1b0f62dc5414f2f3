"""The corpus pipeline: judge quality, drop near-duplicates, redact secrets, pack.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``
and is what the stage before kept; all but the last return those columns. Null and empty
texts pass every stage as the operators define it; an empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import order_minhash, packing, quality, secrets
from tidemark.llm.common import drop, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    rules = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), rules).where(F.col("score") >= 0.5).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.deduplicated(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", judge), ("near_dedup", deduplicate), ("secrets", redact), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        fresh = store(stage(spark, docs, sf_dir), name)
        drop(docs)
        docs = fresh
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fitting and iterative joins: SQL can't express it; tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
