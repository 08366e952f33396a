"""The corpus pipeline: quality rules, exact and near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet in the shared folder and rereads as the next one's docs. All
stages but the last return the columns of ``docs``; whole rows travel as one
struct, so extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm import exact_dedup, mixing, packing, quality_rules, simhash
from liftlake.llm.common import keep_rows, stored, table, whole_rows
from liftlake.llm.queries import vocabulary

#: A source is read at most this many times as often as the least repeated one.
MAX_REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or the learned decision list rejects."""
    judged = quality_rules.judge(whole_rows(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest doc_id of each group of equal texts."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs, key_all=False))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates."""
    return keep_rows(docs, simhash.near_dedup(docs, shingle=3, max_distance=3))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources up to their weight; every document appears at least once."""
    return mixing.mix(whole_rows(docs, "doc_id", "text", "source"), max_repeats=MAX_REPEATS).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 2048: one row per piece."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("pack", pack)]

# Learned rules, XXH64 fingerprints and token ids have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
