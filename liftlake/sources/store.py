"""Sources and sinks (IO1-IO8): CSV exports and histories, personalization
JSON documents, snapshot tables with keyed upserts, prediction logs, models.

Tables are directories of Parquet files. Keyed tables are written as new
snapshots (``<root>/v=<n>``) rather than overwritten in place, so a job that
reads version n and writes n+1 can be retried after losing executors.
"""

from __future__ import annotations

import json
import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlake.functions.scalar import local_table
from liftlake.operators.scan import KeyedScan
from liftlake.schema import (BASELINE_COLUMNS, COMPOUNDS, KEY, ORDER)


# -- IO1 ----------------------------------------------------------------------------
def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw export: header row, every column read as a string (coercion is
    the cleaning step's job). Columns missing from a file are simply absent."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_baseline_csv(spark: SparkSession, path: str) -> DataFrame:
    """The compact per-user baseline layout, renamed to session columns."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in BASELINE_COLUMNS])
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.withColumnsRenamed(BASELINE_COLUMNS)
    return df.withColumns({c: F.col(c).try_cast("double") for c in ("weight", "set_volume")}) \
             .withColumn("reps", F.col("reps").try_cast("int"))


# -- IO2 ----------------------------------------------------------------------------
HISTORY_SCHEMA = T.StructType([
    T.StructField("weight", T.DoubleType()), T.StructField("reps", T.DoubleType()),
    T.StructField("rpe", T.DoubleType()), T.StructField("load_delta", T.DoubleType()),
])


def read_histories(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<root>/<user>/<user>_<lift>_history.csv`` as one table.

    The user and lift come from the path; ``seq`` is the row's position in
    its file (file order is the only order these files have)."""
    df = (spark.read.option("header", True).schema(HISTORY_SCHEMA)
          .csv(os.path.join(root, "*", "*_history.csv"))
          .withColumn("_path", F.col("_metadata.file_path"))
          .withColumn("_row", F.monotonically_increasing_id()))
    user = F.regexp_extract("_path", r"/([^/]+)/[^/]+_history\.csv$", 1)
    fname = F.regexp_extract("_path", r"/([^/]+)_history\.csv$", 1)
    compound = F.expr("substring(_f, length(_u) + 2)")
    df = df.withColumns({"_u": user, "_f": fname}).withColumn("compound", compound) \
           .withColumn("user", F.col("_u"))
    w = F.row_number().over(Window.partitionBy("_path").orderBy("_row"))
    return df.withColumn("seq", w.cast("int")).withColumn("reps", F.col("reps").cast("int")) \
             .select("user", "compound", "seq", "weight", "reps", "rpe", "load_delta")


_LONG_HISTORY = T.StructType([T.StructField("user", T.StringType()), T.StructField("compound", T.StringType()),
                              T.StructField("seq", T.IntegerType()), *HISTORY_SCHEMA.fields])


def write_histories(sessions: DataFrame, root: str, user_col: str = "user") -> None:
    """Histories of many users as range-partitioned CSV files with an explicit
    ``seq``: the number of files follows the size of the data, not the number of
    users, and no order has to be read off a file (see ``read_partitioned_histories``)."""
    columns = [F.col(user_col).cast("string").alias("user"), *[F.col(f.name).cast(f.dataType) for f in _LONG_HISTORY.fields[1:]]]
    (sessions.select(*columns).repartitionByRange("user", "compound", "seq").sortWithinPartitions("user", "compound", "seq")
     .write.mode("overwrite").option("header", True).csv(root))


def read_partitioned_histories(spark: SparkSession, root: str) -> DataFrame:
    """Histories written by ``write_histories``: one scan, no window."""
    return spark.read.option("header", True).schema(_LONG_HISTORY).csv(root).withColumn("reps", F.col("reps").cast("int"))


# -- IO3 / IO4 ---------------------------------------------------------------------
PERSONALIZATION_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("scaling_factors", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("baseline_offsets", T.MapType(T.StringType(), T.DoubleType())),
    # a number or {"trend": number} depending on the document's layout
    T.StructField("trend_modifiers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("calibration_meta", T.MapType(T.StringType(), T.StructType([
        T.StructField("last_calibrated_size", T.IntegerType()), T.StructField("runs", T.IntegerType())]))),
    T.StructField("last_calibration_n", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("calibration_runs", T.MapType(T.StringType(), T.IntegerType())),
])


def read_personalization(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """All personalization documents as rows (user_id, compound, a, b, trend,
    last_calibrated_size, runs), tolerant of the three layouts. A document
    without ``user_id`` takes its folder name. One document per file, or one
    per line (``lines``), as ``write_personalization`` leaves them."""
    docs = (spark.read.option("multiLine", not lines).schema(PERSONALIZATION_SCHEMA).json(pattern)
            .withColumn("_path", F.col("_metadata.file_path")))
    uid = F.coalesce(F.col("user_id"), F.regexp_extract("_path", r"/([^/]+)/[^/]+\.json$", 1))
    keys = F.array_distinct(F.concat(
        F.coalesce(F.map_keys("scaling_factors"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("baseline_offsets"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("calibration_meta"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("last_calibration_n"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("trend_modifiers"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("calibration_runs"), F.array().cast("array<string>"))))
    rows = docs.withColumn("user_id", uid).select("*", F.explode(keys).alias("compound"))
    trend_raw = F.col("trend_modifiers")[F.col("compound")]
    meta = F.col("calibration_meta")[F.col("compound")]
    return rows.select(
        "user_id", "compound",
        F.coalesce(F.col("scaling_factors")[F.col("compound")], F.lit(1.0)).alias("a"),
        F.coalesce(F.col("baseline_offsets")[F.col("compound")], F.lit(0.0)).alias("b"),
        F.coalesce(trend_raw.try_cast("double"), F.get_json_object(trend_raw, "$.trend").try_cast("double"),
                   F.lit(1.0)).alias("trend"),
        F.coalesce(meta["last_calibrated_size"], F.col("last_calibration_n")[F.col("compound")],
                   F.lit(0)).alias("last_calibrated_size"),
        F.coalesce(meta["runs"], F.col("calibration_runs")[F.col("compound")], F.lit(0)).alias("runs"))


def personalization_documents(state: DataFrame) -> DataFrame:
    """IO4: calibration rows back to one document per user (the current
    layout). Each user has at most one entry per compound (four)."""
    def entries(v):
        return F.map_from_entries(F.collect_list(F.struct(F.col("compound"), v)))
    return state.groupBy("user_id").agg(
        entries(F.col("a")).alias("scaling_factors"),
        entries(F.col("b")).alias("baseline_offsets"),
        entries(F.coalesce(F.col("trend"), F.lit(1.0)) if "trend" in state.columns else F.lit(1.0))
        .alias("trend_modifiers"),
        entries(F.struct(F.col("last_calibrated_size").cast("int").alias("last_calibrated_size"),
                         F.col("runs").cast("int").alias("runs"))).alias("calibration_meta"))


def write_personalization(state: DataFrame, path: str, users_per_file: int = 1_000_000) -> None:
    """One document per line, user id included, in files of a bounded number of users."""
    (personalization_documents(state).write.mode("overwrite")
     .option("maxRecordsPerFile", users_per_file).json(path))


# -- IO5 ------------------------------------------------------------------------------
def write_processed(df: DataFrame, path: str, partition_by: Sequence[str] = ("compound",),
                    fmt: str = "parquet") -> None:
    """Processed tables partitioned by lift (not by user: that would make
    one small file per user)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


# -- snapshots and IO7 ---------------------------------------------------------------
def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path`` in the file system the path belongs to; none if it is absent."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    names = [n for n in _children(spark, root) if n.startswith("v=")]
    return sorted(int(n[2:]) for n in names if "_SUCCESS" in _children(spark, f"{root}/{n}"))


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None,
                  before: int | None = None) -> DataFrame | None:
    """Newest complete snapshot (one with ``_SUCCESS``), or None; with
    ``before`` only versions below it (a retried batch ignores its own
    earlier partial output)."""
    versions = [v for v in _versions(spark, root) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(os.path.join(root, f"v={versions[-1]}"))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write the next version; readers of the previous one are unaffected."""
    versions = _versions(df.sparkSession, root)
    path = os.path.join(root, f"v={(versions[-1] + 1) if versions else 0}")
    df.write.mode("overwrite").parquet(path)
    return path


def upsert(current: DataFrame | None, updates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """IO7: keyed upsert as a full outer join; new values win, untouched keys
    keep theirs. ``updates`` must be unique on the key."""
    if current is None:
        return updates
    cols = [c for c in current.columns if c not in key]
    u = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols if c in updates.columns],
                       F.lit(True).alias("_hit"))
    j = current.join(u, list(key), "full_outer")
    return j.select(*key, *[
        (F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in updates.columns else F.col(c)).alias(c)
        for c in cols])


# -- IO6 ------------------------------------------------------------------------------
def prediction_rows(scored: DataFrame, source: str = "model", raw: str = "raw_pred",
                    adjusted: str = "adjusted", actual: str = "y", hot_rows: int | None = None) -> DataFrame:
    """IO6: prediction log rows; ``session_index`` is the 0-based position of
    the session in its key's history; absent inputs are NULL."""
    scan = KeyedScan.build(scored, KEY, ORDER, hot_rows)
    df = scan.finish(scan.with_seq(scan.df, "_seq"))
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.select(
        F.col("event_id").alias("id"), *KEY, (F.col("_seq") - 1).cast("int").alias("session_index"),
        col(raw).alias("predicted_raw"), col(adjusted).alias("predicted_adjusted"), col(actual).alias("actual"),
        F.lit(source).alias("source"), F.col("ts").alias("created_at"))


def append_predictions(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").partitionBy("compound").parquet(root)


# -- IO8 ------------------------------------------------------------------------------
def save_model(model, path: str, metadata: dict, overwrite: bool = True) -> None:
    """A fitted ``PipelineModel`` plus a metadata document next to it."""
    spark = SparkSession.getActiveSession()
    if not overwrite and _children(spark, path):
        raise FileExistsError(path)
    w = model.write()
    (w.overwrite() if overwrite else w).save(os.path.join(path, "model"))
    local_table(spark, [(json.dumps(metadata, sort_keys=True),)], ["doc"], ["string"]) \
         .coalesce(1).write.mode("overwrite").text(os.path.join(path, "metadata"))


def load_model(path: str):
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
    return PipelineModel.load(os.path.join(path, "model")), meta


__all__ = [n for n in dir() if not n.startswith("_")] + ["COMPOUNDS"]
