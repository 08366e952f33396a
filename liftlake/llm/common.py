"""Helpers shared by the training-data operators.

``stored`` cuts lineage with a Parquet table in the shared folder named by
``spark.checkpoint.dir``; ``keep_rows`` applies per-row decisions to a table;
``numbered`` gives gapless positions without gathering a key in one task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlake.session import checkpoint_dir

# ASCII white space of the contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

# Rows per Arrow batch handed to Python: bounds a batch by 512 texts, so that
# a run of megabyte texts still fits a worker.
BATCH_ROWS = 512

# Spark's setting that drops the shuffle files of a query as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Rows numbered by one window group: 2 ** CELL_BITS.
CELL_BITS = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Every executor sees the files, so a lost one costs a re-read only; row
    identifiers made from partition numbers are fixed from here on. Nothing
    reads the shuffles of the write again, so Spark drops their files as it ends."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*read: DataFrame, keep: Sequence[DataFrame] = ()) -> None:
    """Delete the tables of ``stored`` that ``read`` reads and none of ``keep`` does: nothing may read them again."""
    def folders(frames: Sequence[DataFrame]) -> set[str]:
        return {m[0] for df in frames for x in df.inputFiles() if (m := re.match(r".*/llm-[^/]+-[0-9a-f]{32}(?=/)", x))}

    spark = read[0].sparkSession
    for at in folders(read) - folders(keep):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_ROWS`` rows for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def text_key(text: Column) -> Column:
    """64-bit key of the exact text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def to_signed(values) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark longs."""
    return np.array(values, np.uint64).view(np.int64)


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions(doc_id, text_key, kept)`` keep.

    ``decisions`` has one row per row of ``docs``. Only rows with something to
    drop take part in the join. Repeated rows (one doc_id, one text) of which
    some stay are reduced to one; which of them stays is open where other
    columns differ."""
    dropped = stored(
        decisions.groupBy("doc_id", "text_key")
        .agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
        .filter(~F.col("every")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "some"), "dropped")
    rows = whole_rows(docs, text_key(F.col("text")).alias("text_key"), "doc_id")
    match = rows["doc_id"].eqNullSafe(dropped["id"]) & (rows["text_key"] == dropped["key"])
    kept = rows.join(dropped, match, "left_anti").select("row.*")
    if dropped.filter("some").isEmpty():
        return kept
    repeats = dropped.filter("some")
    once = rows.join(repeats, rows["doc_id"].eqNullSafe(repeats["id"]) & (rows["text_key"] == repeats["key"]), "left_semi")
    return kept.unionByName(once.dropDuplicates(["doc_id", "text_key"]).select("row.*"))


def whole_rows(docs: DataFrame, *more) -> DataFrame:
    """Each row as one struct column ``row`` beside ``more``: no name in it can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: gapless positions from 0 among the rows of each ``key`` (not null).

    The rows are stored with a row number, whose high bits name a cell of at
    most 2 ** CELL_BITS rows that one task wrote. A window then numbers the rows
    of each (key, cell), and a window over one row per (key, cell) gives the
    offsets; a key holding every row is still numbered by all tasks."""
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "unnumbered")
    df = df.withColumn("_cell", F.shiftright("_row", CELL_BITS))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_cell").count()
    offsets = counts.select(key, "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_cell").orderBy("_row")) - 1)
    return (inside.join(offsets, [key, "_cell"])
            .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
            .drop("_cell", "_row", "_inside", "_before"))
