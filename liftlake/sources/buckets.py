"""Keyed tables in hash buckets with commit records, and append logs by batch.

``BucketTable`` (IO7): rows live in a fixed number of hash buckets of the key.
An upsert reads and rewrites only the buckets that its keys fall into, under
``data/batch=<id>/bucket=<b>``, and then commits a small record that names the
newest batch of every bucket. Readers follow the newest record, so a batch that
died before its commit is invisible, and a retried batch rewrites its own files
and gives the same table.

``BatchLog`` (IO6): append-only; batch ``id`` owns ``batch=<id>`` and a retry
overwrites exactly that. Directories without ``_SUCCESS`` are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlake.schema import KEY
from liftlake.sources.store import _children


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or absent: written aside, then renamed."""
    fs, aside = _path(spark, f"{path}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = _path(spark, path)[1]
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(aside, final):
        raise OSError(f"cannot commit {path}")


def _struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


class BucketTable:
    """A table with one row per key. ``schema`` includes the key columns; ``buckets`` is fixed for a table's life
    (about as many as tasks that should rewrite it at once)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: Sequence[str] = KEY, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), tuple(key), buckets
        self.schema = _struct(spark, schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _commit(self, before: int | None) -> dict[int, int]:
        """Bucket -> batch that holds its newest rows; at most ``buckets`` entries."""
        ids = sorted(int(n[:-5]) for n in _children(self.spark, f"{self.root}/commits") if n.endswith(".json") and not n.startswith("."))
        ids = [i for i in ids if before is None or i < before]
        if not ids:
            return {}
        rows = self.spark.read.text(f"{self.root}/commits/{ids[-1]}.json", wholetext=True).collect()
        record = json.loads(rows[0][0])
        if record["buckets"] != self.buckets:
            raise ValueError(f"table has {record['buckets']} buckets, not {self.buckets}")
        return {int(b): i for b, i in record["batches"].items()}

    def _read(self, batches: dict[int, int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/batch={i}/bucket={b}" for b, i in sorted(batches.items())])

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the rows of ``keys``: at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table as committed (by batches below ``before``); ``only``: these buckets."""
        batches = self._commit(before)
        return self._read(batches if only is None else {b: i for b, i in batches.items() if b in set(only)})

    def upsert(self, updates: DataFrame, batch: int, touched: Sequence[int] | None = None) -> None:
        """Rows of ``updates`` (unique on the key) replace those of their keys; safe to repeat with the same ``batch``.

        ``touched``: buckets known to hold all keys of ``updates``; found by a pass over them otherwise."""
        updates = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        before = self._commit(batch)
        only = list(self.touched(updates) if touched is None else touched)
        if only:
            old = self._read({b: i for b, i in before.items() if b in set(only)})
            new = updates.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            kept = old.join(new, [old[k].eqNullSafe(new[f"_k_{k}"]) for k in self.key], "left_anti")     # a null key is a key
            path = f"{self.root}/data/batch={batch}"
            (kept.unionByName(updates).withColumn("bucket", self._bucket()).repartition(len(only), "bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(path))
            only = [int(n[7:]) for n in _children(self.spark, path) if n.startswith("bucket=")]      # those that hold rows
        record = {"buckets": self.buckets, "batches": before | {b: batch for b in only}}
        _write_text(self.spark, f"{self.root}/commits/{batch}.json", json.dumps(record))


class BatchLog:
    """An append-only table, one directory per batch."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), _struct(spark, schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def batch(self, batch: int) -> DataFrame:
        """The rows of one written batch."""
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch={batch}")

    def read(self, upto: int | None = None) -> DataFrame:
        """All complete batches, or those up to ``upto``."""
        ids = sorted(int(n[6:]) for n in _children(self.spark, self.root) if n.startswith("batch=") and "_SUCCESS" in _children(self.spark, f"{self.root}/{n}"))
        paths = [f"{self.root}/batch={i}" for i in ids if upto is None or i <= upto]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
