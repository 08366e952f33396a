"""Spark session helpers.

The library never builds a cluster session itself: callers pass theirs in.
``local_session`` exists for tests and the bench; ``checkpoint_dir`` reads the
shared checkpoint folder the cluster names and only falls back to a scratch
folder when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI arithmetic, UTC wall clock, AQE.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "liftlake",
                  extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("LIFTLAKE_DRIVER_MEMORY", "16g")))
    for k, v in {**CORE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` if set.

    Only when a local session names none (tests) is a fresh scratch folder
    created and registered. On a cluster a folder of the driver's own disk
    would not be seen by the executors, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="liftlake-ckpt-", dir="/tmp")
    try:  # record it where later readers look; some sessions refuse core keys
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:
        pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_COSTLY = ("Join", "Window", "Aggregate", "Union", "Generate", "Expand")


def is_costly(df) -> bool:
    """True when re-running ``df`` means shuffles, joins or windows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(tok in plan for tok in _COSTLY)


def materialize(df, force: bool = False):
    """Cut the lineage of a costly intermediate that several passes read.

    A reliable, eager ``checkpoint()`` into the shared checkpoint folder: the
    later passes read files instead of recomputing joins and windows, and a
    lost executor costs a re-read, not a recompute. Plain scans are returned
    as they are (re-reading them is as cheap as reading a checkpoint)."""
    if not force and not is_costly(df):
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []

# Spark's setting that drops the shuffle files of a query as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES = threading.Lock()
_BEFORE: list[str] = []         # the setting before the first of the writes under way, once for each


@contextmanager
def _shuffles_dropped(spark):
    """Queries made inside drop their shuffle files as they end; threads may overlap."""
    with _WRITES:
        _BEFORE.append(_BEFORE[0] if _BEFORE else spark.conf.get(SHUFFLE_CLEANUP))
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _WRITES:
            before = _BEFORE.pop()
            if not _BEFORE:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df):
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    For tables that several passes read in part: unlike a checkpoint the files are
    columnar, so later passes read only their columns and filters reach the scan.
    Nothing reads the shuffles of the write again, so their files are dropped as it ends.
    ``release`` deletes tables that are read no more, ``drop_stored`` all of this process."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/liftlake-stored/{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*read, keep=()) -> None:
    """Delete the tables of ``stored`` that ``read`` reads and none of ``keep`` does: nothing may read them again."""
    def tables(frames) -> set[str]:
        return {m[1] for df in frames for x in df.inputFiles() if (m := re.search(r"/liftlake-stored/([0-9a-f]{32})/", x))}

    gone = tables(read) - tables(keep)
    for path in [p for p in _STORED if p.rsplit("/", 1)[1] in gone]:
        _STORED.remove(path)
        _delete(read[0].sparkSession, path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables ``stored`` has written; results that still read them must be done."""
    n = 0
    while _STORED:
        n += bool(_delete(spark, _STORED.pop()))
    return n


BROADCAST_BYTES = 32 << 20


def broadcast_checked(df, max_bytes: int = BROADCAST_BYTES):
    """``df`` stored, with a broadcast hint when its measured size is at most
    ``max_bytes`` (text length and 16 bytes a value); else a plain table, joined by shuffle."""
    from pyspark.sql import functions as F
    table = materialize(df, force=True)
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0))
    measured = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if measured <= max_bytes else table
