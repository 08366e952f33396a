"""Structured Streaming jobs (ST1-ST3).

ST1 ``session_ingest``: a stream of logged sessions, validated (PF20), with
the backward load delta (W1) computed against per-(user, lift) state -- the
last accepted (ts, event_id, weight) -- kept by ``applyInPandasWithState``.
Events at or before the state's last position are late: they are emitted
with ``late = true`` (and no delta) instead of rewriting history; a batch
rerun recomputes them.

ST2 ``quality_refresh`` and ST3 ``calibration_refresh`` run the batch
operators on each micro-batch with ``foreachBatch`` and write versioned
snapshots keyed by the batch id, so a retried batch rewrites the same
version (idempotent) and a lost executor only costs a retry.
"""

from __future__ import annotations

import os
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from liftlake.session import checkpoint_dir

INGEST_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("compound", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
    T.StructField("weight", T.DoubleType()), T.StructField("reps", T.IntegerType()),
    T.StructField("rpe", T.DoubleType()), T.StructField("load_delta", T.DoubleType()),
    T.StructField("seq", T.IntegerType()), T.StructField("late", T.BooleanType()),
])
INGEST_STATE = T.StructType([
    T.StructField("last_ts_us", T.LongType()), T.StructField("last_event_id", T.LongType()),
    T.StructField("last_weight", T.DoubleType()), T.StructField("count", T.LongType()),
])


def _ingest_group(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per key and micro-batch: order the new rows, chain deltas from state.

    Sorted by (ts, event_id), the late rows (at or before the state's last
    position) form a prefix; the rest get vectorised deltas."""
    batch = pd.concat(list(pdfs), ignore_index=True)
    if batch.empty:
        return
    batch = batch.sort_values(["ts", "event_id"], kind="mergesort").reset_index(drop=True)
    ts_us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    eid = batch["event_id"].to_numpy()
    if state.exists:
        last_ts, last_id, last_w, count = state.get
        late = (ts_us < last_ts) | ((ts_us == last_ts) & (eid <= last_id))
    else:
        last_ts, last_id, last_w, count = None, None, None, 0
        late = np.zeros(len(batch), dtype=bool)
    w = batch["weight"].to_numpy(dtype="float64", na_value=np.nan)
    acc = ~late
    wa = w[acc]
    prev = np.concatenate([[np.nan if last_w is None else last_w], wa[:-1]])
    delta = wa - prev
    if count == 0 and len(delta):
        delta[0] = 0.0
    delta = np.where(np.isnan(delta), 0.0, delta)  # diff().fillna(0)
    out = batch[["user_id", "compound", "ts", "event_id", "weight", "reps", "rpe"]].copy()
    load_delta = np.full(len(batch), np.nan)
    load_delta[acc] = delta
    seq = np.zeros(len(batch), dtype="int64")
    seq[acc] = count + np.arange(1, acc.sum() + 1)
    out["load_delta"] = pd.array(np.where(acc, load_delta, np.nan), dtype="Float64")
    out.loc[late, "load_delta"] = pd.NA
    out["seq"] = pd.array(seq, dtype="Int32")
    out.loc[late, "seq"] = pd.NA
    out["late"] = late
    if acc.any():
        k = np.flatnonzero(acc)[-1]
        lw = w[k]
        state.update((int(ts_us[k]), int(eid[k]), None if np.isnan(lw) else float(lw), int(count + acc.sum())))
    yield out


def session_ingest(stream: DataFrame) -> DataFrame:
    """ST1: streaming sessions -> accepted/late rows with W1 deltas.

    ``stream`` has the session columns (user_id, compound, ts, event_id,
    weight, reps, rpe). Invalid rows (PF20) are dropped before state."""
    valid = stream.where(F.col("weight").isNotNull() & (F.col("weight") > 0)
                         & F.col("reps").isNotNull() & (F.col("reps") > 0))
    return (valid.select("user_id", "compound", "ts", "event_id", "weight", "reps", "rpe")
            .groupBy("user_id", "compound")
            .applyInPandasWithState(_ingest_group, INGEST_OUT, INGEST_STATE, "append",
                                    GroupStateTimeout.NoTimeout))


def sessions_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The sessions adapter over a streaming read of ``events``."""
    from liftlake.sources.adapters import EVENT_COMPOUND
    from liftlake.functions.scalar import nan_to_null
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(src).schema
    # the file source watches a directory; a glob filter picks the table
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ev = reader.parquet(sf_dir).where(F.col("event_type").isin([e for e, _ in EVENT_COMPOUND]))
    compound = None
    for e, c in EVENT_COMPOUND:
        compound = (F.when(F.col("event_type") == e, F.lit(c)) if compound is None
                    else compound.when(F.col("event_type") == e, F.lit(c)))
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return ev.select("user_id", compound.alias("compound"), "ts", "event_id", nan_to_null("value").alias("weight"),
                     (k % 12 + 1).cast("int").alias("reps"),
                     F.when(k % 10 == 0, F.lit(None).cast("double"))
                      .otherwise(F.lit(5.0) + (k % 11).cast("double") * F.lit(0.5)).alias("rpe"))


def run_to_table(stream_df: DataFrame, name: str, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Drive a stream to completion (availableNow) into a Parquet table in the
    shared folder and read it back: the result never passes the driver."""
    import uuid
    root = os.path.join(checkpoint_dir(spark), "streams", f"{name}_{uuid.uuid4().hex[:8]}")
    out = os.path.join(root, "table")
    q = (stream_df.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint or os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


# -- ST2 / ST3 ---------------------------------------------------------------------------
def _batch_dir(root: str, table: str, epoch: int) -> str:
    return os.path.join(root, table, f"batch={epoch}")


def _read_upto(spark: SparkSession, root: str, table: str, epoch: int, schema: T.StructType) -> DataFrame:
    """Append-only table: every batch directory up to and including ``epoch``."""
    from liftlake.sources.store import _children as children
    path = os.path.join(root, table)
    if not children(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", T.LongType()) if "batch" not in schema.names else schema) \
        .parquet(path).where(F.col("batch") <= epoch).drop("batch")


def quality_refresh(stream: DataFrame, root: str, checkpoint: str):
    """ST2: per micro-batch (event-sourced, append-only):

    * close the newest pending audit of each key in the batch with the
      batch's newest session (J8) -> ``closures/batch=<e>``;
    * log the batch's newest session per key as a pending audit (R4)
      -> ``audit/batch=<e>``;
    * refresh model quality (A10) for the keys the batch touched only and
      upsert them into the quality snapshot ``quality/v=<e>`` (IO7).

    Re-running batch e overwrites exactly its own outputs."""
    from liftlake.operators.quality import gate_scores, init_ledger
    from liftlake.operators.recommend import log_newest_sessions
    from liftlake.operators.sequence import last_per_key
    from liftlake.schema import AUDIT_SCHEMA, GateParams, KEY, MODEL_QUALITY_SCHEMA
    from liftlake.sources.store import read_snapshot, upsert

    closure_schema = T.StructType([T.StructField("event_id", T.LongType()),
                                   T.StructField("actual_weight", T.DoubleType()),
                                   T.StructField("accuracy_delta", T.DoubleType())])

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(*KEY).distinct()
        rows = _read_upto(spark, root, "audit", epoch - 1, T.StructType(list(AUDIT_SCHEMA.fields)))
        closed = _read_upto(spark, root, "closures", epoch - 1, closure_schema)
        touched = rows.join(keys, list(KEY), "left_semi")
        pending = touched.where(F.col("prediction_status") == "pending").join(closed, "event_id", "left_anti")
        newest_pending = last_per_key(pending, cols=["event_id", "recommended_weight"])
        newest = last_per_key(batch, cols=["weight"])
        closures = newest_pending.join(newest, list(KEY)).select(
            "event_id", F.col("weight").alias("actual_weight"),
            (F.col("weight") - F.col("recommended_weight")).alias("accuracy_delta"))
        closures.write.mode("overwrite").parquet(_batch_dir(root, "closures", epoch))
        # the previous session of a key may be in an earlier batch: keep the
        # newest session per key as a small snapshot and log against it
        last_cols = ["user_id", "compound", "ts", "event_id", "weight", "reps", "rpe"]
        prior = read_snapshot(spark, os.path.join(root, "last_session"), before=epoch)
        window_rows = batch.select(*last_cols)
        if prior is not None:
            window_rows = window_rows.unionByName(prior.select(*last_cols).join(keys, list(KEY), "left_semi"))
        new = log_newest_sessions(window_rows).select(
            *KEY, "ts", "event_id", "weight", "reps", "rpe", "deviation_reason", "prediction_source",
            "recommended_weight", F.lit(None).cast("double").alias("actual_weight"),
            F.lit(None).cast("double").alias("accuracy_delta"), "prediction_status")
        new.write.mode("overwrite").parquet(_batch_dir(root, "audit", epoch))
        newest_rows = last_per_key(batch, cols=last_cols[2:]).select(*last_cols)
        upsert(prior.select(*last_cols) if prior is not None else None, newest_rows).write.mode("overwrite") \
            .parquet(os.path.join(root, "last_session", f"v={epoch}"))
        # the audit view of the touched keys after this batch
        rows = _read_upto(spark, root, "audit", epoch, T.StructType(list(AUDIT_SCHEMA.fields)))
        closed = _read_upto(spark, root, "closures", epoch, closure_schema)
        view = rows.join(keys, list(KEY), "left_semi").join(
            closed.withColumnsRenamed({"actual_weight": "_aw", "accuracy_delta": "_ad"}), "event_id", "left")
        done = F.col("_aw").isNotNull()
        view = view.withColumns({
            "actual_weight": F.when(done, F.col("_aw")).otherwise(F.col("actual_weight")),
            "accuracy_delta": F.when(done, F.col("_ad")).otherwise(F.col("accuracy_delta")),
            "prediction_status": F.when(done, F.lit("complete")).otherwise(F.col("prediction_status")),
        }).drop("_aw", "_ad")
        params = GateParams()
        scores = gate_scores(view, params).where(F.col("n") >= params.min_records).select(
            *KEY, F.col("n").cast("int").alias("session_count"), "model_mape", "rule_mape", "model_enabled")
        current = read_snapshot(spark, os.path.join(root, "quality"), before=epoch)
        base = init_ledger(keys, current) if current is not None else init_ledger(keys)
        out = upsert(base.select(*[f.name for f in MODEL_QUALITY_SCHEMA.fields]), scores)
        out.write.mode("overwrite").parquet(os.path.join(root, "quality", f"v={epoch}"))

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def calibration_refresh(stream: DataFrame, root: str, checkpoint: str):
    """ST3: per micro-batch, append the batch to the history
    (``history/batch=<e>``), then re-score, cadence-check and refit only the
    keys the batch touched, and upsert them into the calibration snapshot
    ``calibration/v=<e>`` (A14, A13, IO7)."""
    from liftlake.operators.calibrate import calibrate, stand_in_scores
    from liftlake.schema import CALIBRATION_SCHEMA, KEY, SESSION_SCHEMA
    from liftlake.sources.store import read_snapshot, upsert

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*[f.name for f in SESSION_SCHEMA.fields])
        rows.write.mode("overwrite").parquet(_batch_dir(root, "history", epoch))
        keys = rows.select(*KEY).distinct()
        hist = _read_upto(spark, root, "history", epoch, T.StructType(list(SESSION_SCHEMA.fields)))
        touched = hist.join(keys, list(KEY), "left_semi")
        state = read_snapshot(spark, os.path.join(root, "calibration"), before=epoch)
        cols = [f.name for f in CALIBRATION_SCHEMA.fields]
        prior = state.select(*cols).join(keys, list(KEY), "left_semi") if state is not None else None
        new = calibrate(stand_in_scores(touched), prior).select(*cols)
        upsert(state.select(*cols) if state is not None else None, new).write.mode("overwrite").parquet(
            os.path.join(root, "calibration", f"v={epoch}"))

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
