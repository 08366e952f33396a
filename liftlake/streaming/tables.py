"""Streaming jobs that keep tables (ST1, ST2, ST3): the same result however the stream is cut.

Every job runs DataFrame operators on a micro-batch (``foreachBatch``) beside a
carried state of bounded size per key, kept in a ``BucketTable``. A batch reads and
rewrites only the buckets of its keys and never its own history. The carried rows
of a key are put in front of its new ones, so that chains (previous session, next
session) run through one ``KeyedScan``: a key that holds a third of a batch is
split over tasks like in the batch operators.

All outputs are written per batch id: a retried batch rewrites its own files.
Sessions at or before their key's last position are late; they are logged as such and
change nothing else. A null in the key is a value like any other. Within a batch the order is (ts, event_id).

* ``ingest_sessions`` (ST1): every input row is accepted, with load delta and position,
  rejected with the reason (PF20) or late.
* ``refresh_quality_stream`` (ST2): every session gets an audit row (R4) and
  completes the pending audit before it (J8); the gate (A10) is refreshed from the
  newest usable audits of the keys the batch touched.
* ``refresh_calibration_stream`` (ST3): the affine fit (A13) with its cadence (A14)
  decided at every event, not per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions.scalar import rule_progression
from liftlake.operators.calibrate import fit_affine, stand_in_scores
from liftlake.operators.clean import validate_sessions
from liftlake.operators.quality import gate_scores, init_ledger
from liftlake.operators.scan import KeyedScan
from liftlake.operators.sequence import last_n
from liftlake.schema import DEVIATION_REASONS, KEY, MODEL_QUALITY_SCHEMA, ORDER, CalibrationConfig, GateParams, RuleParams
from liftlake.sources.buckets import BatchLog, BucketTable

Step = Callable[[DataFrame, int], None]


_SESSION = "user_id bigint, compound string, ts timestamp_ntz, event_id bigint, weight double, reps int, rpe double"
_SESSION_COLS = ["user_id", "compound", "ts", "event_id", "weight", "reps", "rpe"]


def run(stream: DataFrame, step: Step, checkpoint: str) -> None:
    """Process all that the stream holds now; the checkpoint numbers the batches."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _by_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the key, a null in it matching a null; the key columns are left's."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in KEY})
    return left.join(right, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in KEY], how).drop(*[f"_k_{k}" for k in KEY])


def _marked_late(batch: DataFrame, state: DataFrame) -> DataFrame:
    """``late``: the row is at or before the carried last position of its key."""
    last = state.select(*KEY, F.struct("ts", "event_id").alias("_last"))
    late = F.coalesce(F.struct("ts", "event_id") <= F.col("_last"), F.lit(False))
    return _by_key(batch, last).withColumn("late", late).drop("_last")


# -- ST1 ---------------------------------------------------------------------------------
def strict(batch: DataFrame) -> DataFrame:
    """PF20 in full; a stream without a deviation reason logs normal sessions."""
    if "deviation_reason" not in batch.columns:
        batch = batch.withColumn("deviation_reason", F.lit("normal"))
    return validate_sessions(batch, DEVIATION_REASONS)


class IngestTables:
    def __init__(self, spark: SparkSession, root: str):
        self.accepted_log = BatchLog(spark, f"{root}/accepted", _SESSION + ", load_delta double, seq bigint")
        self.arrivals = BatchLog(spark, f"{root}/arrivals", _SESSION + ", outcome string")     # every input row
        self.state = BucketTable(spark, f"{root}/position", "user_id bigint, compound string, ts timestamp_ntz, event_id bigint, weight double, seq bigint")

    def accepted(self) -> DataFrame:
        return self.accepted_log.read()

    def rejected(self) -> DataFrame:
        """Rows that failed validation, with the first failure as ``reject_reason``."""
        return self.arrivals.read().where("outcome NOT IN ('accepted', 'late')").withColumnRenamed("outcome", "reject_reason")

    def late(self) -> DataFrame:
        return self.arrivals.read().where("outcome = 'late'").drop("outcome")

    def outcomes(self) -> DataFrame:
        """Every input row with its outcome: accepted, late or the reason of its rejection."""
        others = self.arrivals.read().where("outcome <> 'accepted'")
        return self.accepted().withColumn("outcome", F.lit("accepted")).unionByName(others, allowMissingColumns=True)


def ingest_sessions(spark: SparkSession, root: str, judge: Callable[[DataFrame], DataFrame] = strict,
                    hot_rows: int | None = None) -> tuple[IngestTables, Step]:
    """ST1: tables and the step of one micro-batch. ``judge`` adds ``reject_reason``."""
    tables = IngestTables(spark, root)

    def step(batch: DataFrame, epoch: int) -> None:
        buckets = tables.state.touched(batch)
        state = _by_key(tables.state.read(epoch, buckets), batch.select(*KEY).distinct(), "left_semi")
        judged = _marked_late(judge(batch), state)
        outcome = F.coalesce("reject_reason", F.when(F.col("late"), F.lit("late")), F.lit("accepted"))
        tables.arrivals.write(judged.withColumn("outcome", outcome), epoch)
        accepted = tables.arrivals.batch(epoch).where("outcome = 'accepted'").drop("outcome")
        # Accepted rows behind the carried one, which brings its position; every new row counts one more.
        carried = state.withColumn("_carried", F.lit(True))
        rows = accepted.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
        scan = KeyedScan.build(rows.withColumn("_step", F.coalesce("seq", F.lit(1).cast("long"))), KEY, ORDER, hot_rows)
        df = scan.with_running(scan.with_lags(scan.df, "weight", 1, "_w"), {"_seq": ("sum", F.col("_step"))})
        chained = scan.finish(df).where(~F.col("_carried")).withColumns(
            {"load_delta": F.coalesce(F.col("weight") - F.col("_w1"), F.lit(0.0)), "seq": F.col("_seq")})
        tables.accepted_log.write(chained, epoch)
        newest = tables.accepted_log.batch(epoch).groupBy(*KEY).agg(
            F.max(F.struct("ts", "event_id", "weight", "seq")).alias("r")).select(*KEY, "r.*")
        tables.state.upsert(newest, epoch, buckets)

    return tables, step


# -- ST2 ---------------------------------------------------------------------------------
_RING = "array<struct<ts:timestamp_ntz,event_id:bigint,actual_weight:double,recommended_weight:double,prediction_source:string>>"
_LOGGED = "deviation_reason string, prediction_source string, recommended_weight double"


class QualityTables:
    def __init__(self, spark: SparkSession, root: str):
        # New sessions, and the carried ones again with what came after them.
        self.log = BatchLog(spark, f"{root}/chain", _SESSION + f", {_LOGGED}, load_delta double, kind string, after struct<event_id:bigint,weight:double>")
        self.arrivals = BatchLog(spark, f"{root}/arrivals", _SESSION + ", deviation_reason string, late boolean")
        self.state = BucketTable(spark, f"{root}/open", _SESSION + f", {_LOGGED}, ring {_RING}")
        self.quality = BucketTable(spark, f"{root}/quality", MODEL_QUALITY_SCHEMA)

    def audit(self) -> DataFrame:
        """One row per session, as logged."""
        return self.log.read().where("kind = 'new'").drop("kind", "after")

    def closures(self) -> DataFrame:
        """The pending audit that each session completed."""
        return _closures(self.log.read())

    def late(self) -> DataFrame:
        return self.arrivals.read().where("late").select(*_SESSION_COLS)

    def view(self) -> DataFrame:
        """The audit log with each row's closure: pending until the next session of its key."""
        closed = self.closures().select("event_id", "actual_weight", "accuracy_delta", F.lit("complete").alias("prediction_status"))
        return self.audit().join(closed, "event_id", "left").withColumn(
            "prediction_status", F.coalesce("prediction_status", F.lit("pending")))


def _closures(chain: DataFrame) -> DataFrame:
    return chain.where(F.col("after").isNotNull()).select(
        *KEY, *ORDER, "deviation_reason", "prediction_source", "recommended_weight", F.col("after.weight").alias("actual_weight"),
        (F.col("after.weight") - F.col("recommended_weight")).alias("accuracy_delta"))


def refresh_quality_stream(spark: SparkSession, root: str, params: GateParams = GateParams(), rule: RuleParams = RuleParams(),
                           hot_rows: int | None = None) -> tuple[QualityTables, Step]:
    """ST2: tables and the step of one micro-batch."""
    tables = QualityTables(spark, root)

    def step(batch: DataFrame, epoch: int) -> None:
        if "deviation_reason" not in batch.columns:
            batch = batch.withColumn("deviation_reason", F.lit("normal"))
        batch = batch.select(*_SESSION_COLS, "deviation_reason")
        keys, buckets = batch.select(*KEY).distinct(), tables.state.touched(batch)
        state = _by_key(tables.state.read(epoch, buckets), keys, "left_semi")
        tables.arrivals.write(_marked_late(batch, state), epoch)
        new = tables.arrivals.batch(epoch).where("NOT late").drop("late")

        # The carried session in front of the new ones: its audit is the pending one.
        carried = state.drop("ring").withColumn("kind", F.lit("carried"))
        rows = new.withColumn("kind", F.lit("new")).unionByName(carried, allowMissingColumns=True)
        rows = rows.withColumns({"_logged": F.struct("weight", "reps", "rpe"), "_next": F.struct("event_id", "weight")})
        scan = KeyedScan.build(rows, KEY, ORDER, hot_rows)
        df = scan.finish(scan.with_lead1(scan.with_lags(scan.df, "_logged", 1, "_before"), "_next", "after"))
        prev, fresh = F.col("_before1"), F.col("kind") == "new"
        suggested = rule_progression(prev["weight"], prev["reps"], prev["rpe"], rule)["suggested_weight"]
        df = df.withColumns({
            "load_delta": F.coalesce(F.col("weight") - prev["weight"], F.lit(0.0)),
            "prediction_source": F.when(~fresh, F.col("prediction_source")).when(prev.isNotNull(), F.lit("rule_based"))
                                  .otherwise(F.lit("insufficient_data")),
            "recommended_weight": F.when(~fresh, F.col("recommended_weight")).when(prev.isNotNull(), suggested)})
        tables.log.write(df, epoch)
        chained = tables.log.batch(epoch)

        # Newest usable audits per key: those carried and those closed now.
        audit = [*ORDER, "actual_weight", "recommended_weight", "prediction_source"]
        ring = (state.select(*KEY, F.explode("ring").alias("r")).select(*KEY, "r.*")
                .unionByName(_closures(chained).where("deviation_reason = 'normal'").select(*KEY, *audit)))
        rings = last_n(ring, params.recent, rank_col="_rr").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*audit))).alias("ring"))
        newest = chained.groupBy(*KEY).agg(F.max(F.struct(*ORDER, "weight", "reps", "rpe", "deviation_reason", "prediction_source",
                                                          "recommended_weight")).alias("r")).select(*KEY, "r.*")
        tables.state.upsert(_by_key(newest, rings).withColumn("ring", F.coalesce("ring", F.array().cast(_RING))), epoch, buckets)

        usable = _by_key(tables.state.read(epoch + 1, buckets), keys, "left_semi").select(*KEY, F.explode("ring").alias("r")).select(
            *KEY, "r.*", F.lit("complete").alias("prediction_status"), F.lit("normal").alias("deviation_reason"))
        scores = gate_scores(usable, params).where(F.col("n") >= params.min_records).select(
            *KEY, F.col("n").cast("int").alias("session_count"), "model_mape", "rule_mape", "model_enabled")
        blank = init_ledger(keys)
        touched = tables.quality.touched(blank)
        unknown = _by_key(_by_key(blank, tables.quality.read(epoch, touched), "left_anti"), scores, "left_anti")
        tables.quality.upsert(scores.unionByName(unknown), epoch, touched)

    return tables, step


# -- ST3 ---------------------------------------------------------------------------------
TAIL = 4                  # sessions that the next score still needs
_TAIL = "array<struct<ts:timestamp_ntz,event_id:bigint,weight:double>>"
_USED = "array<struct<u:bigint,x:double,y:double>>"
_FIT = ("user_id bigint, compound string, ts timestamp_ntz, event_id bigint, a double, b double, last_calibrated_size int, runs int, "
        f"n bigint, first_nonzero bigint, tail {_TAIL}, ring {_USED}")


class CalibrationTables:
    def __init__(self, spark: SparkSession, root: str):
        self.state = BucketTable(spark, f"{root}/fits", _FIT)
        self.used = BatchLog(spark, f"{root}/used", "user_id bigint, compound string, u bigint, x double, y double")   # scored sessions, counted per key
        self.arrivals = BatchLog(spark, f"{root}/arrivals", _SESSION + ", late boolean")

    def calibration(self) -> DataFrame:
        return self.state.read().select(*KEY, "a", "b", "last_calibrated_size", "runs")

    def late(self) -> DataFrame:
        return self.arrivals.read().where("late").select(*_SESSION_COLS)


def refit_points(first: F.Column, cfg: CalibrationConfig) -> F.Column:
    """Usable rows (counted from 1) at which a key is refit, as an array.

    A fit is due at ``min_samples`` rows, or at the first score that is not 0 if that comes later, and then every
    ``refit_every`` rows for as long as the window still grows: its size is what the cadence counts."""
    start = F.greatest(F.lit(cfg.min_samples).cast("long"), first)
    more = F.filter(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(max(1, cfg.window // cfg.refit_every)).cast("long")),
                                lambda k: start + k * cfg.refit_every), lambda u: u <= cfg.window)
    return F.when(first.isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(F.array(start), more))


def refresh_calibration_stream(spark: SparkSession, root: str, cfg: CalibrationConfig = CalibrationConfig(),
                               score: Callable[[DataFrame], DataFrame] = stand_in_scores) -> tuple[CalibrationTables, Step]:
    """ST3: tables and the step of one micro-batch. ``score`` adds raw_pred and y to ordered sessions; it may look
    ``TAIL - 1`` sessions back and one ahead."""
    if cfg.cadence != "window":
        raise ValueError("the stream counts the window's rows; the cadence 'total' needs the whole history")
    tables = CalibrationTables(spark, root)

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.select(*_SESSION_COLS)
        keys, buckets = batch.select(*KEY).distinct(), tables.state.touched(batch)
        state = _by_key(tables.state.read(epoch, buckets), keys, "left_semi")
        tables.arrivals.write(_marked_late(batch, state), epoch)
        new = tables.arrivals.batch(epoch).where("NOT late")
        # Of the carried sessions only the last one still waits for its target.
        tail = state.select(*KEY, F.col("event_id").alias("_last"), F.explode("tail").alias("t")).select(
            *KEY, "t.*", (F.col("t.event_id") != F.col("_last")).alias("_done"))
        rows = new.select(*KEY, *ORDER, "weight", F.lit(False).alias("_done")).unionByName(tail)
        scored = score(rows).where(~F.col("_done") & F.col("raw_pred").isNotNull() & F.col("y").isNotNull())
        scan = KeyedScan.build(scored.select(*KEY, *ORDER, F.col("raw_pred").alias("x"), "y"), KEY, ORDER)
        counted = _by_key(scan.finish(scan.with_seq(scan.df, "_u")), state.select(*KEY, "n"))
        tables.used.write(counted.withColumn("u", F.col("_u") + F.coalesce("n", F.lit(0).cast("long"))), epoch)
        counted = tables.used.batch(epoch)

        seen = counted.groupBy(*KEY).agg(F.count("*").alias("_more"), F.min(F.when(F.col("x") != 0, F.col("u"))).alias("_nz"))
        per_key = _by_key(_by_key(keys, state.drop("tail", "ring", "ts", "event_id")), seen)
        per_key = per_key.withColumns({"_n": F.coalesce("n", F.lit(0)) + F.coalesce("_more", F.lit(0)),
                                       "first_nonzero": F.coalesce("first_nonzero", "_nz")})
        due = F.filter(refit_points(F.col("first_nonzero"), cfg), lambda u: (u > F.coalesce("n", F.lit(0))) & (u <= F.col("_n")))
        per_key = per_key.withColumn("_due", due)

        # Rows of each due window: at most ``window`` per refit, and few refits per key.
        used = state.select(*KEY, F.explode("ring").alias("r")).select(*KEY, "r.*").unionByName(counted)
        points = per_key.select(*KEY, F.explode("_due").alias("point"))
        window = _by_key(used, points, "inner").where((F.col("u") <= F.col("point")) & (F.col("u") > F.col("point") - cfg.window))
        fits = fit_affine(window, cfg, x="x", y="y", by=(*KEY, "point")).groupBy(*KEY).agg(
            F.max(F.struct("point", "fit_a", "fit_b")).alias("f"), F.count("*").alias("_fits"))
        ring = last_n(used.withColumns({"ts": F.col("u"), "event_id": F.col("u")}), cfg.window - 1, rank_col="_rr")
        rings = ring.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("u", "x", "y"))).alias("ring"))
        ends = last_n(rows.select(*KEY, *ORDER, "weight"), TAIL, rank_col="_rr")
        ends = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*ORDER, "weight"))).alias("tail"))

        out = _by_key(_by_key(_by_key(per_key, fits), rings), ends)
        size = F.when(F.col("f").isNotNull(), F.least(F.col("f.point"), F.lit(cfg.window))).otherwise(
            F.coalesce("last_calibrated_size", F.lit(0))).cast("int")
        final = (size > 0) & (size + cfg.refit_every > cfg.window)       # no refit can follow: nothing to carry
        tables.state.upsert(out.select(
            *KEY, F.element_at("tail", -1)["ts"].alias("ts"), F.element_at("tail", -1)["event_id"].alias("event_id"),
            F.coalesce("f.fit_a", "a", F.lit(1.0)).alias("a"), F.coalesce("f.fit_b", "b", F.lit(0.0)).alias("b"),
            size.alias("last_calibrated_size"), (F.coalesce("runs", F.lit(0)) + F.coalesce("_fits", F.lit(0))).cast("int").alias("runs"),
            F.col("_n").alias("n"), "first_nonzero", "tail",
            F.when(final | F.col("ring").isNull(), F.array().cast(_USED)).otherwise(F.col("ring")).alias("ring")), epoch, buckets)

    return tables, step


# -- replay of a stored table as a stream ----------------------------------------------------
def replay(rows: DataFrame, step: Step, root: str, batches: int = 3) -> None:
    """Feed ``rows`` (with ts) to ``step`` as a file stream that grows by one time slice per run."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    for i in range(batches):
        if low is None:
            part = rows if i == 0 else rows.limit(0)
        else:
            cut = [low + (high - low) * k / batches for k in (i, i + 1)]
            part = rows.where(((F.col("ts") >= F.lit(cut[0])) | (F.lit(i == 0) & F.col("ts").isNull()))
                              & ((F.col("ts") < F.lit(cut[1])) | F.lit(i == batches - 1)))
        part.write.mode("append").parquet(f"{root}/source")
        run(spark.readStream.schema(rows.schema).parquet(f"{root}/source"), step, f"{root}/checkpoint")
