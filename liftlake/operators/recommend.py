"""Recommendation routing (R1-R5) over every (user, lift) at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.scalar import rule_progression
from liftlake.operators.scan import KeyedScan
from liftlake.operators.sequence import last_n, last_per_key, periodization
from liftlake.schema import COMPOUNDS, KEY, ORDER, RouteParams, RuleParams


def next_load_rule(sessions: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """W16 + SC2: the rule-based next load for every (user, compound)."""
    last = last_per_key(sessions, cols=["weight", "reps", "rpe"])
    s = rule_progression("weight", "reps", "rpe", params)
    return last.select(
        *KEY, F.col("session_count"),
        F.col("weight").alias("last_weight"), F.col("reps").alias("last_reps"),
        F.col("rpe").alias("last_rpe"),
        s["suggested_weight"].alias("suggested_weight"), s["reason"].alias("reason"),
        s["applied_drop"].alias("applied_drop"), s["applied_cap"].alias("applied_cap"))


def route(last: DataFrame, quality: DataFrame | None, scores: DataFrame | None,
          calibration: DataFrame | None, params: RouteParams = RouteParams(),
          rule: RuleParams = RuleParams()) -> DataFrame:
    """One recommendation per key.

    ``last``: key, session_count, last_weight, last_reps, last_rpe (keys with
    count 0 are allowed). ``quality``: key, model_enabled (snapshot t-1, R2).
    ``scores``: key, raw_pred (model's load-delta score for the newest row).
    ``calibration``: key, a, b. Missing lookups fall back to disabled / no
    score / (1, 0).
    """
    df = last
    if quality is not None:
        df = df.join(quality.select(*KEY, "model_enabled"), list(KEY), "left")
    else:
        df = df.withColumn("model_enabled", F.lit(None).cast("boolean"))
    if scores is not None:
        df = df.join(scores.select(*KEY, "raw_pred"), list(KEY), "left")
    else:
        df = df.withColumn("raw_pred", F.lit(None).cast("double"))
    if calibration is not None:
        df = df.join(calibration.select(*KEY, "a", "b"), list(KEY), "left")
    else:
        df = df.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(None).cast("double")})
    n = F.coalesce(F.col("session_count"), F.lit(0))
    enabled = F.coalesce(F.col("model_enabled"), F.lit(False))
    s = rule_progression("last_weight", "last_reps", "last_rpe", rule)
    adjusted = F.col("raw_pred") * F.coalesce(F.col("a"), F.lit(1.0)) + F.coalesce(F.col("b"), F.lit(0.0))
    model_ok = enabled & F.col("raw_pred").isNotNull() & F.col("last_weight").isNotNull()
    weight = (F.when(n == 0, F.lit(None).cast("double"))
              .when((n <= params.rule_until) & ~enabled, s["suggested_weight"])
              .when(model_ok, F.col("last_weight") + adjusted)
              .otherwise(s["suggested_weight"]))
    source = (F.when(n == 0, F.lit("insufficient_data"))
              .when((n <= params.rule_until) & ~enabled, F.lit("rule_based"))
              .when(model_ok, F.lit("model"))
              .otherwise(F.lit("rule_based")))
    reason = (F.when(n == 0, F.lit("No training history yet"))
              .when((n <= params.rule_until) & ~enabled, s["reason"])
              .when(model_ok, F.lit("ML model (calibrated)"))
              .when(enabled & F.col("raw_pred").isNull(),
                    F.concat(F.lit("Model not found - "), s["reason"]))
              .when(enabled, F.concat(F.lit("Model failed - "), s["reason"]))
              .otherwise(F.concat(F.lit("Rule-based ("), n.cast("string"),
                                  F.lit(" sessions; model calibrating...)"))))
    return df.select(*KEY, n.cast("long").alias("session_count"), "last_weight",
                     enabled.alias("model_enabled"), F.col("raw_pred"),
                     F.when(model_ok, adjusted).alias("adjusted_delta"),
                     weight.alias("recommended_weight"), source.alias("source"),
                     reason.alias("reason"))


def all_keys(users: DataFrame) -> DataFrame:
    """IO9 helper: every user with each of the four compounds (a 4-element explode)."""
    return users.select("user_id").distinct().select(
        "user_id", F.explode(F.array(*[F.lit(c) for c in COMPOUNDS])).alias("compound"))


def progression_report(sessions: DataFrame, tail: int = 50, hot_rows: int | None = None) -> DataFrame:
    """The data behind the four progression charts, newest ``tail`` rows per key,
    with the per-key summary (A3) attached."""
    feats = periodization(sessions, hot_rows=hot_rows)
    summary = feats.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.max("weight").alias("max_weight"),
        F.max_by("weight", F.struct(*ORDER)).alias("current_weight"))
    recent = last_n(feats, tail)
    return recent.join(summary, list(KEY), "inner").select(
        *KEY, "seq", "recent_rank", "weight", "reps", "rpe", "load_delta", "is_deload",
        "cycle_number", "weeks_in_cycle", "max_weight_so_far", "percent_of_max",
        "sessions", "max_weight", "current_weight")


def delta_comparison(df: DataFrame) -> DataFrame:
    """SC8 + SC9: rule / raw / calibrated deltas in long form with the next
    weight and a direction arrow. Input: key, last_weight, suggested_weight,
    raw_pred, adjusted."""
    from liftlake.functions.scalar import direction
    wide = df.select(*KEY, "last_weight",
                     (F.col("suggested_weight") - F.col("last_weight")).alias("rule"),
                     F.col("raw_pred").alias("raw"), F.col("adjusted").alias("calibrated"))
    longf = wide.select(*KEY, "last_weight", F.expr(
        "stack(3, 'rule', rule, 'raw', raw, 'calibrated', calibrated) AS (method, delta)"))
    from liftlake.functions.scalar import stable_round
    return longf.select(*KEY, "method", stable_round("delta", 6).alias("delta"),
                        stable_round(F.col("last_weight") + F.col("delta"), 6).alias("next_weight"),
                        direction("delta").alias("direction"))


def route_then_refresh(last: DataFrame, quality: DataFrame, scores: DataFrame, calibration: DataFrame,
                       audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: route on the gate as it stands in the snapshot ``quality``, and refresh
    the gate from the audit log for the next run. Returns both tables."""
    from liftlake.operators.quality import refresh_quality
    return route(last, quality, scores, calibration), refresh_quality(quality, audit)


def log_newest_sessions(sessions: DataFrame, rule: RuleParams = RuleParams(),
                        reason: str = "normal") -> DataFrame:
    """R4 in batch: treat each key's newest session as the one being logged.

    Its backward load delta is taken against the previous session (0 for a
    first session) and a pending audit row records the recommendation the
    history before it produced (rule based; ``insufficient_data`` with no
    history). Newest two rows per key come from a WindowGroupLimit.
    """
    two = last_n(sessions, 2, rank_col="_rr")
    row = F.struct("ts", "event_id", "weight", "reps", "rpe")
    g = two.groupBy(*KEY).agg(F.max(F.when(F.col("_rr") == 1, row)).alias("new"),
                              F.max(F.when(F.col("_rr") == 2, row)).alias("prev"))
    s = rule_progression(F.col("prev.weight"), F.col("prev.reps"), F.col("prev.rpe"), rule)
    has_prev = F.col("prev").isNotNull()
    return g.select(
        *KEY, F.col("new.ts").alias("ts"), F.col("new.event_id").alias("event_id"),
        F.col("new.weight").alias("weight"), F.col("new.reps").alias("reps"), F.col("new.rpe").alias("rpe"),
        F.when(has_prev, F.coalesce(F.col("new.weight") - F.col("prev.weight"), F.lit(0.0)))
         .otherwise(F.lit(0.0)).alias("load_delta"),
        F.lit(reason).alias("deviation_reason"),
        F.when(has_prev, F.lit("rule_based")).otherwise(F.lit("insufficient_data")).alias("prediction_source"),
        F.when(has_prev, s["suggested_weight"]).alias("recommended_weight"),
        F.lit("pending").alias("prediction_status"))


def log_sessions(sessions: DataFrame, rule: RuleParams = RuleParams(), reason: str = "normal",
                 hot_rows: int | None = None) -> DataFrame:
    """R4 for every session: one pending audit row each, with the load delta to
    the key's previous session and the recommendation that session led to."""
    scan = KeyedScan.build(sessions.withColumn("_logged", F.struct("weight", "reps", "rpe")), KEY, ORDER, hot_rows)
    df = scan.finish(scan.with_lags(scan.df, "_logged", 1, "_before"))
    prev = F.col("_before1")
    s = rule_progression(prev["weight"], prev["reps"], prev["rpe"], rule)
    return df.select(
        *KEY, "ts", "event_id", "weight", "reps", "rpe",
        F.coalesce(F.col("weight") - prev["weight"], F.lit(0.0)).alias("load_delta"),
        F.lit(reason).alias("deviation_reason"),
        F.when(prev.isNotNull(), F.lit("rule_based")).otherwise(F.lit("insufficient_data")).alias("prediction_source"),
        F.when(prev.isNotNull(), s["suggested_weight"]).alias("recommended_weight"),
        F.lit("pending").alias("prediction_status"))


def append_sessions(history: DataFrame, new: DataFrame) -> DataFrame:
    """SO2: append newly logged sessions to the history (bag union by name,
    columns of the history)."""
    cols = [c for c in history.columns if c in new.columns]
    return history.select(*cols).unionByName(new.select(*cols))
