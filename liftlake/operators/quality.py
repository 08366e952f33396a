"""Prediction quality: MAPE, regression metrics, the model gate, audit upkeep
(A8-A12, A10, J8, W19, IO9)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.operators.scan import KeyedScan
from liftlake.operators.sequence import last_n, last_per_key
from liftlake.schema import COMPOUNDS, KEY, ORDER, GateParams


# -- A8 / A9 ---------------------------------------------------------------------
def ape(actual: str | Column, predicted: str | Column) -> Column:
    """Absolute percentage error as a fraction; NULL where actual is 0."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.abs(F.try_divide(a - p, a))


def mape(actual: str | Column, predicted: str | Column, where: Column | None = None) -> Column:
    """A8 aggregate: mean APE over rows with actual != 0; none -> NULL."""
    e = ape(actual, predicted)
    return F.avg(e if where is None else F.when(where, e))


# -- A11 / A12 ---------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """A11 + A12: mae, mse, rmse, r2 (NULL when the target is constant) and the
    displayed accuracy max(0, trunc(100 * r2)). One pass, partial aggregation."""
    err = F.col(y) - F.col(pred)
    pairs = F.col(y).isNotNull() & F.col(pred).isNotNull()
    agg = df.where(pairs).groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        F.var_pop(F.col(y)).alias("_var"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("mse") / F.col("_var"))
    return agg.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                      F.greatest(F.lit(0.0), r2 * 100).cast("int").alias("accuracy_pct")).drop("_var")


# -- IO9 ----------------------------------------------------------------------------
def init_ledger(users: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """IO9: every user with each of the four compounds, default quality row;
    keys already in ``existing`` are kept as they are."""
    keys = users.select("user_id").distinct().select(
        "user_id", F.explode(F.array(*[F.lit(c) for c in COMPOUNDS])).alias("compound"))
    fresh = keys.select(*KEY, F.lit(0).alias("session_count"),
                        F.lit(None).cast("double").alias("model_mape"),
                        F.lit(None).cast("double").alias("rule_mape"),
                        F.lit(False).alias("model_enabled"))
    if existing is None:
        return fresh
    return existing.select(*fresh.columns).unionByName(fresh.join(existing.select(*KEY), list(KEY), "left_anti"))


# -- A10 ------------------------------------------------------------------------------
def gate_scores(audit: DataFrame, params: GateParams = GateParams()) -> DataFrame:
    """Per key: the newest ``recent`` complete, 'normal' audits, their count and
    the MAPE of each source (NULL when fewer than ``min_per_source`` rows)."""
    usable = audit.where((F.col("prediction_status") == "complete")
                         & (F.col("deviation_reason") == "normal"))
    recent = last_n(usable, params.recent)
    is_model = F.col("prediction_source") == "model"
    is_rule = F.col("prediction_source") == "rule_based"
    g = recent.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_model, 1)).alias("n_model"), F.count(F.when(is_rule, 1)).alias("n_rule"),
        mape("actual_weight", "recommended_weight", is_model).alias("_mm"),
        mape("actual_weight", "recommended_weight", is_rule).alias("_rm"))
    mm = F.when(F.col("n_model") >= params.min_per_source, F.col("_mm"))
    rm = F.when(F.col("n_rule") >= params.min_per_source, F.col("_rm"))
    enabled = F.coalesce(mm.isNotNull() & rm.isNotNull() & (mm < rm * params.relative)
                         & (mm < params.absolute), F.lit(False))
    return g.select(*KEY, "n", mm.alias("model_mape"), rm.alias("rule_mape"), enabled.alias("model_enabled"))


def refresh_quality(quality: DataFrame, audit: DataFrame, params: GateParams = GateParams()) -> DataFrame:
    """A10: update-only refresh of ``model_quality`` from the audit log.

    Keys with at least ``min_records`` usable audits get session_count = n,
    both MAPEs and the flag; other keys (and keys absent from the audit)
    keep their old row. Keys not in ``quality`` are not inserted.
    """
    s = gate_scores(audit, params).where(F.col("n") >= params.min_records)
    j = quality.join(s.select(*KEY, F.col("n").alias("_n"), F.col("model_mape").alias("_mm"),
                              F.col("rule_mape").alias("_rm"), F.col("model_enabled").alias("_en")),
                     list(KEY), "left")
    hit = F.col("_n").isNotNull()
    return j.select(
        *KEY,
        F.when(hit, F.col("_n").cast("int")).otherwise(F.col("session_count")).alias("session_count"),
        F.when(hit, F.col("_mm")).otherwise(F.col("model_mape")).alias("model_mape"),
        F.when(hit, F.col("_rm")).otherwise(F.col("rule_mape")).alias("rule_mape"),
        F.when(hit, F.col("_en")).otherwise(F.col("model_enabled")).alias("model_enabled"))


# -- J8 ---------------------------------------------------------------------------------
def close_pending(audit: DataFrame, sessions: DataFrame) -> DataFrame:
    """For every key, the newest pending audit is completed with the newest
    logged session's weight; accuracy_delta = actual - recommended. Older
    pending rows stay pending. Returns the whole audit table."""
    pending = audit.where(F.col("prediction_status") == "pending")
    newest_pending = last_per_key(pending, cols=["event_id"]).select(
        *KEY, F.col("event_id").alias("_pid"))
    newest_session = last_per_key(sessions, cols=["weight"]).select(*KEY, F.col("weight").alias("_actual"))
    target = newest_pending.join(newest_session, list(KEY), "inner")
    j = audit.join(target, list(KEY), "left")
    hit = F.col("event_id") == F.col("_pid")
    hit = F.coalesce(hit, F.lit(False))
    return j.withColumns({
        "actual_weight": F.when(hit, F.col("_actual")).otherwise(F.col("actual_weight")),
        "accuracy_delta": F.when(hit, F.col("_actual") - F.col("recommended_weight"))
                           .otherwise(F.col("accuracy_delta")),
        "prediction_status": F.when(hit, F.lit("complete")).otherwise(F.col("prediction_status")),
    }).drop("_pid", "_actual")


# -- W19 --------------------------------------------------------------------------------
def error_tracking(audit: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per-session error % of the recommendation (0 when the weight did
    not change from the previous session; flagged by ``unchanged``), accuracy
    % and the running mean error per key."""
    scan = KeyedScan.build(audit, KEY, ORDER, hot_rows)
    df = scan.with_seq(scan.df, "seq")
    df = scan.with_lags(df, "weight", 1, "_prevw")
    unchanged = F.coalesce(F.col("weight") == F.col("_prevw1"), F.lit(False))
    err = F.when(F.col("seq") == 1, F.lit(None).cast("double")).when(unchanged, F.lit(0.0)).otherwise(
        F.abs(F.try_divide(F.col("weight") - F.col("recommended_weight"), F.col("weight"))) * 100.0)
    df = df.withColumns({"unchanged": unchanged, "error_pct": err})
    df = scan.with_running(df, {"_err_sum": ("sum", F.col("error_pct")),
                                "_err_n": ("sum", F.col("error_pct").isNotNull().cast("int"))})
    df = df.withColumns({
        "accuracy_pct": F.lit(100.0) - F.col("error_pct"),
        "running_mape_pct": F.try_divide(F.col("_err_sum"), F.col("_err_n")),
    })
    return scan.finish(df.drop("_prevw1", "_err_sum", "_err_n"))
