"""Per-(user, lift) affine calibration of model scores (A13-A15, SC6, R3, M15).

A model score ``raw_pred`` (a predicted load delta) is calibrated against
the realised target ``y`` (next - this weight) with an OLS fit
``y ~ a * raw_pred + b`` over each key's newest ``window`` usable rows. The
gain ``a`` is clipped to the configured bounds while ``b`` stays the
unclipped fit's intercept. When every score in the window is the same
value c != 0, the minimum-norm least-squares answer is a = mean(y)/(2c),
b = mean(y)/2; c = 0 gives no fit (the old state is kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.scalar import local_table
from liftlake.operators.scan import KeyedScan
from liftlake.operators.sequence import chronological_split, last_n
from liftlake.schema import KEY, ORDER, CalibrationConfig  # noqa: F401

STATE_COLS = ["a", "b", "last_calibrated_size", "runs"]


def stand_in_scores(sessions: DataFrame, lookback: int = 3, hot_rows: int | None = None) -> DataFrame:
    """A deterministic stand-in for a model score, so calibration has exact
    oracles: raw_pred = mean of the previous ``lookback`` weights - weight
    (NULL on a key's first row); y = next weight - weight."""
    scan = KeyedScan.build(sessions, KEY, ORDER, hot_rows)
    df = scan.df
    if scan.hot:
        df = scan.with_lags(df, "weight", lookback, "_p")
        lags = [F.col(f"_p{i}") for i in range(1, lookback + 1)]
        total = sum((F.coalesce(v, F.lit(0.0)) for v in lags), F.lit(0.0))
        cnt = sum((v.isNotNull().cast("int") for v in lags), F.lit(0))
        df = df.withColumn("raw_pred", F.when(cnt > 0, total / cnt) - F.col("weight"))
        df = df.drop(*[f"_p{i}" for i in range(1, lookback + 1)])
    else:
        w = scan.window().rowsBetween(-lookback, -1)
        df = df.withColumn("raw_pred", F.avg("weight").over(w) - F.col("weight"))
    df = scan.with_lead1(df, "weight", "_next")
    df = df.withColumn("y", F.col("_next") - F.col("weight")).drop("_next")
    return scan.finish(df)


def next_scores(sessions: DataFrame, lookback: int = 3) -> DataFrame:
    """The stand-in score for each key's next session: mean of the newest
    ``lookback`` weights - newest weight (newest rows via WindowGroupLimit)."""
    recent = last_n(sessions, lookback, rank_col="_rr")
    return recent.groupBy(*KEY).agg(
        (F.avg("weight") - F.max(F.when(F.col("_rr") == 1, F.col("weight")))).alias("raw_pred"))


def usable_window(scored: DataFrame, cfg: CalibrationConfig = CalibrationConfig(),
                  x: str = "raw_pred", y: str = "y") -> DataFrame:
    """Rows with both score and target, newest ``cfg.window`` per key."""
    usable = scored.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return last_n(usable, cfg.window, rank_col="_rr").drop("_rr")


def fit_affine(window: DataFrame, cfg: CalibrationConfig = CalibrationConfig(),
               x: str = "raw_pred", y: str = "y", total: DataFrame | None = None, by: tuple = KEY) -> DataFrame:
    """Per key (or ``by``) n, fitted (a, b) or NULLs when no fit is possible.

    ``available`` is n (window cadence) or the key's whole usable count
    (``cfg.cadence == 'total'``, pass ``total`` with key + available)."""
    g = window.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("_xmin"), F.max(x).alias("_xmax"),
        F.avg(y).alias("_ybar"), F.regr_slope(F.col(y), F.col(x)).alias("_slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("_icpt"))
    const = F.col("_xmin") == F.col("_xmax")
    ok = (F.col("n") >= cfg.min_samples) & ~(const & (F.col("_xmin") == 0))
    a_raw = F.when(const, F.try_divide(F.col("_ybar"), F.col("_xmin") * 2.0)).otherwise(F.col("_slope"))
    b = F.when(const, F.col("_ybar") / 2.0).otherwise(F.col("_icpt"))
    a = F.least(F.greatest(a_raw, F.lit(cfg.gain_low)), F.lit(cfg.gain_high))
    out = g.select(*by, "n", F.when(ok, a).alias("fit_a"), F.when(ok, b).alias("fit_b"))
    if cfg.cadence == "total" and total is not None:
        out = out.join(total, list(KEY), "left")
    else:
        out = out.withColumn("available", F.col("n"))
    return out


def refit(state: DataFrame | None, fits: DataFrame, cfg: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """A14 + IO7: decide the cadence and upsert the calibration state.

    A key is refit when it has a fit and either has never been calibrated
    (last size 0 / no state) or ``available - last_size >= refit_every``.
    Result: one row per key in ``state`` or ``fits`` with a, b,
    last_calibrated_size, runs and ``refit`` (whether it changed now).
    """
    if state is None:
        state = local_table(fits.sparkSession, [], ["user_id", "compound", *STATE_COLS],
                            ["long", "string", "double", "double", "int", "int"])
    j = state.select(*KEY, *STATE_COLS).join(fits, list(KEY), "full_outer")
    last = F.coalesce(F.col("last_calibrated_size"), F.lit(0))
    due = (last == 0) | ((F.col("available") - last) >= cfg.refit_every)
    go = F.coalesce(F.col("fit_a").isNotNull() & due, F.lit(False))
    return j.select(
        *KEY,
        F.when(go, F.col("fit_a")).otherwise(F.coalesce(F.col("a"), F.lit(1.0))).alias("a"),
        F.when(go, F.col("fit_b")).otherwise(F.coalesce(F.col("b"), F.lit(0.0))).alias("b"),
        F.when(go, F.col("n").cast("int")).otherwise(last).alias("last_calibrated_size"),
        (F.coalesce(F.col("runs"), F.lit(0)) + go.cast("int")).cast("int").alias("runs"),
        go.alias("refit"))


def calibrate(scored: DataFrame, state: DataFrame | None = None,
              cfg: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """R3's first half for every key: window -> fit -> cadence -> new state."""
    total = None
    if cfg.cadence == "total":
        total = (scored.where(F.col("raw_pred").isNotNull() & F.col("y").isNotNull())
                 .groupBy(*KEY).agg(F.count(F.lit(1)).alias("available")))
    return refit(state, fit_affine(usable_window(scored, cfg), cfg, total=total), cfg)


def apply_affine(scores: DataFrame, calibration: DataFrame, x: str = "raw_pred") -> DataFrame:
    """SC6 + J5: adjusted = a * x + b with the key's (a, b), default (1, 0)."""
    j = scores.join(calibration.select(*KEY, "a", "b"), list(KEY), "left")
    a, b = F.coalesce(F.col("a"), F.lit(1.0)), F.coalesce(F.col("b"), F.lit(0.0))
    return j.withColumns({"a": a, "b": b, "adjusted": F.col(x) * a + b})


def residual_offsets(window: DataFrame, state: DataFrame | None = None, rate: float = 0.05,
                     x: str = "raw_pred", y: str = "y") -> DataFrame:
    """B += rate * mean(y - x) per key (only the offset moves)."""
    g = window.groupBy(*KEY).agg(F.avg(F.col(y) - F.col(x)).alias("_mr"))
    if state is not None:
        g = g.join(state.select(*KEY, "b"), list(KEY), "left")
    else:
        g = g.withColumn("b", F.lit(None).cast("double"))
    return g.select(*KEY, (F.coalesce(F.col("b"), F.lit(0.0)) + F.col("_mr") * rate).alias("b"))


def uplift_report(scored: DataFrame, first_n: int = 12, cfg: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Calibrate on each key's first ``first_n`` usable rows, evaluate raw
    and calibrated scores on the remaining rows (MAE and RMSE before/after)."""
    usable = scored.where(F.col("raw_pred").isNotNull() & F.col("y").isNotNull())
    ranked = chronological_split(usable, first_n=first_n)
    train = ranked.where(F.col("split") == "train")
    held = ranked.where(F.col("split") == "valid")
    fits = fit_affine(train, cfg).select(*KEY, F.coalesce("fit_a", F.lit(1.0)).alias("a"),
                                         F.coalesce("fit_b", F.lit(0.0)).alias("b"))
    ev = held.join(fits, list(KEY), "left").withColumn(
        "_cal", F.col("raw_pred") * F.coalesce("a", F.lit(1.0)) + F.coalesce("b", F.lit(0.0)))
    e_raw, e_cal = F.col("y") - F.col("raw_pred"), F.col("y") - F.col("_cal")
    return ev.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("held_out"),
        F.avg(F.abs(e_raw)).alias("mae_raw"), F.avg(F.abs(e_cal)).alias("mae_calibrated"),
        F.sqrt(F.avg(e_raw * e_raw)).alias("rmse_raw"), F.sqrt(F.avg(e_cal * e_cal)).alias("rmse_calibrated"))
