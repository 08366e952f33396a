"""Per-(user, lift) sequence features: deltas, deloads, cycles, maxima.

All functions work on every key at once. Ordering is the total order
``(ts, event_id)``; ties never depend on file order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.operators.scan import KeyedScan
from liftlake.schema import KEY, ORDER
from liftlake.session import materialize

DELOAD_DROP = 0.15


def periodization(sessions: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ORDER,
                  hot_rows: int | None = None, lags: int = 0) -> DataFrame:
    """W1-W8b and M2 in one scan.

    Adds: seq, prev_weight, next_weight, load_delta (this - previous, first
    row 0), next_load_delta (next - this, NULL on the last row), is_deload
    (>= 15 % below the previous weight), cycle_number (running deload count),
    weeks_in_cycle (1-based position in the cycle), max_weight_so_far,
    percent_of_max (ratio), cycle_weight_trend (step inside the cycle, first
    row of a cycle 0), cycle_weight_cum (weight - first weight of the cycle).
    With ``lags`` > 0 also ``w_lag1..w_lag{lags}``.
    """
    scan = KeyedScan.build(sessions, key, order, hot_rows)
    df = scan.df
    df = scan.with_seq(df, "seq")
    df = scan.with_lags(df, "weight", max(1, lags), "w_lag")
    df = scan.with_lead1(df, "weight", "next_weight")
    w, prev = F.col("weight"), F.col("w_lag1")
    df = df.withColumns({
        "prev_weight": prev,
        "load_delta": F.coalesce(w - prev, F.lit(0.0)),
        "next_load_delta": F.col("next_weight") - w,
        "is_deload": F.coalesce(F.try_divide(prev - w, prev) >= DELOAD_DROP, F.lit(False)),
    })
    df = scan.with_running(df, {
        "max_weight_so_far": ("max", w),
        "cycle_number": ("sum", F.col("is_deload").cast("int")),
        "_cycle_start": ("last", F.when(F.col("is_deload"), F.struct(F.col("seq"), w.alias("w")))),
        "_first_w": ("first", F.when(F.col("seq") == 1, w)),
    })
    start = F.col("_cycle_start")
    df = df.withColumns({
        "cycle_number": F.coalesce(F.col("cycle_number"), F.lit(0)).cast("int"),
        "weeks_in_cycle": (F.col("seq") - F.coalesce(start["seq"], F.lit(1)) + 1).cast("int"),
        "percent_of_max": F.try_divide(w, F.col("max_weight_so_far")),
        "cycle_weight_trend": F.when(F.col("is_deload") | (F.col("seq") == 1), F.lit(0.0))
                               .otherwise(F.coalesce(w - prev, F.lit(0.0))),
        "cycle_weight_cum": w - F.when(start.isNotNull(), start["w"]).otherwise(F.col("_first_w")),
    })
    drop = ["_cycle_start", "_first_w"] + ([] if lags else ["w_lag1"])
    return scan.finish(df.drop(*drop))


def last_per_key(df: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ORDER,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """Newest row of every key as a partial aggregate (skew safe).

    ``max_by`` over the order struct is combined map-side, so a hot key never
    lands in one task with all its rows.
    """
    cols = [c for c in (cols or df.columns) if c not in key]
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last, F.count(F.lit(1)).alias("session_count")).select(
        *key, *[F.col("_last")[c].alias(c) for c in cols], "session_count")


def last_n(df: DataFrame, n: int, key: Sequence[str] = KEY, order: Sequence[str] = ORDER,
           rank_col: str = "recent_rank") -> DataFrame:
    """Newest ``n`` rows per key, ``recent_rank`` 1 = newest.

    ``row_number() <= n`` is planned with a map-side WindowGroupLimit, so a
    hot key is cut to ``n`` rows per partition before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def chronological_split(df: DataFrame, fraction: float = 0.8, key: Sequence[str] = KEY,
                        order: Sequence[str] = ORDER, first_n: int | None = None,
                        hot_rows: int | None = None) -> DataFrame:
    """``split`` = train for the first ``int(fraction * n)`` rows of each key
    (or the first ``first_n`` rows), else ``valid``."""
    scan = KeyedScan.build(df, key, order, hot_rows)
    out = scan.with_seq(scan.df, "_pos")
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    out = out.join(counts, list(key), "left")
    cut = F.lit(first_n) if first_n is not None else F.floor(F.col("_n") * F.lit(fraction))
    return scan.finish(out.withColumn("split", F.when(F.col("_pos") <= cut, F.lit("train"))
                                      .otherwise(F.lit("valid"))).drop("_pos", "_n"))


def rolling_mean(df: DataFrame, value: str, n: int, key: Sequence[str], order: Sequence[str],
                 name: str, hot_rows: int | None = None, assume_cold: bool = False) -> DataFrame:
    """Mean of the last ``n`` rows including the current one (min 1)."""
    scan = KeyedScan.build(df, key, order, hot_rows, assume_cold=assume_cold)
    out = scan.df
    if not scan.hot:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
        return scan.finish(out.withColumn(name, F.avg(value).over(w)))
    out = scan.with_lags(out, value, n - 1, "_rm")
    vals = [F.col(value)] + [F.col(f"_rm{i}") for i in range(1, n)]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    cnt = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
    out = out.withColumn(name, F.when(cnt > 0, total / cnt))
    return scan.finish(out.drop(*[f"_rm{i}" for i in range(1, n)]))


def window_slope(ys: Sequence[Column]) -> Column:
    """Least-squares slope of the non-null ``ys`` against their place in the
    window (0, 1, ...); NULL below 2 values. Places inside the window keep the
    sums small however long the key's history is."""
    pairs = F.filter(F.array(*[F.struct(F.lit(float(j)).alias("x"), y.alias("y")) for j, y in enumerate(ys)]),
                     lambda p: p["y"].isNotNull())
    k = F.size(pairs).cast("double")
    sx = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"])
    sy = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["y"])
    sxx = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["x"])
    sxy = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["y"])
    den = k * sxx - sx * sx
    return F.when((k >= 2) & (den != 0), (k * sxy - sx * sy) / den)


def rolling_slope(df: DataFrame, value: str, n: int, key: Sequence[str], order: Sequence[str],
                  name: str, fill_mean: bool = True, hot_rows: int | None = None,
                  assume_cold: bool = False) -> DataFrame:
    """Least-squares slope of ``value`` against position over the last
    ``n`` rows (min 2 rows, else NULL); NULLs filled with the mean of all
    slopes when ``fill_mean``.

    Position is the row's index inside the window, so the slope equals the
    regression on 0..k-1 as in the reference's per-window fit.
    """
    scan = KeyedScan.build(df, key, order, hot_rows, assume_cold=assume_cold)
    out = scan.with_seq(scan.df, "_sx")
    if not scan.hot:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
        out = out.withColumn(name, F.regr_slope(F.col(value), F.col("_sx").cast("double")).over(w))
    else:
        out = scan.with_lags(out, value, n - 1, "_rs")
        ys = [F.col(f"_rs{i}") for i in range(n - 1, 0, -1)] + [F.col(value)]
        out = out.withColumn(name, window_slope(ys))
        out = out.drop(*[f"_rs{i}" for i in range(1, n)])
    out = scan.finish(out.drop("_sx"))
    if fill_mean:
        # a fitted scalar: one small aggregate, applied as a literal
        out = materialize(out)
        fill = out.agg(F.avg(name)).first()[0]
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(fill).cast("double")))
    return out
