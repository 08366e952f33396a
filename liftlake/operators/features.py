"""Model features (M1, M3) and fitted column statistics.

Statistics the reference recomputes on every batch (median RPE, clip
bounds, constant-column check) are *fitted* here: computed once as a small
aggregate, brought to the driver as a handful of numbers, and applied as
literals or joined per group. Quantiles are exact at every size: values are
counted, range-partitioned, and ranked by cumulative counts, so no task holds
a column.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.scalar import reps_bin, rpe_bin, rpe_ordinal
from liftlake.operators.scan import CHUNK, KeyedScan, null_safe_join
from liftlake.operators.sequence import rolling_mean, rolling_slope, window_slope
from liftlake.schema import CLIP_FEATURES
from liftlake.session import is_costly, materialize, release, stored


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) of each column per ``by`` group:
    by..., column_name, quantiles (array; absent for columns without values).

    Three small shuffles of distinct values, none on the rows' keys: count
    per value, range-partition by (group, column, value), and cumulative
    counts from per-partition totals. Each probability then picks its two
    neighbouring ranks."""
    keys = [*by, "column_name"]
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_v")) for c in cols])
    counts = (df.select(*by, F.inline(values)).where(F.col("_v").isNotNull())
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranged = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), force=True)
    of_key, parts = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m")).select(
        *keys, "_part", F.coalesce(F.sum("_m").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_m").over(of_key).alias("_total"))
    joined = null_safe_join(ranged, totals, [*keys, "_part"])
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))

    def at(rank):   # the value of a 0-based rank
        return F.max(F.when((F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picks, quantiles = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"),
                  F.max(place - F.floor(place)).alias(f"_f{i}")]
        lo, hi, f = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        quantiles.append(F.when(lo == hi, lo).otherwise((1 - f) * lo + f * hi))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, F.array(*quantiles).alias("quantiles"))


def held_out_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], fold: str, k: int) -> DataFrame:
    """``quantile_table`` of the rows of all folds but one, for each of the ``k`` folds that is held out: by..., held, column_name, quantiles.

    Values are counted once, with one number per fold; the ranks without a fold are the differences of two running sums."""
    keys = [*by, "column_name"]
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_v")) for c in cols])
    each = range(k)
    counts = (df.select(*by, fold, F.inline(values)).where(F.col("_v").isNotNull()).groupBy(*keys, "_v")
              .agg(*[F.count_if(F.col(fold) != h).alias(f"_n{h}") for h in each]))
    ranged = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), force=True)
    of_key, parts = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(f"_n{h}").alias(f"_m{h}") for h in each]).select(
        *keys, "_part", *[F.coalesce(F.sum(f"_m{h}").over(parts), F.lit(0)).alias(f"_before{h}") for h in each],
        *[F.sum(f"_m{h}").over(of_key).alias(f"_total{h}") for h in each])
    joined = null_safe_join(ranged, _few(totals), [*keys, "_part"])
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined.withColumns({f"_end{h}": F.col(f"_before{h}") + F.sum(f"_n{h}").over(inside) for h in each})
    picks, rows = [], []
    for h in each:
        end, n, total = F.col(f"_end{h}"), F.col(f"_n{h}"), F.col(f"_total{h}")
        quantiles = []
        for i, p in enumerate(probs):
            place = F.lit(float(p)) * (total - 1)
            at = [F.max(F.when((end - n <= rank) & (rank < end), F.col("_v"))) for rank in (F.floor(place), F.ceil(place))]
            picks += [at[0].alias(f"_lo{h}_{i}"), at[1].alias(f"_hi{h}_{i}"), F.max(place - F.floor(place)).alias(f"_f{h}_{i}")]
            lo, hi, f = (F.col(f"{c}{h}_{i}") for c in ("_lo", "_hi", "_f"))
            quantiles.append(F.when(lo == hi, lo).otherwise((1 - f) * lo + f * hi))
        rows.append(F.struct(F.lit(h).alias("held"), F.array(*quantiles).alias("quantiles")))
    found = ranked.groupBy(*keys).agg(*picks).select(*keys, F.inline(F.array(*rows)))
    return found.where(F.col("quantiles")[0].isNotNull())


def fit_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """{column: [quantile, ...]} over the whole table: one row per column to the driver."""
    rows = {r["column_name"]: list(r["quantiles"]) for r in quantile_table(df, cols, probs).collect()}
    return {c: rows.get(c) for c in cols}


def fit_median(df: DataFrame, col: str) -> float | None:
    q = fit_quantiles(df, [col], [0.5])[col]
    return q[0] if q else None


# -- A5 -------------------------------------------------------------------------------
def impute_median_rpe(df: DataFrame, median: float | None = None) -> DataFrame:
    """A5: ``rpe_missing`` flag, RPE filled with the fitted median."""
    if median is None:
        median = fit_median(df, "rpe")
    return df.withColumns({
        "rpe_missing": F.col("rpe").isNull().cast("int"),
        "rpe": F.coalesce(F.col("rpe"), F.lit(median).cast("double")),
    })


FEW_GROUPS = 50_000     # fitted rows of some hundred bytes: at most about 25 MB


def _few(fitted: DataFrame) -> DataFrame:
    """A fit's rows, one per group, broadcast while they are counted to be few: a join on a
    handful of groups would else gather each group's rows in one task."""
    return F.broadcast(fitted) if fitted.count() <= FEW_GROUPS else fitted


# -- A6 -------------------------------------------------------------------------------
def fit_bounds(df: DataFrame, cols: Sequence[str] = CLIP_FEATURES, lower: float = 0.01, upper: float = 0.99,
               by: Sequence[str] = ()) -> DataFrame:
    """Clip bounds per ``by`` group: one row per group, ``_bounds`` maps a column to [low, high]."""
    cols = [c for c in cols if c in df.columns]
    rows = quantile_table(df, cols, [lower, upper], by)
    return materialize(rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "quantiles"))).alias("_bounds")),
                       force=True)


def clip_columns(df: DataFrame, cols: Sequence[str] = CLIP_FEATURES, lower: float = 0.01,
                 upper: float = 0.99, by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """Clip each present column to its [lower, upper] quantiles (linear
    interpolation), fitted per ``by`` group; ``bounds`` of an earlier fit
    are applied as they are. Groups without bounds stay unclipped."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    bounds = fit_bounds(df, cols, lower, upper, by) if bounds is None else bounds
    if by:
        out = null_safe_join(df, _few(bounds), by)
    else:
        row = bounds.first()
        fitted = F.create_map(*[x for c, q in (row["_bounds"] if row else {}).items()
                                for x in (F.lit(c), F.array(*[F.lit(v) for v in q]))]) if row else F.lit(None).cast("map<string,array<double>>")
        out = df.withColumn("_bounds", fitted)
    for c in cols:
        v, q = F.col(c), F.col("_bounds")[c]
        out = out.withColumn(c, F.when(v.isNull() | q.isNull(), v).otherwise(F.least(F.greatest(v, q[0]), q[1])))
    return out.drop("_bounds")


def fit_held_out(df: DataFrame, k: int, fold: str = "fold", by: Sequence[str] = (), cols: Sequence[str] = CLIP_FEATURES,
                 lower: float = 0.01, upper: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """``fit_bounds`` and ``fit_varies`` of the rows outside each fold: by..., held and the fit."""
    cols = [c for c in cols if c in df.columns]
    rows = held_out_quantiles(df, cols, [lower, upper], by, fold, k)
    bounds = materialize(rows.groupBy(*by, "held").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "quantiles"))).alias("_bounds")),
                         force=True)
    out = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    spans = df.groupBy(*by, fold).agg(F.min("rpe").alias("_low"), F.max("rpe").alias("_high")).withColumn("held", out)
    spans = spans.where(F.col("held") != F.col(fold)).groupBy(*by, "held")
    return bounds, materialize(spans.agg(F.coalesce(F.min("_low") < F.max("_high"), F.lit(False)).alias("_varies")), force=True)


# -- A7 -------------------------------------------------------------------------------
def fit_varies(df: DataFrame, col: str = "rpe", by: Sequence[str] = ()) -> DataFrame:
    """Whether ``col`` has more than one non-null value (min < max), one row per ``by`` group."""
    return materialize(df.groupBy(*by).agg((F.coalesce(F.min(col) < F.max(col), F.lit(False))).alias("_varies")), force=True)


def drop_constant_rpe(df: DataFrame, col: str = "rpe", by: Sequence[str] = (), varies: DataFrame | None = None) -> DataFrame:
    """Drop ``rpe`` when it has at most one distinct non-null value
    (min == max, checked in one cheap aggregate). With ``by`` the check is per
    group: groups where it is constant get NULL, and the column goes only
    when it is constant in all of them. ``varies`` is the verdict of an earlier
    fit (``fit_varies`` of the training rows), applied as it is."""
    if col not in df.columns:
        return df
    spans = fit_varies(df, col, by) if varies is None else varies
    if spans.where("_varies").isEmpty():
        return df.drop(col)
    if not by:
        return df
    return null_safe_join(df, _few(spans), by).withColumn(col, F.when(F.col("_varies"), F.col(col))).drop("_varies")


# -- M1 -------------------------------------------------------------------------------
def feature_step(df: DataFrame, user: str = "user_id", exercise: str = "exercise_normalized",
                 date: str = "date", tiebreak: Sequence[str] = (), n_rolling: int = 3, n_trend: int = 5,
                 median_rpe: float | None = None, slope_fill: float | None = None,
                 hot_rows: int | None = None, last_read: bool = False) -> DataFrame:
    """M1: W12, W13, W9, W10, W11, A5, SC3-SC5, W14, PF14 in one plan.

    Two keyed scans: by user (days since the first and the previous workout) and
    by (user, exercise) (session number as a running count of date changes,
    rolling mean and slope). While no user is hot, both scans and the top set of
    each day work on one shuffle by user. Else the table is stored between
    the scans, each step deletes the table it has read, and the top sets of hot keys are
    found in their chunks. The two fitted
    scalars (mean slope, median RPE) are computed over the stored scan output.
    Rows without a date have no place in a sequence: they stay, with null date features.
    ``last_read``: the caller reads the stored tables behind ``df`` no more, so they are deleted too.
    """
    given, own = df, is_costly(df)
    df = stored(df) if own else df
    if own and last_read:
        release(given, keep=[df])
    given = df
    undated = df.where(F.col(date).isNull())
    df = df.where(F.col(date).isNotNull())
    order = (date, *tiebreak)
    d = F.col(date)
    # by user: W12 (first date so far = the user's first date) and W13
    su = KeyedScan.build(df, [user], order, hot_rows)
    cold = not su.hot  # no (user, exercise) key can be hot when no user is
    if not cold:
        undated = stored(undated)
        if own and su.whole:
            release(given, keep=[su.df, undated])
    out = su.with_lags(su.df, date, 1, "_pd")
    out = su.with_running(out, {"_first": ("first", d)}, base=su.df)
    out = su.finish(out.withColumns({
        "days_since_first_workout": F.expr(f"timestampdiff(DAY, _first, {date})").cast("int"),
        "days_since_last_workout": F.coalesce(F.expr(f"timestampdiff(DAY, _pd1, {date})"), F.lit(0)).cast("int"),
    }).drop("_first", "_pd1"))
    if not cold:
        # the next scan counts, samples and sorts it; equal rows keep the order in which the first scan took them
        out = stored(out.withColumn("_tie", -F.col("days_since_last_workout")))
        release(su.df, keep=[undated] if own else [undated, given])
        order = (*order, "_tie")
    # by (user, exercise): W9, W10, W11, W14
    se = KeyedScan.build(out, [user, exercise], order, hot_rows, assume_cold=cold)
    if se.whole:
        release(out, keep=[se.df])
    between = se.df
    out = se.with_seq(se.df, "_sx")
    out = se.with_lags(out, date, 1, "_ed", base=se.df)
    out = se.with_running(out, {"session_number": ("sum", F.when(
        F.col("_ed1").isNull() | (F.col("_ed1") != d), F.lit(1)).otherwise(F.lit(0)))},
        base=se.with_lags(se.df.where("_hot"), date, 1, "_ed") if se.hot else None)      # carries are of hot keys alone
    out = out.withColumn("session_number", F.col("session_number").cast("int")).drop("_ed1")
    rm = f"rolling_avg_load_last_{n_rolling}_sessions"
    if se.hot:
        depth = max(n_rolling, n_trend) - 1
        out = se.with_lags(out, "effective_load", depth, "_el", base=se.df)
        lags = [F.col(f"_el{i}") for i in range(1, depth + 1)]
        vals = [F.col("effective_load")] + lags[:n_rolling - 1]
        total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
        cnt = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
        out = out.withColumn(rm, F.when(cnt > 0, total / cnt))
        ys = list(reversed(lags[:n_trend - 1])) + [F.col("effective_load")]
        out = out.withColumn("rolling_trend_load", window_slope(ys)).drop(*[f"_el{i}" for i in range(1, depth + 1)])
    else:
        w = se.window()
        out = out.withColumns({
            rm: F.avg("effective_load").over(w.rowsBetween(-(n_rolling - 1), 0)),
            "rolling_trend_load": F.regr_slope(F.col("effective_load"), F.col("_sx").cast("double"))
                                   .over(w.rowsBetween(-(n_trend - 1), 0)),
        })
    out = out.drop("_sx", "_tie")
    top = [user, "days_since_first_workout", "workout_name", exercise]
    if se.hot:
        out = split_top_sets(se, out, top, tiebreak)
    else:       # a group of top sets is a part of a key that is not hot
        out = top_set_flag(se.finish(out), top, tiebreak, cold=True)
    out = stored(out.unionByName(undated.withColumn("is_top_set", F.lit(False)), allowMissingColumns=True))
    if not cold:
        release(between, undated)
    if slope_fill is None:
        slope_fill = out.agg(F.avg("rolling_trend_load")).first()[0]
    if median_rpe is None:
        median_rpe = fit_median(out, "rpe")
    if se.hot:
        out = join_top_sets(out, top, tiebreak)
    out = out.withColumn("rolling_trend_load",
                         F.coalesce(F.col("rolling_trend_load"), F.lit(slope_fill).cast("double")))
    # A5 + SC3 + SC4 + SC5 + PF14
    out = impute_median_rpe(out, median_rpe)
    return out.withColumns({"rpe_binned": rpe_bin("rpe")}).withColumns({
        "rpe_ordinal": rpe_ordinal("rpe_binned"), "reps_binned": reps_bin("reps"),
        "date_epoch": _epoch_seconds(df, date)})


def _epoch_seconds(df: DataFrame, c: str):
    """PF14: seconds since 1970-01-01 of the wall-clock value (zone-less)."""
    if dict(df.dtypes)[c] == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    return F.unix_seconds(F.col(c))


def top_set_flag(df: DataFrame, group: Sequence[str], appearance: Sequence[str],
                 volume: str = "set_volume", cold: bool = False) -> DataFrame:
    """``is_top_set`` marks the first row (appearance order) with the
    group's largest volume; groups with a null part have none. The winner per
    group is a partial aggregate, so a huge group is reduced map-side before
    the shuffle. ``cold``: the caller knows that no group is huge; the winner is then
    found where the group's rows already are."""
    ident = F.struct(*[F.col(c) for c in appearance])
    rank_key = F.struct((-F.col(volume)).alias("v"), *[F.col(c) for c in appearance])
    if cold:
        win = F.min_by(ident, F.when(F.col(volume).isNotNull(), rank_key)).over(Window.partitionBy(*group))
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])
        return df.withColumn("is_top_set", whole & F.coalesce(win == ident, F.lit(False)))
    winners = df.where(F.col(volume).isNotNull()).groupBy(*group).agg(F.min_by(ident, rank_key).alias("_win"))
    flag = F.coalesce(F.col("_win") == ident, F.lit(False))
    return df.join(winners, list(group), "left").withColumn("is_top_set", flag).drop("_win")


def split_top_sets(scan: KeyedScan, df: DataFrame, group: Sequence[str], appearance: Sequence[str],
                   volume: str = "set_volume") -> DataFrame:
    """W14 inside the chunks of a split scan by the group's user and exercise, ordered by date: ``is_top_set`` is that of the
    chunk, and ``_span`` tells whether the row's day goes on in another chunk of its key, for ``join_top_sets``.

    Rows stay where the windows left them; only the first and the last day of each chunk move."""
    day = group[1]
    ends = scan.df.where("_hot").groupBy(*CHUNK).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    of_key = Window.partitionBy("_kh", "_kg").orderBy("_chunk")
    ends = ends.select(*CHUNK, F.when(F.lag("_to").over(of_key) == F.col("_from"), F.col("_from")).alias("_from"),
                       F.when(F.lead("_from").over(of_key) == F.col("_to"), F.col("_to")).alias("_to"))
    ident = F.struct(*[F.col(c) for c in appearance])
    rank = F.struct((-F.col(volume)).alias("v"), *[F.col(c) for c in appearance])
    win = F.min_by(ident, F.when(F.col(volume).isNotNull(), rank)).over(Window.partitionBy(*CHUNK, *group[1:3]))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])
    out = scan._carry_join(df.withColumn("is_top_set", whole & F.coalesce(win == ident, F.lit(False))), ends)
    spans = F.coalesce(F.col(day) == F.col("_from"), F.lit(False)) | F.coalesce(F.col(day) == F.col("_to"), F.lit(False))
    return scan.finish(out.withColumn("_span", whole & spans).drop("_from", "_to"))


def join_top_sets(df: DataFrame, group: Sequence[str], appearance: Sequence[str], volume: str = "set_volume") -> DataFrame:
    """The rows of ``split_top_sets`` with the flag of their whole group: of days in several chunks, the best of the chunks' top sets."""
    ident = F.struct(*[F.col(c) for c in appearance])
    spans = F.coalesce(F.col("_span"), F.lit(False))
    best = df.where(spans & F.col("is_top_set")).groupBy(*group).agg(
        F.min_by(ident, F.struct((-F.col(volume)).alias("v"), *[F.col(c) for c in appearance])).alias("_win"))
    over = df.where(spans).join(best, list(group), "left").withColumn("is_top_set", F.coalesce(F.col("_win") == ident, F.lit(False)))
    return df.where(~spans).unionByName(over.drop("_win")).drop("_span")


# -- M3 -------------------------------------------------------------------------------
def session_features(periodized: DataFrame, key: Sequence[str] = ("user_id", "compound"),
                     order: Sequence[str] = ("ts", "event_id"), hot_rows: int | None = None,
                     fill_slope: bool = True) -> DataFrame:
    """Set features (PF6, PF7) and rolling load features (W10, W11) on the
    periodized session table, the frame M3 prepares for training. Training
    leaves missing slopes null (``fill_slope=False``): the pipeline's imputer
    fills them from the training rows alone."""
    from liftlake.operators.clean import add_set_features
    df = add_set_features(periodized)
    df = rolling_mean(df, "effective_load", 3, key, order, "rolling_avg_load_last_3_sessions", hot_rows)
    return rolling_slope(df, "effective_load", 5, key, order, "rolling_trend_load", fill_slope, hot_rows)


def prepare(df: DataFrame, target: str = "next_load_delta", by: Sequence[str] = ("compound",),
            drop: Sequence[str] = ("date",), bounds: DataFrame | None = None,
            varies: DataFrame | None = None) -> DataFrame:
    """M3: clip the feature columns and drop a constant RPE per compound, keep
    the rows with a target. ``bounds`` and ``varies`` are fits of other (training)
    rows. Raises when the target is absent."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to predict")
    out = clip_columns(materialize(df), CLIP_FEATURES, by=by, bounds=bounds)
    out = drop_constant_rpe(out, by=by, varies=varies)
    out = out.where(F.col(target).isNotNull())
    return out.drop(*[c for c in drop if c in out.columns])
