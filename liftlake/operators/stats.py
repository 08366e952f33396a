"""Aggregations and statistics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.scalar import local_table, stable_round
from liftlake.session import materialize, stored


def dataset_stats(df: DataFrame, session: Sequence[str] = ("user_id", "workout_name", "date")) -> DataFrame:
    """A2: rows, workouts, exercises, distinct dates, mean sets per session.

    One scan and one shuffle: a row names its workout, exercise, day and
    session, equal names are counted before the shuffle, and all figures are
    counts over the distinct names. Null names are not counted; a session
    without workout or date counts its rows only."""
    kinds = {"workout": F.col("workout_name"), "exercise": F.col("exercise_name"), "day": F.to_date("date").cast("string")}
    types = dict(df.dtypes)
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in session]
    names = [F.struct(F.lit(k).alias("_kind"), v.alias("_name"), *nothing) for k, v in kinds.items()]
    names.append(F.struct(F.lit("session").alias("_kind"), F.lit(None).cast("string").alias("_name"), *[F.col(c) for c in session]))
    counted = df.select(F.inline(F.array(*names))).groupBy("_kind", "_name", *session).agg(F.count(F.lit(1)).alias("_n"))
    is_session, named = F.col("_kind") == "session", F.col("_name").isNotNull()
    whole = is_session & F.col("workout_name").isNotNull() & F.col("date").isNotNull()
    return counted.agg(
        F.coalesce(F.sum(F.when(is_session, F.col("_n"))), F.lit(0)).alias("rows"),
        *[F.count_if((F.col("_kind") == k) & named).alias(c) for k, c in
          (("workout", "workouts"), ("exercise", "exercises"), ("day", "dates"))],
        stable_round(F.avg(F.when(whole, F.col("_n"))), 6).alias("avg_sets_per_session"))


NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def _columns_table(df: DataFrame) -> DataFrame:
    rows = [(i, c, t, _is_numeric(t)) for i, (c, t) in enumerate(df.dtypes)]
    return local_table(df.sparkSession, rows, ["_i", "column_name", "dtype", "numeric"], ["int", "string", "string", "boolean"])


def profile(df: DataFrame) -> DataFrame:
    """One row per column -- dtype, null count, non-null count and, for
    numeric columns, mean, sample stddev, min, max.

    Grouped moments over the long form (column, value): one small aggregate
    whatever the number of columns, combined before the shuffle."""
    long = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").isNotNull().alias("_known"),
                              (F.col(f"`{c}`") if _is_numeric(t) else F.lit(None)).cast("double").alias("_v"))
                     for i, (c, t) in enumerate(df.dtypes)])
    moments = df.select(F.inline(long)).groupBy("_i").agg(
        F.count_if(~F.col("_known")).alias("nulls"), F.count_if("_known").alias("non_null"), F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("stddev"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nulls", "non_null")]
    return _columns_table(df).join(moments, "_i", "left").select("column_name", "dtype", *none, "mean", "stddev", "min", "max")


def cardinality(df: DataFrame, small: int = 20) -> DataFrame:
    """Distinct count per column; the sorted values (as strings) for
    columns with at most ``small`` distinct values.

    One shuffle of the distinct (column, value) pairs, stored; counts and lists
    come from it. Values keep their type (doubles, whole numbers, text of the
    rest), and lists are made of small columns only, so they are bounded."""
    def cell(i, c, t):
        x = F.col(f"`{c}`")
        kind = "_d" if t == "double" else "_l" if t in ("bigint", "int", "smallint", "tinyint") else "_s"
        return F.struct(F.lit(i).alias("_i"), *[(x if k == kind else F.lit(None)).cast(ty).alias(k)
                                                for k, ty in (("_d", "double"), ("_l", "bigint"), ("_s", "string"))])

    value = F.coalesce("_s", F.col("_l").cast("string"), F.col("_d").cast("string"))
    long = df.select(F.inline(F.array(*[cell(i, c, t) for i, (c, t) in enumerate(df.dtypes)])))
    distinct = stored(long.where("_d IS NOT NULL OR _l IS NOT NULL OR _s IS NOT NULL").distinct())
    counts = distinct.groupBy("_i").agg(F.count(F.lit(1)).alias("distinct_count"))
    few = F.broadcast(counts.where(F.col("distinct_count") <= small).select("_i"))   # at most one row a column
    lists = distinct.join(few, "_i").groupBy("_i").agg(F.sort_array(F.collect_list(value)).alias("_vals"))
    out = _columns_table(df).join(counts, "_i", "left").join(lists, "_i", "left")
    n = F.coalesce("distinct_count", F.lit(0))
    return out.select("column_name", n.alias("distinct_count"), "numeric",
                      F.when(n <= small, F.coalesce("_vals", F.array().cast("array<string>"))).alias("values"))


def binned_mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10,
                              threshold: float = 0.15) -> DataFrame:
    """A20 (re-aimed): mutual information (nats) of each feature with the
    target after equal-frequency binning (cut points = exact quantiles i/bins),
    ranked descending (``mi_rank``), ``selected`` when >= threshold. Not the kNN estimator.

    Bin counts are a grouped aggregate (features x bins^2 rows), so the work
    is one pass over the data plus one small fit."""
    from liftlake.operators.features import fit_quantiles
    probs = [i / bins for i in range(1, bins)]
    cols = features + [target]
    df = materialize(df.select(*cols))
    cuts = fit_quantiles(df, cols, probs)

    def bin_of(c):
        arr = F.array(*[F.lit(float(v)) for v in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
        return F.size(F.filter(arr, lambda q: q < F.col(f"`{c}`").cast("double")))

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bx"),
                               F.col(f"`{f}`").isNotNull().alias("ok")) for f in features])
    long = (df.where(F.col(target).isNotNull()).select(bin_of(target).alias("by"), F.inline(pairs))
            .where(F.col("ok")))
    cell = long.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")
    cell = cell.withColumns({
        "_t": F.sum("n").over(wf),
        "_nx": F.sum("n").over(wf.partitionBy("feature", "bx")),
        "_ny": F.sum("n").over(wf.partitionBy("feature", "by")),
    })
    p = F.col("n") / F.col("_t")
    term = p * F.log(F.col("n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))
    mi = cell.groupBy("feature").agg(F.sum(term).alias("mi"))
    out = mi.select("feature", stable_round("mi", 6).alias("mi"), (F.col("mi") >= threshold).alias("selected"))
    # SL3: one row per feature, so one task ranks a bounded table
    return out.withColumn("mi_rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")).cast("long"))


def history_slice_stats(periodized: DataFrame, n: int = 14) -> DataFrame:
    """Per key over its newest ``n`` sessions: weight range, mean RPE and
    the range of the session-to-session change inside the slice (the slice's
    first row counts as 0). The slice is bounded, so its window is cheap."""
    from liftlake.operators.sequence import last_n
    from liftlake.schema import KEY
    sl = last_n(periodized, n, rank_col="_rr")
    sl = sl.withColumn("_m", F.max("_rr").over(Window.partitionBy(*KEY)))
    d = F.when(F.col("_rr") == F.col("_m"), F.lit(0.0)).otherwise(F.col("load_delta"))
    return sl.groupBy(*KEY).agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
                                stable_round(F.avg("rpe"), 6).alias("mean_rpe"),
                                F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))


def per_key_delta(df: DataFrame, key: list[str], order: list[str], value: str = "weight",
                  name: str = "load_delta", hot_rows: int | None = None) -> DataFrame:
    """W1 on any keyed table: value - previous value, first row 0."""
    from liftlake.operators.scan import KeyedScan
    scan = KeyedScan.build(df, key, order, hot_rows)
    out = scan.with_lags(scan.df, value, 1, "_pv")
    return scan.finish(out.withColumn(name, F.coalesce(F.col(value) - F.col("_pv1"), F.lit(0.0))).drop("_pv1"))


def min_data_guards(df: DataFrame, order: list[str], compound: str = "compound", min_rows: int = 50,
                    min_top: int = 20, min_targets: int = 10) -> DataFrame:
    """Per compound, rows / top sets / top sets with a next top set, and
    whether training may proceed (else the first failed guard)."""
    from liftlake.operators.scan import KeyedScan
    df = stored(df.select("user_id", compound, "set_order", "weight", *order))
    top = df.where((F.col("set_order") == 1) & F.col("weight").isNotNull() & F.col("date").isNotNull())
    scan = KeyedScan.build(top, ["user_id", compound], order)
    nxt = scan.finish(scan.with_lead1(scan.df, "weight", "_nxt"))
    tg = nxt.groupBy(compound).agg(F.count(F.lit(1)).alias("n_top_sets"),
                                   F.count("_nxt").alias("n_targets"))
    g = df.groupBy(compound).agg(F.count(F.lit(1)).alias("n_rows")).join(tg, compound, "left")
    nt, ng = F.coalesce(F.col("n_top_sets"), F.lit(0)), F.coalesce(F.col("n_targets"), F.lit(0))
    return g.select(compound, "n_rows", nt.alias("n_top_sets"), ng.alias("n_targets"),
                    ((F.col("n_rows") >= min_rows) & (nt >= min_top) & (ng >= min_targets)).alias("trainable"),
                    F.when(F.col("n_rows") < min_rows, F.lit("too_few_rows"))
                     .when(nt < min_top, F.lit("too_few_top_sets"))
                     .when(ng < min_targets, F.lit("too_few_targets")).alias("skip_reason"))
