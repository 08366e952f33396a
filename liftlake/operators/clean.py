"""Cleaning and merging of raw set exports (PF1-PF15, PF19-PF22, A1, J4, W15, SO1)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.scalar import nan_to_null, normalize_exercise, stable_round, strip_ws
from liftlake.schema import EXPORT_COLUMNS, EXPORT_NUMERIC, EXPORT_STRINGS
from liftlake.session import broadcast_checked, stored

# Columns that identify a set row in appearance order (tie-break of every sort).
APPEARANCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_returnflag")


def standardize(df: DataFrame, mapping: dict[str, str] = EXPORT_COLUMNS) -> DataFrame:
    """PF1: rename the columns that are present; others are left alone."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def coerce_date(c: str = "date") -> F.Column:
    """PF2: parse, unparsable -> NULL."""
    return F.col(c).try_cast("timestamp_ntz")


def coerce_number(c: str) -> F.Column:
    """PF3: parse as double, unparsable -> NULL, NaN -> NULL."""
    return nan_to_null(F.col(c).try_cast("double"))


def add_set_features(df: DataFrame) -> DataFrame:
    """PF6 + PF7: set volume and RPE-weighted load (missing inputs count as 0)."""
    cols = {}
    if {"weight", "reps"} <= set(df.columns):
        cols["set_volume"] = (F.coalesce(F.col("weight"), F.lit(0.0))
                              * F.coalesce(F.col("reps"), F.lit(0.0))).cast("double")
    if {"weight", "rpe"} <= set(df.columns):
        cols["effective_load"] = (F.coalesce(F.col("weight"), F.lit(0.0))
                                  * (F.coalesce(F.col("rpe"), F.lit(0.0)) / 10.0)).cast("double")
    return df.withColumns(cols) if cols else df


def clean_export(df: DataFrame, strict_names: bool = False) -> DataFrame:
    """PF1-PF7: rename, coerce dates and numbers, strip strings, normalise
    exercise names, add set features. Tolerant of missing columns."""
    df = standardize(df)
    cols = {}
    if "date" in df.columns:
        cols["date"] = coerce_date("date")
    for c in EXPORT_NUMERIC:
        if c in df.columns:
            cols[c] = coerce_number(c)
    for c in EXPORT_STRINGS:
        if c in df.columns:
            cols[c] = strip_ws(c)
    df = df.withColumns(cols)
    if "exercise_name" in df.columns:
        df = df.withColumn("exercise_normalized", normalize_exercise("exercise_name", strict_names))
    return add_set_features(df)


def rpe_lookup(df: DataFrame, by: str = "exercise_name") -> DataFrame:
    """A1: mean RPE per exercise (NULLs ignored), rounded to 9 places so the
    lookup does not depend on summation order."""
    return df.groupBy(by).agg(stable_round(F.avg("rpe"), 9).alias("rpe_mean"))


def impute_rpe(df: DataFrame, lookup: DataFrame, by: str = "exercise_name") -> DataFrame:
    """Fill missing RPE from the lookup (left join). The sets keep their
    place when the lookup's measured bytes allow a broadcast."""
    has = "rpe" in df.columns
    out = df.join(broadcast_checked(lookup), by, "left")
    rpe = F.coalesce(F.col("rpe"), F.col("rpe_mean")) if has else F.col("rpe_mean")
    return out.withColumn("rpe", rpe).drop("rpe_mean")


def assign_set_order(df: DataFrame, group: Sequence[str] = ("user_id", "workout_name", "date"),
                     appearance: Sequence[str] = APPEARANCE, hot_rows: int | None = None) -> DataFrame:
    """Set order = position of appearance inside (user, workout, date),
    as a skew-safe keyed scan (a huge group is split by appearance range)."""
    from liftlake.operators.scan import KeyedScan
    # the hot-key pass needs only the key and order columns (pruned scan)
    scan = KeyedScan.build(df, group, appearance, hot_rows)
    out = scan.with_seq(scan.df, "set_order")
    return scan.finish(out.withColumn("set_order", F.col("set_order").cast("double")))


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO1: bag union on the common columns, sorted by name."""
    common = sorted(set(a.columns) & set(b.columns))
    return a.select(*common).unionByName(b.select(*common))


def preprocess(export: DataFrame, source_col: str = "source") -> DataFrame:
    """The baseline preparation (3.2).

    The ``full`` export keeps RPE and set order; the ``lite`` one lacks them,
    gets RPE imputed from the full export's per-exercise mean and set order
    from appearance; set features are computed after imputation; both are
    concatenated on their common columns. Both exports are cleaned in one pass
    and stored; every later pass reads only its columns and its source.
    """
    cleaned = stored(clean_export(export))
    full = cleaned.where(F.col(source_col) == "full")
    lite = drop_present(cleaned.where(F.col(source_col) == "lite"), ("rpe", "set_order", "set_volume", "effective_load"))
    lite = add_set_features(impute_rpe(assign_set_order(lite), rpe_lookup(full)))
    return union_common(full, lite)


def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """PF8/PF21: drop the named columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def align_to(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """PF19: add missing columns as ``fill`` and order like ``columns``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def synthetic_dates(df: DataFrame, key: Sequence[str], order: Sequence[str], start: str = "2024-01-01",
                    every_days: int = 2, hot_rows: int | None = None) -> DataFrame:
    """PF15: a date spine per key: start, start + every_days, ... (hot keys are split)."""
    from liftlake.operators.scan import KeyedScan
    scan = KeyedScan.build(df, key, order, hot_rows)
    out = scan.with_seq(scan.df, "_place")
    days = ((F.col("_place") - 1) * every_days).cast("int")
    return scan.finish(out.withColumn("date", F.date_add(F.to_date(F.lit(start)), days)).drop("_place"))


def validate_sessions(df: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """PF20: ``reject_reason`` NULL for a valid session, else the first failure."""
    w, r, p = F.col("weight"), F.col("reps"), F.col("rpe")
    reason = (F.when(w.isNull() | (w <= 0), F.lit("weight_not_positive"))
              .when(r.isNull() | (r <= 0) | (r.cast("double") != F.floor(r.cast("double"))),
                    F.lit("reps_not_positive_integer"))
              .when(p.isNull() | (p < 1) | (p > 10), F.lit("rpe_out_of_range"))
              .when(~F.col("deviation_reason").isin(list(reasons)), F.lit("unknown_reason")))
    return df.withColumn("reject_reason", reason)


def scoring_frame(last_rows: DataFrame, reps: str | None = None, neutral_rpe: float = 8.0,
                  target: str = "load_delta") -> DataFrame:
    """PF22: newest row of each key, reps overridden, missing RPE -> neutral,
    target dropped."""
    out = last_rows
    if reps is not None:
        out = out.withColumn("reps", F.col(reps))
    out = out.withColumn("rpe", F.coalesce(F.col("rpe"), F.lit(float(neutral_rpe))))
    return drop_present(out, [target])
