"""Exercise dimension lookups (J1-J3, J9, A19, A23, PF12, PF13) and ledger
lookups with defaults (J5-J7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions.scalar import keyword_compounds, local_table
from liftlake.schema import COMPOUNDS, COMPOUND_KEYWORDS, EXERCISES, KEY


def exercise_dim(spark: SparkSession) -> DataFrame:
    """The fixed 70-row dimension (exercise, parent, scale); always broadcast."""
    return F.broadcast(local_table(spark, EXERCISES, ["exercise", "parent", "scale"],
                                   ["string", "string", "double"]))


def with_parent(df: DataFrame, spark: SparkSession, exercise: str = "exercise_normalized") -> DataFrame:
    """J1 + J2: parent compound (unmapped -> itself) and scale factor
    (core lifts 1.0, unmapped 1.0) of a normalised exercise name."""
    dim = exercise_dim(spark)
    key = F.lower(F.trim(F.col(exercise)))
    out = df.join(dim, key == dim["exercise"], "left")
    return out.withColumns({
        "parent_compound": F.coalesce(dim["parent"], key),
        "scale_factor": F.when(key.isin(list(COMPOUNDS)), F.lit(1.0))
                          .otherwise(F.coalesce(dim["scale"], F.lit(1.0))),
    }).drop("exercise", "parent", "scale")


def child_predictions(exercises: DataFrame, parent_pred: DataFrame, spark: SparkSession,
                      delta: str = "predicted_delta") -> DataFrame:
    """Each (user, exercise) gets its parent's predicted delta x scale."""
    ex = with_parent(exercises, spark)
    return ex.join(parent_pred.select(F.col("user_id"), F.col("compound").alias("parent_compound"),
                                      F.col(delta).alias("_parent_delta")),
                   ["user_id", "parent_compound"], "inner") \
             .withColumn("exercise_delta", F.col("_parent_delta") * F.col("scale_factor")) \
             .drop("_parent_delta")


def unmapped(exercises: DataFrame, spark: SparkSession, exercise: str = "exercise_normalized") -> DataFrame:
    """Distinct exercise names the dimension does not know."""
    dim = exercise_dim(spark)
    names = exercises.select(F.col(exercise).alias("exercise")).where(F.col("exercise").isNotNull()).distinct()
    return names.join(dim, F.lower(F.trim(names["exercise"])) == dim["exercise"], "left_anti")


def categorize(exercises: DataFrame, spark: SparkSession, exercise: str = "exercise_normalized") -> DataFrame:
    """Sorted exercise lists per parent; the four compounds always
    present (possibly empty), ``other`` only when something is unmapped.

    Input is the distinct name set (bounded by the exercise vocabulary)."""
    names = exercises.select(F.col(exercise).alias("exercise_normalized")) \
                     .where(F.col("exercise_normalized").isNotNull()).distinct()
    mapped = with_parent(names, spark).withColumn(
        "category", F.when(F.col("parent_compound").isin(list(COMPOUNDS)), F.col("parent_compound"))
                     .otherwise(F.lit("other")))
    lists = mapped.groupBy("category").agg(F.sort_array(F.collect_list("exercise_normalized")).alias("exercises"))
    base = local_table(spark, [(c,) for c in COMPOUNDS], ["category"], ["string"])
    fixed = base.join(lists, "category", "left").select(
        "category", F.coalesce(F.col("exercises"), F.array().cast("array<string>")).alias("exercises"))
    other = lists.where(F.col("category") == "other")
    return fixed.unionByName(other)


def keyword_classify(df: DataFrame, name: str = "exercise_name") -> DataFrame:
    """PF12: one row per (row, matching compound) from case-insensitive keyword
    patterns; rows matching nothing are dropped."""
    return df.withColumn("compound", F.explode(keyword_compounds(name, COMPOUND_KEYWORDS)))


def keep_compounds(df: DataFrame, col: str = "parent_compound", allowed: Sequence[str] = COMPOUNDS) -> DataFrame:
    """PF13: keep rows whose compound is one of the four."""
    return df.where(F.col(col).isin(list(allowed)))


def learned_scale_factors(deltas: DataFrame, spark: SparkSession, delta: str = "load_delta") -> DataFrame:
    """A23 (opt-in): mean delta of each exercise over the mean delta of its
    parent compound exercise, per parent; NULL where the parent mean is 0."""
    ex = with_parent(deltas, spark)
    means = ex.groupBy("parent_compound", "exercise_normalized").agg(F.avg(delta).alias("_m"))
    parent = means.where(F.col("exercise_normalized") == F.col("parent_compound")) \
                  .select("parent_compound", F.col("_m").alias("_pm"))
    return means.join(parent, "parent_compound", "left").select(
        "parent_compound", "exercise_normalized",
        F.try_divide(F.col("_m"), F.col("_pm")).alias("learned_scale"))


# -- ledger lookups with defaults ----------------------------------------------
def with_calibration(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """Per-key (a, b), default (1, 0)."""
    return df.join(calibration.select(*KEY, "a", "b"), list(KEY), "left").withColumns({
        "a": F.coalesce(F.col("a"), F.lit(1.0)), "b": F.coalesce(F.col("b"), F.lit(0.0))})


def with_model_enabled(df: DataFrame, quality: DataFrame) -> DataFrame:
    """Model-enabled flag, missing -> false."""
    return df.join(quality.select(*KEY, F.col("model_enabled").alias("_en")), list(KEY), "left") \
             .withColumn("model_enabled", F.coalesce(F.col("_en"), F.lit(False))).drop("_en")


def with_recorded_count(df: DataFrame, quality: DataFrame) -> DataFrame:
    """Recorded session count, missing or NULL -> 0."""
    return df.join(quality.select(*KEY, F.col("session_count").alias("_sc")), list(KEY), "left") \
             .withColumn("recorded_sessions", F.coalesce(F.col("_sc"), F.lit(0))).drop("_sc")
