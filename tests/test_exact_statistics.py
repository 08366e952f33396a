"""Quantiles at every size, skewed keys, top sets, slopes and metrics against plain computation."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlake.operators import features as FE
from liftlake.operators import quality, sequence
from liftlake.operators.scan import KeyedScan


def test_quantiles_are_exact_above_a_million_values(spark):
    n = 1_200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"), F.lit(None).cast("double").alias("none"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = FE.fit_quantiles(df, ["v", "none"], probs)
    assert got["none"] is None
    assert got["v"] == pytest.approx(np.quantile(np.arange(n), probs).tolist(), abs=1e-9)


def test_quantiles_per_group_with_ties_and_null_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 9, 50)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["quantiles"] for r in FE.quantile_table(df, ["v"], [0.1, 0.5], by=["g"]).collect()}
    for g in ("a", "b", None, "c"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], [0.1, 0.5]).tolist())


def test_constant_rpe_goes_per_compound(spark):
    df = spark.createDataFrame([("squat", 8.0), ("squat", 8.0), ("bench_press", 7.0), ("bench_press", 9.0)], "compound string, rpe double")
    out = {(r["compound"], r["rpe"]) for r in FE.drop_constant_rpe(df, by=["compound"]).collect()}
    assert out == {("squat", None), ("bench_press", 7.0), ("bench_press", 9.0)}
    assert "rpe" not in FE.drop_constant_rpe(df.where("compound = 'squat'"), by=["compound"]).columns


ROWS = ([(1, 1_000_000_000, i, float(i % 7)) for i in range(300)]                   # one timestamp
        + [(2, i, i, float(i % 5)) for i in range(299)] + [(2, 10**12, 999, 1.0)]    # an outlier
        + [(None, i * 10, i, float(i % 3)) for i in range(300)]                      # a null key
        + [(k, i, i, 1.0) for k in range(10, 20) for i in range(3)])


def test_no_chunk_exceeds_the_bound_and_results_stay(spark):
    df = spark.createDataFrame(ROWS, "k long, t long, e long, v double")
    plain = KeyedScan.build(df, ["k"], ["t", "e"])
    split = KeyedScan.build(df, ["k"], ["t", "e"], hot_rows=40)
    assert split.hot and not plain.hot
    assert split.df.where("_hot").groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 40

    def scanned(scan):
        out = scan.with_seq(scan.df, "seq")
        out = scan.with_lags(out, "v", 2, "_l")
        out = scan.with_lead1(out, "v", "_n")
        out = scan.with_running(out, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
        return sorted(map(str, scan.finish(out).select("k", "t", "e", "seq", "_l1", "_l2", "_n", "s", "m").collect()))

    assert scanned(plain) == scanned(split)


def test_slope_does_not_lose_precision_on_long_histories(spark):
    ys = [F.lit(float(v)) for v in (2e8, 2e8 + 2, 2e8 + 4, 2e8 + 6)]
    row = spark.range(1).select(sequence.window_slope(ys).alias("s"), sequence.window_slope(ys[:1]).alias("n")).first()
    assert row["s"] == pytest.approx(2.0) and row["n"] is None


@pytest.mark.parametrize("hot", [None, 6])
def test_one_top_set_a_day(spark, hot):
    rows = [(1, f"2024-01-0{1 + i // 30} {i % 30 % 24:02d}:{i % 60:02d}:00", i, "w" if i % 10 else None, "squat", 100.0 + i % 7, 5, 8.0) for i in range(60)]
    df = (spark.createDataFrame(rows, "user_id long, d string, e long, workout_name string, exercise_normalized string, weight double, reps int, rpe double")
          .withColumns({"date": F.to_timestamp("d"), "set_volume": F.col("weight") * F.col("reps"), "effective_load": F.col("weight")}))
    undated = df.limit(3).withColumn("date", F.lit(None).cast("timestamp"))
    out = FE.feature_step(df.unionByName(undated), tiebreak=["e"], hot_rows=hot)
    assert out.count() == 63
    top = out.where("is_top_set").collect()
    assert len(top) == len({(r["days_since_first_workout"]) for r in out.where("date IS NOT NULL").collect()})
    assert all(r["workout_name"] is not None and r["weight"] == 106.0 for r in top)
    assert out.where("date IS NULL AND session_number IS NULL AND days_since_first_workout IS NULL").count() == 3


def test_accuracy_of_a_hopeless_fit_is_zero(spark):
    df = spark.createDataFrame([(100.0, 5e6), (100.0001, -5e6), (100.0, 5e6)], "y double, p double")
    assert quality.regression_metrics(df, "y", "p").first()["accuracy_pct"] == 0


def test_date_spine_of_a_hot_key(spark):
    from liftlake.operators import clean

    df = spark.createDataFrame([(1, i // 3, i) for i in range(200)] + [(2, 5, 1)], "k long, t long, e long")
    plain, split = (sorted(map(tuple, clean.synthetic_dates(df, ["k"], ["t", "e"], hot_rows=h).select("k", "e", "date").collect()))
                    for h in (None, 30))
    assert plain == split
