"""Exercise mapping and scaling (J1, J2, A19): the reference's mapping cases."""
from pyspark.sql import functions as F

from liftlake.operators.lookup import categorize, with_parent


def test_mapping_and_scaling(spark):
    names = ["squat", "leg_press", "bench_press", "incline_db_press", "lat_pulldown", "pull_ups",
             "seated_row", "dumbbell_row", "hack_squat", "lunges", "leg_extensions"]
    df = spark.createDataFrame([(n,) for n in names], "exercise_normalized string")
    got = {r["exercise_normalized"]: (r["parent_compound"], r["scale_factor"])
           for r in with_parent(df, spark).collect()}
    assert got["incline_db_press"] == ("incline_db_press", 1.0)
    assert got["leg_press"] == ("squat", 0.8)
    assert got["pull_ups"] == ("lat_pulldown", 0.95)
    assert got["dumbbell_row"] == ("seated_row", 0.85)
    # parent delta +5.0 scaled per child
    deltas = {k: round(5.0 * v[1], 10) for k, v in got.items()}
    assert [deltas[k] for k in ["squat", "leg_press", "hack_squat", "lunges", "leg_extensions"]] == \
        [5.0, 4.0, 4.5, 5.0, 2.0]


def test_categorize_keys(spark):
    df = spark.createDataFrame([("squat",), ("plank",), ("chin_up",)], "exercise_normalized string")
    out = {r["category"]: r["exercises"] for r in categorize(df, spark).collect()}
    assert set(out) == {"squat", "bench_press", "lat_pulldown", "seated_row", "other"}
    assert out["bench_press"] == [] and out["other"] == ["plank"] and out["lat_pulldown"] == ["chin_up"]
    df2 = spark.createDataFrame([("squat",)], "exercise_normalized string")
    assert {r["category"] for r in categorize(df2, spark).collect()} == {"squat", "bench_press", "lat_pulldown",
                                                                          "seated_row"}


def test_normalize_names(spark):
    from liftlake.functions.scalar import normalize_exercise
    df = spark.createDataFrame([("Bench Press (Barbell)",), ("  Lat-Pulldown\t",), ("Squat",)], "n string")
    got = [r[0] for r in df.select(normalize_exercise("n")).collect()]
    assert got == ["bench_press", "lat_pulldown", "squat"]
    strict = [r[0] for r in df.select(normalize_exercise("n", strict=True)).collect()]
    assert strict[0] == "bench_press_"
