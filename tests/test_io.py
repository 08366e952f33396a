"""Sources and sinks: CSV histories, personalization JSON, upserts, models."""
import json
import os

from pyspark.sql import functions as F

from liftlake.operators import sequence
from liftlake.sources import store
from liftlake.sources.adapters import sessions

from conftest import SF_SMALL


def test_history_round_trip(spark, scratch):
    p = sequence.periodization(sessions(spark, SF_SMALL)).withColumn("user", F.col("user_id").cast("string"))
    store.write_histories(p, os.path.join(scratch, "h"))
    back = store.read_partitioned_histories(spark, os.path.join(scratch, "h"))
    a = sorted((r["user"], r["compound"], r["seq"], r["weight"]) for r in back.collect())
    b = sorted((r["user"], r["compound"], r["seq"], r["weight"]) for r in p.collect())
    assert a == b


def test_reference_history_layout(spark, scratch):
    d = os.path.join(scratch, "users", "demo")
    os.makedirs(d)
    with open(os.path.join(d, "demo_bench_press_history.csv"), "w") as f:
        f.write("weight,reps,rpe,load_delta\n100,5,8,0.0\n105,5,,5.0\n")
    with open(os.path.join(d, "demo_seated_row_history.csv"), "w") as f:
        f.write("weight,reps,rpe,load_delta\n")
    rows = store.read_histories(spark, os.path.join(scratch, "users")).collect()
    assert [(r["user"], r["compound"], r["seq"], r["weight"], r["rpe"]) for r in sorted(rows, key=lambda r: r["seq"])] \
        == [("demo", "bench_press", 1, 100.0, 8.0), ("demo", "bench_press", 2, 105.0, None)]


def test_personalization_layouts(spark, scratch):
    docs = {
        "u1": {"user_id": "u1", "scaling_factors": {"squat": 0.6}, "baseline_offsets": {"squat": 1.2},
               "trend_modifiers": {"squat": 1.0},
               "calibration_meta": {"squat": {"last_calibrated_size": 32, "runs": 1}}},
        "u2": {"scaling_factors": {"bench_press": 1.1}, "baseline_offsets": {"bench_press": -0.5},
               "trend_modifiers": {"bench_press": {"trend": 0.9}}},
        "u3": {"scaling_factors": {"lat_pulldown": 1.0}, "baseline_offsets": {"lat_pulldown": 0.0},
               "last_calibration_n": {"lat_pulldown": 12}, "calibration_runs": {"lat_pulldown": 3}},
    }
    for u, doc in docs.items():
        os.makedirs(os.path.join(scratch, "p", u))
        with open(os.path.join(scratch, "p", u, "personalization.json"), "w") as f:
            json.dump(doc, f, indent=2)
    rows = {(r["user_id"], r["compound"]): r for r in
            store.read_personalization(spark, os.path.join(scratch, "p", "*", "personalization.json")).collect()}
    assert rows[("u1", "squat")]["a"] == 0.6 and rows[("u1", "squat")]["last_calibrated_size"] == 32
    assert rows[("u2", "bench_press")]["trend"] == 0.9 and rows[("u2", "bench_press")]["b"] == -0.5
    assert rows[("u3", "lat_pulldown")]["runs"] == 3 and rows[("u3", "lat_pulldown")]["last_calibrated_size"] == 12
    state = spark.createDataFrame([(r["user_id"], r["compound"], r["a"], r["b"], r["trend"],
                                    r["last_calibrated_size"], r["runs"]) for r in rows.values()],
                                  "user_id string, compound string, a double, b double, trend double, "
                                  "last_calibrated_size int, runs int")
    store.write_personalization(state, os.path.join(scratch, "out"))
    back = store.read_personalization(spark, os.path.join(scratch, "out"), lines=True)
    cols = state.columns
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, state.select(*cols).collect()))


def test_keys_of_any_map_are_read(spark, scratch):
    os.makedirs(os.path.join(scratch, "q", "u9"))
    with open(os.path.join(scratch, "q", "u9", "personalization.json"), "w") as f:
        json.dump({"user_id": "u9", "trend_modifiers": {"squat": 0.9}, "calibration_runs": {"seated_row": 2}}, f)
    rows = {r["compound"]: r for r in store.read_personalization(spark, os.path.join(scratch, "q", "*", "personalization.json")).collect()}
    assert rows["squat"]["trend"] == 0.9 and rows["seated_row"]["runs"] == 2


def test_snapshots_through_a_uri(spark, scratch):
    root = f"file://{scratch}/uri"
    df = spark.createDataFrame([(1, "squat")], "user_id long, compound string")
    assert store.read_snapshot(spark, root) is None
    assert [store.write_snapshot(df, root), store.write_snapshot(df.union(df), root)] == [f"{root}/v=0", f"{root}/v=1"]
    assert store.read_snapshot(spark, root).count() == 2 and store.read_snapshot(spark, root, before=1).count() == 1


def test_upsert_and_snapshots(spark, scratch):
    cur = spark.createDataFrame([(1, "squat", 1.0, 0.0), (2, "squat", 1.1, 0.2)],
                                "user_id long, compound string, a double, b double")
    new = spark.createDataFrame([(2, "squat", 1.3, 0.5), (3, "squat", 0.9, 0.1)],
                                "user_id long, compound string, a double, b double")
    out = {r["user_id"]: (r["a"], r["b"]) for r in store.upsert(cur, new).collect()}
    assert out == {1: (1.0, 0.0), 2: (1.3, 0.5), 3: (0.9, 0.1)}
    root = os.path.join(scratch, "snap")
    store.write_snapshot(cur, root)
    store.write_snapshot(store.upsert(cur, new), root)
    assert store.read_snapshot(spark, root).count() == 3
    assert store.read_snapshot(spark, root, before=1).count() == 2


def test_prediction_rows_index(spark):
    from liftlake.operators import calibrate as C
    rows = store.prediction_rows(C.stand_in_scores(sessions(spark, SF_SMALL)))
    first = rows.where(F.col("session_index") == 0).count()
    keys = sessions(spark, SF_SMALL).select("user_id", "compound").distinct().count()
    assert first == keys
