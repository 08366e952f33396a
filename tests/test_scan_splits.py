"""Split scans: no wide row moves for a carry, null keys and equal rows keep their places."""

import datetime as dt
import time
from pathlib import Path

from pyspark.sql import functions as F

from liftlake import session
from liftlake.operators import features
from liftlake.operators.features import FEW_GROUPS, clip_columns
from liftlake.operators.scan import KeyedScan


def test_carries_join_where_the_windows_left_the_rows(spark):
    rows = [(u, i, float(i)) for u in (None, 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, place int, value double")
    scan = KeyedScan.build(df, ["user"], ["place"], hot_rows=4, broadcast_rows=1)
    out = scan.finish(scan.with_lags(scan.with_seq(scan.df), "value", 2, "lag"))
    assert "coalesce(user" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["user", "place", "value", "seq", "lag1", "lag2"]
    got = {(r.user, r.place): (r.seq, r.lag1, r.lag2) for r in out.collect()}
    assert got == {(u, i): (i + 1, float(i - 1) if i > 0 else None, float(i - 2) if i > 1 else None) for u, i, _ in rows}


def test_equal_rows_keep_one_order_in_both_scans(spark):
    day = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 20)]
    rows = [(u, "squat", t, "A", i // 2 * 2, 100.0 + i // 2, 500.0, 5, 8.0) for u in range(20) for i, t in enumerate(day)]
    rows = [(u, x, t, w, 1 if t == day[1] else k, 50.0 if t == day[1] else e, v, n, r) for u, x, t, w, k, e, v, n, r in rows]
    df = spark.createDataFrame(rows, "user_id long, exercise_normalized string, date timestamp_ntz, workout_name string, "
                                     "k int, effective_load double, set_volume double, reps int, rpe double")
    plain, split = (features.feature_step(df, tiebreak=["k"], hot_rows=h).drop("date") for h in (None, 2))
    sums = ("rolling_avg_load_last_3_sessions", "rolling_trend_load")
    plain, split = (x.withColumns({c: F.round(c, 6) for c in sums}) for x in (plain, split))
    names = plain.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(*names).collect()))


def test_clip_bounds_are_broadcast(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("string").alias("compound"), F.col("id").cast("double").alias("weight"))
    out = clip_columns(df, ["weight"], by=["compound"])
    assert FEW_GROUPS > 2 and "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("weight > 198 OR weight < 1").isEmpty() and out.count() == 200


def _days(n_users=3, n_days=30):
    """Sets of whom many share a user, an exercise, a day and a workout, with equal volumes and missing values."""
    rows = []
    for u in range(n_users):
        for i in range(n_days * 4):
            day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 11 * 2)
            rows.append((u, "squat" if i % 5 else "row", None if i % 37 == 0 else day, None if i % 23 == 0 else "AB"[i % 2], i,
                         float(i % 7), None if i % 13 == 0 else float(i * 7 % 5), 5, None if i % 3 == 0 else 8.0))
    return rows


DAY_COLUMNS = ("user_id long, exercise_normalized string, date timestamp_ntz, workout_name string, k int, effective_load double, "
               "set_volume double, reps int, rpe double")


def test_top_sets_of_days_in_several_chunks(spark):
    df = spark.createDataFrame(_days(), DAY_COLUMNS)
    plain, *split = (features.feature_step(df, tiebreak=["k"], hot_rows=h).select("user_id", "k", "is_top_set", "session_number", "days_since_last_workout")
                     for h in (None, 2, 4, 60))
    want = sorted(map(str, plain.collect()))
    assert any("is_top_set=True" in x for x in want)
    for x in split:
        assert sorted(map(str, x.collect())) == want


def test_split_steps_delete_what_they_have_read(spark):
    """A costly input, its copy and the tables between the scans are gone; only the last table is left."""
    kept = session.stored(spark.createDataFrame(_days(), DAY_COLUMNS))
    before = set(session._STORED)
    out = features.feature_step(kept.distinct(), tiebreak=["k"], hot_rows=2)
    assert len(set(session._STORED) - before) == 1 and before <= set(session._STORED)
    assert out.count() == kept.count() == 360
    gone = session.stored(kept.distinct())
    features.feature_step(gone.distinct(), tiebreak=["k"], hot_rows=2, last_read=True)
    assert len(set(session._STORED) - before) == 2 and gone.inputFiles()[0].split("/")[-2] not in " ".join(session._STORED)


def test_stored_tables_leave_no_shuffle_files(spark):
    dirs = [x.getPath() for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for at in dirs for x in Path(at).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(session.SHUFFLE_CLEANUP)
    out = session.stored(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count())
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(session.SHUFFLE_CLEANUP) == setting and out.count() == 5_000
