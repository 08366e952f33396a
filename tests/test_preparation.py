"""Fitted preprocessing tables, forest node tables, and the long-form statistics on edge cases."""
import math
import os

import pytest
from pyspark.sql import functions as F

from liftlake.operators import features as FE
from liftlake.operators import ml as ML
from liftlake.operators import preparation as P
from liftlake.operators import sequence, stats
from liftlake.session import broadcast_checked, drop_stored, stored
from liftlake.sources import adapters as A

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def squat(spark):
    feats = FE.session_features(sequence.periodization(A.sessions(spark, SF_SMALL)), fill_slope=False)
    return feats.where("compound = 'squat' AND next_load_delta IS NOT NULL").persist()


def test_preprocessing_equals_the_fitted_pipeline(spark, squat):
    num, cat = ("weight", "reps", "rpe"), ("is_deload",)
    table = P.fit_preprocessing(squat, num, cat)
    mine = P.apply_preprocessing(squat, table, num, cat).select("event_id", *[f"{c}__scaled" for c in num], "is_deload__index")
    model = ML.build_pipeline(num, cat, kind="linear").fit(ML._prep(squat, num, cat))
    from pyspark.ml.functions import vector_to_array
    ref = model.transform(ML._prep(squat, num, cat)).select("event_id", vector_to_array("num_scaled").alias("v"), "is_deload__idx")
    got = {r["event_id"]: r for r in mine.collect()}
    for r in ref.collect():
        g = got[r["event_id"]]
        assert all(math.isclose(g[f"{c}__scaled"], v, abs_tol=1e-9) for c, v in zip(num, r["v"]))
        assert g["is_deload__index"] == r["is_deload__idx"]


def test_preprocessing_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), ("a", 3.0, "y"), ("b", None, None), (None, 2.0, "z")],
                               "compound string, v double, c string")
    table = P.fit_preprocessing(df, ["v"], ["c"])
    rows = {(r["compound"], r["category"]): r for r in table.collect()}
    assert rows["a", None]["mean"] == 2.0 and math.isclose(rows["a", None]["std"], 1.0)
    assert rows["b", None]["mean"] is None and rows[None, None]["std"] is None
    assert rows["a", "x"]["category_index"] == 0 and rows["a", "y"]["category_index"] == 1
    other = spark.createDataFrame([("a", None, "new"), ("a", 3.0, "y"), ("q", 1.0, "x")], "compound string, v double, c string")
    out = [(r["compound"], r["v__scaled"], r["c__index"]) for r in P.apply_preprocessing(other, table, ["v"], ["c"]).collect()]
    assert sorted(out, key=repr) == sorted([("a", 0.0, None), ("a", 1.0, 1), ("q", None, None)], key=repr)
    assert P.fit_preprocessing(df.limit(0), ["v"], ["c"]).count() == 0


def test_node_table_scores_as_the_model_and_collapses(spark, squat, scratch):
    data = ML._prep(squat, ML.NUMERIC_FEATURES, ML.CATEGORICAL_FEATURES)
    fitted = ML.build_pipeline(ML.NUMERIC_FEATURES, ML.CATEGORICAL_FEATURES, params=ML.ForestParams(num_trees=7)).fit(data)
    path = os.path.join(scratch, "forest")
    fitted.stages[-1].write().save(path)
    out = P.score(fitted.transform(data), P.node_table(spark, path).collect())
    assert out.agg(F.max(F.abs(F.col("node_prediction") - F.col("prediction")))).first()[0] < 1e-9
    kept = P.reached(P.node_table(spark, path, 8).collect())
    assert kept and all(r["n_rows"] >= 8 for r in kept if r["feature"] >= 0)
    # a bound above all rows leaves the roots: one value for every row
    roots = P.node_table(spark, path, 10**9).collect()
    assert P.score(fitted.transform(data), roots).select("node_prediction").distinct().count() == 1


def test_constant_rpe_is_judged_on_training_rows(spark):
    train = spark.createDataFrame([("squat", 8.0), ("squat", 8.0), ("row", 7.0), ("row", 8.0)], "compound string, rpe double")
    valid = spark.createDataFrame([("squat", 9.0), ("squat", 8.0)], "compound string, rpe double")
    varies = FE.fit_varies(train, by=["compound"])
    assert [r["rpe"] for r in FE.drop_constant_rpe(valid, by=["compound"], varies=varies).collect()] == [None, None]


def test_loaded_model_keeps_parameters(spark, squat, scratch):
    m = ML.CompoundModel("squat", params=ML.ForestParams(num_trees=3, max_depth=2), overrides={"max_depth": 1}).fit(squat)
    m.save(os.path.join(scratch, "m"))
    back = ML.CompoundModel.load(os.path.join(scratch, "m"))
    assert back.params == m.params and back.overrides == {"max_depth": 1}


def test_long_form_statistics_on_empty_and_null_tables(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None), (2, -0.0, "a", None), (2, None, None, None)], "i int, d double, s string, z double")
    prof = {r["column_name"]: r for r in stats.profile(df).collect()}
    assert (prof["d"]["nulls"], prof["d"]["non_null"], prof["z"]["nulls"], prof["s"]["mean"]) == (1, 2, 3, None)
    card = {r["column_name"]: r for r in stats.cardinality(df, small=1).collect()}
    assert card["i"]["distinct_count"] == 2 and card["i"]["values"] is None
    assert card["d"]["values"] == ["0.0"] and card["s"]["values"] == ["a"] and card["z"]["values"] == []
    empty = {r["column_name"]: r for r in stats.profile(df.limit(0)).collect()}
    assert set(empty) == {"i", "d", "s", "z"} and empty["i"]["non_null"] == 0
    assert all(r["distinct_count"] == 0 for r in stats.cardinality(df.limit(0)).collect())


def test_dataset_stats_edge_cases(spark):
    schema = "user_id long, workout_name string, exercise_name string, date timestamp_ntz"
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "w", "e", day), (1, "w", "f", day), (1, None, "e", day), (2, "w", None, None)], schema)
    assert tuple(stats.dataset_stats(df).first()) == (4, 1, 2, 1, 2.0)
    assert tuple(stats.dataset_stats(df.limit(0)).first()) == (0, 0, 0, 0, None)


def test_dataset_stats_and_profile_have_no_expand(spark):
    df = stored(spark.createDataFrame([(1, "w", "e", None)], "user_id long, workout_name string, exercise_name string, date timestamp_ntz"))
    for out in (stats.dataset_stats(df), stats.profile(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and plan.count("FileScan") == 1


def test_stored_tables_and_checked_broadcast(spark):
    df = spark.range(100).withColumn("t", F.lit("x" * 100))
    table = stored(df)
    assert table.count() == 100 and drop_stored(spark) >= 1
    hint = lambda x: "hint" in x._jdf.queryExecution().logical().toString().lower()
    assert hint(broadcast_checked(df)) and not hint(broadcast_checked(df, max_bytes=1000))


def test_pending_rows_come_from_a_limited_ranking(spark):
    out = A.session_audit(spark, SF_SMALL, pending_newest=2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == A.sessions(spark, SF_SMALL).count()
    assert out.where("prediction_status = 'pending'").groupBy("user_id", "compound").count().where("count > 2").isEmpty()
