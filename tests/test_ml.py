"""Model pipeline: fit / predict / evaluate / save / load (rows + invariants)."""
import math
import os

import pytest
from pyspark.sql import functions as F

from liftlake.operators import features as FE
from liftlake.operators import ml as ML
from liftlake import session
from liftlake.operators import sequence
from liftlake.sources.adapters import sessions

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def prepared(spark):
    return FE.prepare(FE.session_features(sequence.periodization(sessions(spark, SF_SMALL)))).persist()


def test_not_fitted(spark, prepared):
    with pytest.raises(ML.NotFittedError):
        ML.CompoundModel("squat").predict(prepared)


def test_fit_predict_save_load(spark, prepared, scratch):
    squat = prepared.where(F.col("compound") == "squat")
    m = ML.CompoundModel("squat", params=ML.ForestParams(num_trees=10)).fit(squat)
    met = m.evaluate(squat).first()
    assert met["n"] > 0 and math.isfinite(met["rmse"])
    path = os.path.join(scratch, "model")
    m.save(path)
    with pytest.raises(FileExistsError):
        m.save(path, overwrite=False)
    back = ML.CompoundModel.load(path)
    a = sorted(r["prediction"] for r in m.predict(squat).collect())
    b = sorted(r["prediction"] for r in back.predict(squat).collect())
    assert a == b


def test_missing_target_raises(spark, prepared):
    with pytest.raises(ValueError):
        FE.prepare(prepared.drop("next_load_delta"))


def test_cv_gate(spark):
    folds = spark.createDataFrame([("squat", i, r) for i, r in enumerate([0.3, -0.15, -0.5, -0.02, -1.5])] +
                                  [("bench_press", i, 0.2) for i in range(5)], "compound string, fold int, r2 double")
    out = {r["compound"]: r["accepted"] for r in ML.gate_cv(folds).collect()}
    assert out == {"squat": False, "bench_press": True}


def test_compounds_without_rows_are_reported_not_fitted(spark):
    feats = FE.session_features(sequence.periodization(sessions(spark, SF_SMALL)), fill_slope=False)
    few = feats.where(F.col("compound") == "squat")
    report, models = ML.train_validate(few, kind="linear")
    rows = {(r["compound"], r["status"]) for r in report.collect()}
    assert set(models) == {"squat"} and ("seated_row", "skipped") in rows and ("squat", "fitted") in rows


def test_nothing_fitted_sees_validation_rows(spark):
    feats = FE.session_features(sequence.periodization(sessions(spark, SF_SMALL)), fill_slope=False)
    out = ML.split_then_prepare(feats)
    bounds = {r["compound"]: r["_bounds"] for r in FE.fit_bounds(
        ML.with_split(feats.where("next_load_delta IS NOT NULL")).where("split = 'train'"), by=["compound"]).collect()}
    for r in out.groupBy("compound").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).collect():
        lo, hi = bounds[r["compound"]]["weight"]
        assert lo <= r["lo"] and r["hi"] <= hi


def test_held_out_fits_are_those_of_the_rows_outside_the_fold(spark):
    rows = [(c, i % 4, None if i % 7 == 0 else float(i * i % 31), 8.0 if c == "b" and i % 4 else float(i % 3)) for c in "ab" for i in range(90)]
    rows += [("c", 0, 5.0, None), ("d", i := 1, None, 1.0), ("d", i, None, 2.0)]
    df = spark.createDataFrame(rows, "compound string, fold int, weight double, rpe double")
    bounds, varies = FE.fit_held_out(df, 5, by=("compound",))
    got = {(r["compound"], r["held"]): r["_bounds"] for r in bounds.collect()}
    spans = {(r["compound"], r["held"]): r["_varies"] for r in varies.collect()}
    want, true = {}, {}
    for h in range(5):
        rest = df.where(F.col("fold") != h)
        want.update({(r["compound"], h): r["_bounds"] for r in FE.fit_bounds(rest, by=("compound",)).collect()})
        true.update({(r["compound"], h): r["_varies"] for r in FE.fit_varies(rest, by=("compound",)).collect()})
    assert got == want and spans == true and len(got) == 14


def test_cross_validation_stores_rows_once_for_all_folds(spark, monkeypatch):
    """Not once a fold; the fits' R^2 are those of folds that are prepared one by one, and no table stays."""
    feats = FE.session_features(sequence.periodization(sessions(spark, SF_SMALL)), fill_slope=False).cache()
    kept, kinds = ML._own_rows, []
    monkeypatch.setattr(ML, "_own_rows", lambda df, c, *more: kinds.append(c) or kept(df, c, *more))
    before = set(session._STORED)
    got = ML.cross_validate(feats, ("squat",), k=3, kind="linear").first()
    assert kinds == ["squat"] and set(session._STORED) == before
    folded = ML.contiguous_folds(feats.where("next_load_delta IS NOT NULL AND compound = 'squat'"), 3).cache()
    r2 = []
    for f in range(3):
        train = folded.where(F.col("fold") != f)
        part = FE.prepare(folded, bounds=FE.fit_bounds(train, by=("compound",)), varies=FE.fit_varies(train, by=("compound",)))
        r2.append(ML.CompoundModel("squat", kind="linear").fit(part.where(F.col("fold") != f)).evaluate(part.where(F.col("fold") == f)).first()["r2"])
    assert got["folds"] == 3 and got["cv_r2_mean"] == pytest.approx(sum(r2) / 3, rel=1e-6)


def test_fewer_fits_run_at_once_where_rows_are_many(spark):
    assert ML._fits_at_once(spark, 1_000) == 4 and ML._fits_at_once(spark, 10**9) == 1
