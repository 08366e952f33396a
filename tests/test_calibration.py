"""Affine calibration (A13, A14, SC6): the reference's calibration cases."""
from pyspark.sql import functions as F

from liftlake.operators import calibrate as C
from liftlake.schema import CalibrationConfig


def _window(spark, xs, ys, user=1):
    rows = [(user, "squat", float(x), float(y)) for x, y in zip(xs, ys)]
    return spark.createDataFrame(rows, "user_id long, compound string, raw_pred double, y double")


def test_gain_clipped_intercept_kept(spark):
    xs = list(range(1, 21))
    fits = C.fit_affine(_window(spark, xs, [2 * x + 5 for x in xs]))
    st = C.refit(None, fits).first()
    assert abs(st["a"] - 1.4) < 1e-12 and abs(st["b"] - 5.0) < 1e-9
    assert st["last_calibrated_size"] == 20 and st["runs"] == 1 and st["refit"]


def test_cadence_keeps_state(spark):
    xs = list(range(1, 21))
    state = C.refit(None, C.fit_affine(_window(spark, xs, [2 * x + 5 for x in xs]))).drop("refit")
    xs2 = list(range(1, 23))
    cfg = CalibrationConfig(refit_every=5)
    st = C.refit(state, C.fit_affine(_window(spark, xs2, [3 * x for x in xs2]), cfg), cfg).first()
    assert not st["refit"] and abs(st["a"] - 1.4) < 1e-12 and st["runs"] == 1
    adj = C.apply_affine(spark.createDataFrame([(1, "squat", 10.0)], "user_id long, compound string, raw_pred double"),
                         state).first()
    assert abs(adj["adjusted"] - (10.0 * 1.4 + 5.0)) < 1e-9


def test_small_window_calibrates(spark):
    xs = list(range(1, 13))
    st = C.refit(None, C.fit_affine(_window(spark, xs, [x + 1 for x in xs]))).first()
    assert st["refit"] and abs(st["a"] - 1.0) < 1e-9 and abs(st["b"] - 1.0) < 1e-9


def test_too_few_samples(spark):
    st = C.refit(None, C.fit_affine(_window(spark, [1, 2, 3], [1, 2, 3]))).first()
    assert not st["refit"] and st["a"] == 1.0 and st["b"] == 0.0


def test_constant_scores_min_norm(spark):
    # x == c != 0: a = mean(y)/(2c) (then clipped), b = mean(y)/2; c = 0: no fit
    st = C.refit(None, C.fit_affine(_window(spark, [4.0] * 8, [3.5] * 8))).first()
    assert abs(st["a"] - 0.6) < 1e-12 and abs(st["b"] - 1.75) < 1e-12   # 0.4375 clipped up
    st0 = C.refit(None, C.fit_affine(_window(spark, [0.0] * 8, [3.5] * 8))).first()
    assert not st0["refit"]


def test_gain_in_bounds_on_real_data(spark):
    from liftlake.sources.adapters import sessions
    st = C.calibrate(C.stand_in_scores(sessions(spark, "/root/testdata/sf0.001")))
    lo, hi = st.agg(F.min("a"), F.max("a")).first()
    assert 0.6 - 1e-12 <= lo and hi <= 1.4 + 1e-12


def test_routing_sees_the_gate_of_the_snapshot(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["r2_route_then_refresh"](spark, "/root/testdata/sf0.01").collect()
    flips = [r for r in rows if r["model_enabled"] != r["enabled_next"]]
    assert flips and all(r["source"] != "model" for r in flips if not r["model_enabled"])


def test_every_event_is_accounted_for(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["pf20_j9_event_accounting"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["events"] for r in rows) == 10_000 and {"accepted", "unmapped", "rpe_out_of_range"} <= {r["outcome"] for r in rows}
