"""Normal equations against numpy, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlake.operators import least_squares as LS


def data(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.normal(size=3)
        rows.append((("x", "y")[i % 2], int(i * 5 // n), float(a), float(b), float(c + a), float(2 * a - b + 0.5 * c + 3 + rng.normal() * 0.1)))
    rows += [("x", 1, None, 1.0, 1.0, 1.0), ("y", 2, 1.0, 1.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "g string, fold int, a double, b double, c double, t double").repartition(3)


def fitted(rows):
    m = np.array([[1, *r[2:5]] for r in rows])
    return np.linalg.lstsq(m, np.array([r[5] for r in rows]), rcond=None)[0]


def scored(rows, beta):
    e = np.array([r[5] - beta @ [1, *r[2:5]] for r in rows])
    t = np.array([r[5] for r in rows])
    return np.sqrt((e ** 2).mean()), 1 - (e ** 2).sum() / ((t - t.mean()) ** 2).sum()


def test_cross_validation_equals_a_fit_per_fold(spark):
    rows, df = data(spark)
    rows = [r for r in rows if None not in r]
    got = {(r.g, r.fold): r for r in LS.cross_validated(df, ["g"], ["a", "b", "c"], "t").collect()}
    assert len(got) == 10
    for (g, f), r in got.items():
        train = [x for x in rows if x[0] == g and x[1] != f]
        test = [x for x in rows if x[0] == g and x[1] == f]
        beta = fitted(train)
        assert (r.n_train, r.n_test) == (len(train), len(test))
        assert [r.intercept, r.b_a, r.b_b, r.b_c] == pytest.approx(beta, abs=1e-8)
        assert (r.rmse, r.r2) == pytest.approx(scored(test, beta), abs=1e-8)


def test_split_scores(spark):
    rows, df = data(spark)
    rows = [r for r in rows if None not in r]
    for r in LS.split_scores(df, ["g"], ["a", "b", "c"], "t", F.col("fold") == 4).collect():
        beta = fitted([x for x in rows if x[0] == r.g and x[1] < 4])
        part = [x for x in rows if x[0] == r.g and (x[1] == 4) == (r.split == "valid")]
        assert r.n == len(part) and (r.rmse, r.r2) == pytest.approx(scored(part, beta), abs=1e-8)


def test_constant_and_collinear_features_get_no_weight(spark):
    df = spark.createDataFrame([("g", i % 2, 1.0, float(i), 2.0 * i, 3.0 * i + 1) for i in range(20)], "g string, fold int, a double, b double, c double, t double")
    for r in LS.cross_validated(df, ["g"], ["a", "b", "c"], "t").collect():
        assert (r.b_a, r.b_c) == (0.0, 0.0) and r.b_b == pytest.approx(3.0) and r.r2 == pytest.approx(1.0)
    flat = df.withColumn("t", F.lit(5.0))
    assert {r.r2 for r in LS.cross_validated(flat, ["g"], ["b"], "t").collect()} == {None}


def test_one_fold_or_no_rows(spark):
    df = spark.createDataFrame([("g", 0, 1.0, 2.0)], "g string, fold int, a double, t double")
    assert LS.cross_validated(df, ["g"], ["a"], "t").count() == 0
    assert LS.split_scores(df.limit(0), ["g"], ["a"], "t", F.col("fold") == 0).count() == 0
