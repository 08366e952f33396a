"""Linear models from distributed normal equations.

One grouped pass sums the products of features and target (X'X, X'y, y'y) per
group; nothing else reads the rows. Models, their errors on any other group and
whole cross-validations then follow from a few numbers per group: the training
moments of a fold are the sum of the other folds' moments, and the squared error
on the held-out fold is a quadratic form of its own. No row is fitted twice and no
fit runs per fold.

Rows with a null feature or target take no part. A feature without variance left
(constant or collinear with earlier ones) gets the coefficient 0; R^2 is null
where the target is constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9          # pivots below this share of the feature's variance count as 0


def _names(xs: Sequence[str]) -> list[tuple[str, str]]:
    terms = [*xs, "y"]
    return [(a, b) for i, a in enumerate(terms) for b in terms[i:]]


def moments(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Per group: m_n, the sums m_<a> and the sums of products m_<a>_<b> of features and target (named y)."""
    rows = df.select(*by, *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("y")).dropna(subset=[*xs, "y"])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("m_n"), *[F.sum(a).alias(f"m_{a}") for a in (*xs, "y")],
        *[F.sum(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for a, b in _names(xs)])


def _columns(xs: Sequence[str]) -> list[str]:
    return ["m_n", *[f"m_{a}" for a in (*xs, "y")], *[f"m_{a}_{b}" for a, b in _names(xs)]]


def solve(m: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Add ``intercept`` and ``b_<x>`` from the moments: elimination on the covariances, one projection a step."""
    xs, n = list(xs), F.col("m_n")
    cov = {(a, b): F.col(f"m_{a}_{b}") / n - F.col(f"m_{a}") / n * F.col(f"m_{b}") / n for a, b in _names(xs)}
    out = m.withColumns({f"_c_{a}_{b}": c for (a, b), c in cov.items()})
    out = out.withColumns({f"_v_{x}": F.col(f"_c_{x}_{x}") for x in xs})
    for k, x in enumerate(xs):
        pivot = F.when(F.col(f"_c_{x}_{x}") > F.col(f"_v_{x}") * TINY, F.col(f"_c_{x}_{x}"))
        rest = [*xs[k + 1:], "y"]
        factor = {a: F.coalesce(F.try_divide(F.col(f"_c_{x}_{a}"), pivot), F.lit(0.0)) for a in rest}
        out = out.withColumns({f"_f_{x}_{a}": f for a, f in factor.items()})
        out = out.withColumns({f"_c_{a}_{b}": F.col(f"_c_{a}_{b}") - F.col(f"_f_{x}_{a}") * F.col(f"_c_{x}_{b}")
                               for i, a in enumerate(rest) for b in rest[i:]})
    for k in range(len(xs) - 1, -1, -1):
        later = [F.col(f"_f_{xs[k]}_{x}") * F.col(f"b_{x}") for x in xs[k + 1:]]
        out = out.withColumn(f"b_{xs[k]}", F.col(f"_f_{xs[k]}_y") - sum(later, F.lit(0.0)))
    level = F.col("m_y") / n - sum((F.col(f"b_{x}") * F.col(f"m_{x}") / n for x in xs), F.lit(0.0))
    return out.withColumn("intercept", level).drop(*[c for c in out.columns if c[:3] in ("_c_", "_v_", "_f_")])


def errors(m: DataFrame, xs: Sequence[str]) -> tuple[Column, Column]:
    """(rmse, r2) of the model columns on the group whose moments stand beside them."""
    terms: list[tuple[Column, str]] = [(F.lit(-1.0), "y"), *[(F.col(f"b_{x}"), x) for x in xs]]
    order = [*xs, "y"]
    square = F.lit(0.0)
    for ca, a in terms:
        for cb, b in terms:
            first, second = sorted((a, b), key=order.index)
            square = square + ca * cb * F.col(f"m_{first}_{second}")
    cross = sum((c * F.col(f"m_{a}") for c, a in terms), F.lit(0.0))
    sse = F.greatest(square + F.col("intercept") * cross * 2 + F.col("intercept") * F.col("intercept") * F.col("m_n"), F.lit(0.0))
    sst = F.col("m_y_y") - F.col("m_y") * F.col("m_y") / F.col("m_n")
    return F.sqrt(sse / F.col("m_n")), F.when(sst > TINY, F.lit(1.0) - sse / sst)


def cross_validated(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, fold: str = "fold") -> DataFrame:
    """Per group and fold the model of all other folds (n_train, intercept, b_<x>) and its n_test, rmse and r2 on the fold."""
    folds = moments(df, [*by, fold], xs, y)
    names, whole = _columns(xs), Window.partitionBy(*by)      # a few folds per group
    both = folds.select(*by, fold, *[F.col(c).alias(f"t_{c}") for c in names], *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in names])
    fitted = solve(both.where("m_n > 0"), xs).withColumn("n_train", F.col("m_n")).drop(*names)
    tested = fitted.withColumnsRenamed({f"t_{c}": c for c in names})
    rmse, r2 = errors(tested, xs)
    return tested.select(*by, fold, "n_train", F.col("m_n").alias("n_test"), "intercept", *[f"b_{x}" for x in xs], rmse.alias("rmse"), r2.alias("r2"))


def split_scores(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, valid: Column) -> DataFrame:
    """M9: the linear model of each group's training rows, scored on both splits (``split``: train, valid)."""
    both = moments(df.withColumn("split", F.when(valid, F.lit("valid")).otherwise(F.lit("train"))), [*by, "split"], xs, y)
    model = solve(both.where("split = 'train'"), xs).select(*by, "intercept", *[f"b_{x}" for x in xs])
    scored = both.join(model, list(by))
    rmse, r2 = errors(scored, xs)
    return scored.select(*by, "split", F.col("m_n").alias("n"), "intercept", *[f"b_{x}" for x in xs], rmse.alias("rmse"), r2.alias("r2"))
