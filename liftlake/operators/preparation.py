"""Fitted preprocessing as a table (M4, M5) and fitted forests as node tables (M6).

What a model learns before and inside its trees is small and regular, so it is
kept as rows: means and deviations of numeric columns, the index of every
category, and one row per tree node. Rows can be stored, compared and applied
by plain expressions, without the fitted object.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.operators.scan import null_safe_join
from liftlake.session import broadcast_checked


def fit_preprocessing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                      by: Sequence[str] = ("compound",)) -> DataFrame:
    """by..., column_name, mean, std, category, category_index.

    Numeric columns (M4): the mean of the known values, and the sample standard
    deviation after missing values took the mean; both null when no value is known,
    std null for a single row. Categories (M5): indexed from 0 by falling frequency,
    equal ones alphabetically; nulls are no category. One aggregate over the long
    form each, combined before the shuffle. Empty tables give no rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_v")) for c in numeric])
    spread = F.sqrt(F.var_pop("_v") * F.count("_v") / F.nullif(F.count(F.lit(1)) - 1, F.lit(0)))
    out = (df.select(*by, F.inline(cells)).groupBy(*by, "column_name")
           .agg(F.avg("_v").alias("mean"), spread.alias("std")))
    out = out.withColumns({"category": F.lit(None).cast("string"), "category_index": F.lit(None).cast("int")})
    if not categorical:
        return out
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in categorical])
    counts = (df.select(*by, F.inline(cells)).where("category IS NOT NULL")
              .groupBy(*by, "column_name", "category").agg(F.count(F.lit(1)).alias("_n")))
    rank = F.row_number().over(Window.partitionBy(*by, "column_name").orderBy(F.desc("_n"), "category")) - 1
    none = F.lit(None).cast("double")
    return out.unionByName(counts.select(*by, "column_name", none.alias("mean"), none.alias("std"), "category",
                                         rank.cast("int").alias("category_index")))


def apply_preprocessing(df: DataFrame, table: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                        by: Sequence[str] = ("compound",)) -> DataFrame:
    """Adds ``<c>__scaled`` (missing values take the mean; a column without
    deviation is 0) and ``<c>__index`` (null: unknown category). Groups that
    were not fitted get nulls. The table is one row per group, broadcast when its measured size allows."""
    entry = F.struct("column_name", F.struct("mean", "std"))
    known = F.struct(F.concat_ws("=", "column_name", "category"), "category_index")
    fitted = table.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("category").isNull(), entry))).alias("_scale"),
        F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), known))).alias("_index"))
    out = null_safe_join(df, broadcast_checked(fitted), by)
    cols = {}
    for c in numeric:
        mean, std = F.col("_scale")[c]["mean"], F.col("_scale")[c]["std"]
        gap = F.coalesce(F.col(c).cast("double"), mean) - mean
        cols[f"{c}__scaled"] = F.when(std > 0, gap / std).when(mean.isNotNull(), F.lit(0.0))
    for c in categorical:
        cols[f"{c}__index"] = F.try_element_at(F.col("_index"), F.concat_ws("=", F.lit(c), F.col(c).cast("string")))
    return out.withColumns(cols).drop("_scale", "_index")


def node_table(spark, path: str, min_split: int = 0) -> DataFrame:
    """A saved forest (``model.write().save(path)``) as rows: tree, node, feature
    (position in the vector, -1 for a leaf), threshold, categories (those that
    go left; null for a threshold), left, right, value, n_rows.

    With ``min_split`` every split of fewer training rows becomes a leaf with its
    own mean: the minimum split size that the trainer lacks. Nodes below such
    a leaf stay in the table; no walk from node 0 reaches them."""
    n = F.col("nodeData")
    split = (n["leftChild"] >= 0) & (n["rawCount"] >= min_split)
    ordered = n["split"]["numCategories"] < 0
    values = n["split"]["leftCategoriesOrThreshold"]
    return spark.read.parquet(f"{path.rstrip('/')}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(split, n["split"]["featureIndex"]).otherwise(-1).alias("feature"),
        F.when(split & ordered, values[0]).alias("threshold"), F.when(split & ~ordered, values).alias("categories"),
        F.when(split, n["leftChild"]).otherwise(-1).alias("left"), F.when(split, n["rightChild"]).otherwise(-1).alias("right"),
        n["prediction"].alias("value"), n["rawCount"].alias("n_rows"))


def reached(nodes: list) -> list:
    """The collected nodes that a walk from the roots can reach."""
    by_id = {(r["tree"], r["node"]): r for r in nodes}
    stack, out = [(t, 0) for t in sorted({r["tree"] for r in nodes})], []
    while stack:
        tree, node = stack.pop()
        row = by_id[tree, node]
        out.append(row)
        if row["feature"] >= 0:
            stack += [(tree, row["right"]), (tree, row["left"])]
    return out


def score_expression(nodes: list, array: str = "_features") -> F.Column:
    """The forest's mean prediction as one conditional expression per tree over an
    array column. ``nodes`` are the collected rows of ``node_table``: at most trees
    x 2^(depth + 1), whatever the data, so they may come to the driver."""
    by_id = {(r["tree"], r["node"]): r for r in nodes}

    def branch(tree, node):
        r = by_id[tree, node]
        if r["feature"] < 0:
            return f"({r['value']!r}D)"
        x = f"{array}[{r['feature']}]"
        if r["categories"] is None:
            test = f"{x} <= ({r['threshold']!r}D)"
        else:
            test = f"{x} IN ({', '.join(f'{float(v)!r}D' for v in r['categories'])})" if r["categories"] else "false"
        return f"CASE WHEN {test} THEN {branch(tree, r['left'])} ELSE {branch(tree, r['right'])} END"

    trees = sorted({r["tree"] for r in nodes})
    return F.expr(f"({' + '.join(branch(t, 0) for t in trees)}) / {len(trees)}")


def score(df: DataFrame, nodes: list, features: str = "features", name: str = "node_prediction") -> DataFrame:
    """``df`` with the prediction of a forest's node rows on a vector column."""
    return (df.withColumn("_features", vector_to_array(F.col(features)))
            .withColumn(name, score_expression(nodes)).drop("_features"))
