"""Model pipeline (M4-M12, M14) on ``pyspark.ml``.

One ``Pipeline`` per compound: mean imputation + standard scaling of the
numeric features (M4), index + one-hot of categoricals with unknowns mapped
to the all-zero vector (M5), and a random forest (M6). Every fit is a
distributed job over that compound's rows; the compounds (and CV folds) are
fitted as concurrent Spark jobs from a few driver threads (M7). Spark's forest bins continuous features, so its trees are
not the reference's trees; the minimum split size that it lacks is applied to
the fitted node table (``preparation.node_table``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.operators.quality import regression_metrics
from liftlake.operators.scan import KeyedScan
from liftlake.session import materialize, release, stored
from liftlake.schema import COMPOUNDS, KEY, ORDER, ForestParams  # noqa: F401

NUMERIC_FEATURES = ("weight", "reps", "rpe", "effective_load", "set_volume", "rolling_avg_load_last_3_sessions",
                    "rolling_trend_load", "percent_of_max", "cycle_weight_trend", "max_weight_so_far",
                    "cycle_number", "weeks_in_cycle", "load_delta")
CATEGORICAL_FEATURES = ("is_deload",)
TARGET = "next_load_delta"

# Per-compound overrides, e.g. a deliberately weak model to exercise fallbacks.
COMPOUND_OVERRIDES: dict[str, dict] = {}


ROW_BYTES = 400     # of a row in a forest's memory, beside its counts


class NotFittedError(RuntimeError):
    pass


def _estimator(kind: str, params: ForestParams, label: str, overrides: dict | None = None):
    o = dict(overrides or {})
    if kind == "rf":
        return RandomForestRegressor(
            featuresCol="features", labelCol=label, predictionCol="prediction",
            numTrees=o.get("num_trees", params.num_trees), maxDepth=o.get("max_depth", params.max_depth),
            featureSubsetStrategy=o.get("feature_subset", params.feature_subset),
            minInstancesPerNode=o.get("min_instances_per_node", params.min_instances_per_node),
            seed=o.get("seed", params.seed))
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction")
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                            maxDepth=o.get("max_depth", params.max_depth), seed=params.seed)
    raise ValueError(f"Unknown estimator type: {kind}")


def build_pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str = TARGET, kind: str = "rf",
                   params: ForestParams = ForestParams(), overrides: dict | None = None) -> Pipeline:
    """M4 + M5 + M6 as one Pipeline."""
    numeric, categorical = list(numeric), list(categorical)
    stages = []
    imputed = [f"{c}__imp" for c in numeric]
    stages.append(Imputer(inputCols=numeric, outputCols=imputed, strategy="mean"))
    stages.append(VectorAssembler(inputCols=imputed, outputCol="num_vec", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True))
    parts = ["num_scaled"]
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"{c}__str", outputCol=f"{c}__idx", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True,
                                    handleInvalid="keep"))
        parts.append(f"{c}__oh")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    stages.append(_estimator(kind, params, label, overrides))
    return Pipeline(stages=stages)


def _prep(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Feature columns as the pipeline expects them; a training feature the
    frame lacks is added as 0 (PF19: align validation columns to training)."""
    cols = {c: F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in numeric}
    cols.update({f"{c}__str": F.col(c).cast("string") if c in df.columns else F.lit("0")
                 for c in categorical})
    return df.withColumns(cols)


@dataclass
class CompoundModel:
    """Fit / predict / evaluate around a Pipeline, with metadata (IO8)."""
    name: str
    kind: str = "rf"
    numeric: tuple = NUMERIC_FEATURES
    categorical: tuple = CATEGORICAL_FEATURES
    target: str = TARGET
    params: ForestParams = field(default_factory=ForestParams)
    overrides: dict = field(default_factory=dict)
    model: PipelineModel | None = None
    created_at: str = ""

    def features_of(self, df: DataFrame) -> tuple[list[str], list[str]]:
        return ([c for c in self.numeric if c in df.columns], [c for c in self.categorical if c in df.columns])

    def fit(self, df: DataFrame, known: dict[str, int] | None = None) -> "CompoundModel":
        """``known``: how many rows with a target have a value, by feature, where that was counted before.

        The estimator reads the prepared features several times, so they are kept until it is fitted."""
        if self.target not in df.columns:
            raise ValueError(f"no column {self.target!r} to fit")
        num, cat = self.features_of(df)
        # a feature without any value in the training rows (A7) is left out
        if known is None:
            known = df.where(F.col(self.target).isNotNull()).agg(*[F.count(c).alias(c) for c in num]).first()
        num = [c for c in num if known[c]]
        self.numeric, self.categorical = tuple(num), tuple(cat)
        data = _prep(df.where(F.col(self.target).isNotNull()), num, cat)
        *steps, estimator = build_pipeline(num, cat, self.target, self.kind, self.params, self.overrides).getStages()
        prepared = Pipeline(stages=steps).fit(data)
        rows = prepared.transform(data).select("features", self.target).persist()
        try:
            self.model = PipelineModel([*prepared.stages, estimator.fit(rows)])
        finally:
            rows.unpersist()
        self.created_at = datetime.now(timezone.utc).isoformat()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFittedError(f"model '{self.name}' is not fitted")
        out = self.model.transform(_prep(df, self.numeric, self.categorical))
        keep = [c for c in df.columns] + ["prediction"]
        return out.select(*keep)

    def evaluate(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return regression_metrics(self.predict(df), self.target, "prediction", by)

    def metadata(self) -> dict:
        return {"model_name": self.name, "version": "0.1.0", "created_at": self.created_at,
                "feature_columns": list(self.numeric) + list(self.categorical), "target_column": self.target,
                "random_state": self.params.seed, "extra": {"kind": self.kind, "params": asdict(self.params),
                                                            "overrides": self.overrides}}

    def save(self, path: str, overwrite: bool = True) -> None:
        from liftlake.sources.store import save_model
        if self.model is None:
            raise NotFittedError(f"model '{self.name}' is not fitted")
        save_model(self.model, path, self.metadata(), overwrite)

    @classmethod
    def load(cls, path: str) -> "CompoundModel":
        from liftlake.sources.store import load_model
        model, meta = load_model(path)
        feats = meta["feature_columns"]
        cat = tuple(c for c in feats if c in CATEGORICAL_FEATURES)
        num = tuple(c for c in feats if c not in cat)
        return cls(name=meta["model_name"], kind=meta["extra"]["kind"], numeric=num, categorical=cat,
                   target=meta["target_column"], params=ForestParams(**meta["extra"]["params"]),
                   overrides=meta["extra"]["overrides"], model=model, created_at=meta["created_at"])


def _parallel(fn, items, workers: int | None = None):
    """Run independent fits as concurrent Spark jobs (driver threads); each
    fit is itself distributed. Results come back in input order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    workers = workers or min(4, len(items)) or 1
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fn, items))


def _fits_at_once(spark, rows: int, params: ForestParams = ForestParams(), most: int = 4) -> int:
    """How many forests of ``rows`` rows fit the executors' memory together: a fit keeps each row with
    its features and a count per tree, and reads them from disk at every level if they do not fit."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    sizes = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status).values()
    return max(1, min(most, int(sum(x._1() for x in sizes) / (rows * (4 * params.num_trees + ROW_BYTES) + 1))))


def with_split(df: DataFrame, fraction: float = 0.8) -> DataFrame:
    """W18 per key, used for train / validation."""
    from liftlake.operators.sequence import chronological_split
    return chronological_split(df, fraction)


def split_then_prepare(features: DataFrame, fraction: float = 0.8) -> DataFrame:
    """W18 first, then M3 with the clip bounds of the training rows: nothing
    fitted sees a validation row. Adds ``split``; only rows with a target."""
    from liftlake.operators.features import fit_bounds, fit_varies, prepare
    split = stored(with_split(features.where(F.col(TARGET).isNotNull()), fraction))
    train = split.where(F.col("split") == "train")
    return stored(prepare(split, bounds=fit_bounds(train, by=("compound",)), varies=fit_varies(train, by=("compound",))))


def _own_rows(df: DataFrame, comp: str, *more: str) -> DataFrame:
    """The model's columns of one compound's rows, stored: a fit reads them about ten times."""
    names = [c for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, TARGET, *more) if c in df.columns]
    return stored(df.where(F.col("compound") == comp).select(*names))


def train_validate(features: DataFrame, compounds: Sequence[str] = COMPOUNDS, kind: str | Sequence[str] = "rf",
                   fraction: float = 0.8, min_targets: int = 10,
                   overrides: dict[str, dict] | None = None) -> tuple[DataFrame, dict[str, CompoundModel]]:
    """M14 (+M7, M13): per compound, fit on each key's first 80 % and report
    MAE / MSE / RMSE / R^2 on train and validation rows. ``features`` are
    session features before M3. Compounds with fewer than ``min_targets``
    training rows are not fitted: one row with ``status`` = 'skipped'.
    ``overrides`` are forest settings per compound (M7)."""
    overrides = COMPOUND_OVERRIDES if overrides is None else overrides
    kinds = [kind] if isinstance(kind, str) else list(kind)
    split = split_then_prepare(features, fraction)
    train_rows = split.where(F.col("split") == "train").groupBy("compound").count()
    enough = {r["compound"] for r in train_rows.where(F.col("compound").isin(list(compounds)) & (F.col("count") >= min_targets)).collect()}

    parts = {c: _own_rows(split, c, "split") for c in compounds if c in enough}

    def fit_one(task):
        comp, k = task
        part = parts[comp]
        model = CompoundModel(name=comp, kind=k, overrides=overrides.get(comp, {}) if k == "rf" else {}).fit(
            part.where(F.col("split") == "train"))
        return task, model, model.evaluate(part, ["split"]).withColumns(
            {"compound": F.lit(comp), "model": F.lit(k), "status": F.lit("fitted")})

    from liftlake.functions.scalar import local_table
    skipped = [(c, k) for c in compounds for k in kinds if c not in enough]
    out = local_table(split.sparkSession, skipped, ["compound", "model"], ["string", "string"]).withColumn("status", F.lit("skipped"))
    models = {}
    for (comp, k), model, rep in _parallel(fit_one, [(c, k) for k in kinds for c in compounds if c in enough]):
        models[comp if len(kinds) == 1 else f"{comp}/{k}"] = model
        out = rep.unionByName(out, allowMissingColumns=True)
    return out, models


def compare_models(features: DataFrame, compounds: Sequence[str] = COMPOUNDS) -> DataFrame:
    """M9 + SL3: random forest vs linear vs boosted trees on one split;
    ``model_rank`` orders a compound's models by validation R^2."""
    report, _ = train_validate(features, compounds, ("rf", "linear", "gbt"))
    report = materialize(report, force=True)
    order = F.when(F.col("split") == "valid", F.col("r2"))
    best = report.groupBy("compound", "model").agg(F.max(order).alias("_r2"))
    rank = F.row_number().over(Window.partitionBy("compound").orderBy(F.desc_nulls_last("_r2"), "model"))
    return report.join(best.select("compound", "model", rank.alias("model_rank")), ["compound", "model"])


def node_report(features: DataFrame, overrides: dict[str, dict] | None = None, min_split: int = 8,
                compounds: Sequence[str] = COMPOUNDS) -> DataFrame:
    """M6 + M7 + M14 by their invariants, one row per fitted compound: rows and split,
    trees, and whether the node table scores as the fitted model does, no split
    kept under the minimum split size is below it, depth and leaf sizes
    are as set, and all metrics are finite."""
    from liftlake.operators import preparation as P
    from liftlake.session import checkpoint_dir
    import uuid
    spark = features.sparkSession
    prepared = split_then_prepare(features)
    root = f"{checkpoint_dir(spark).rstrip('/')}/liftlake-forests/{uuid.uuid4().hex}"

    def one(comp):
        part = _own_rows(prepared, comp, "split")
        train = part.where(F.col("split") == "train")
        if train.count() < 10:
            return None
        model = CompoundModel(name=comp, overrides=(overrides or {}).get(comp, {})).fit(train)
        forest = model.model.stages[-1]
        forest.write().overwrite().save(f"{root}/{comp}")
        whole, kept = (P.node_table(spark, f"{root}/{comp}", m).collect() for m in (0, min_split))
        scored = model.model.transform(_prep(part, model.numeric, model.categorical))
        scored = P.score(P.score(scored, whole, name="_whole"), kept, name="_kept")
        gap = F.abs(F.col("_whole") - F.col("prediction"))
        err = F.col("_kept") - F.col(model.target)
        r = scored.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "valid").alias("n_valid"),
                       F.max(gap).alias("gap"), F.avg(err * err).alias("mse")).first()
        o = model.overrides
        small = any(x["feature"] >= 0 and x["n_rows"] < min_split for x in P.reached(kept))
        leaves = all(x["n_rows"] >= model.params.min_instances_per_node for x in P.reached(whole))
        deep = max(t.depth for t in forest.trees) <= o.get("max_depth", model.params.max_depth)
        return (comp, r["n_train"], r["n_valid"], forest.getNumTrees, r["gap"] <= 1e-9, not small, leaves, deep,
                r["mse"] is not None and r["mse"] < float("inf"))

    from liftlake.functions.scalar import local_table
    names = ["compound", "n_train", "n_valid", "trees", "nodes_score_as_model", "splits_large_enough", "leaves_large_enough",
             "depth_as_set", "finite"]
    return local_table(spark, [r for r in _parallel(one, compounds) if r], names,
                       ["string", "bigint", "bigint", "int"] + ["boolean"] * 5)


def contiguous_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Fold id = contiguous block of each key's history (no shuffling)."""
    scan = KeyedScan.build(df, KEY, ORDER)
    out = scan.finish(scan.with_seq(scan.df, "_pos"))
    n = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(n, list(KEY)).withColumn(
        "fold", F.floor((F.col("_pos") - 1) * k / F.col("_n")).cast("int")).drop("_pos", "_n")


def cross_validate(features: DataFrame, compounds: Sequence[str] = COMPOUNDS, k: int = 5, kind: str = "rf",
                   max_mean_drop: float = 0.0, max_std: float = 0.5) -> DataFrame:
    """M10 + M11: k-fold R^2 per compound, mean / std, and the CV gate
    (rejected when the mean R^2 is below ``max_mean_drop`` or too volatile).

    The fits of all folds before the model (M3) are made at once and applied as literals, a row counting for
    every fold but its own; each compound's rows are stored once, for all its folds."""
    from liftlake.operators.features import fit_held_out, prepare
    folded = stored(contiguous_folds(features.where(F.col(TARGET).isNotNull()), k))
    parts = {c: _own_rows(folded, c, "fold", "compound") for c in compounds}
    known = folded.where(F.col("compound").isin(list(compounds)))
    bounds, varies = fit_held_out(known, k, by=("compound",))
    numeric = [c for c in NUMERIC_FEATURES if c in folded.columns]
    counts = known.groupBy("compound", "fold").agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in numeric]).collect()
    release(folded)

    def count(comp, of, held=None):
        return sum(r[of] for r in counts if r["compound"] == comp and r["fold"] != held)

    def fit_fold(task):
        comp, f = task
        here = (F.col("compound") == comp) & (F.col("held") == f)
        part = prepare(parts[comp], by=(), bounds=bounds.where(here), varies=varies.where(here)).drop("compound")
        model = CompoundModel(name=comp, kind=kind).fit(
            part.where(F.col("fold") != f), {c: count(comp, c, f) for c in numeric})
        # evaluate now: the fold's R^2 is a one-row result
        r = model.evaluate(part.where(F.col("fold") == f)).first()
        return comp, f, r["r2"] if r is not None else None

    spark = features.sparkSession
    workers = _fits_at_once(spark, max((count(c, "rows") for c in compounds), default=0)) if kind == "rf" else None
    rows = _parallel(fit_fold, [(c, f) for c in compounds for f in range(k)], workers)
    release(*parts.values())
    from liftlake.functions.scalar import local_table
    folds = local_table(spark, rows, ["compound", "fold", "r2"], ["string", "int", "double"])
    return gate_cv(folds, max_mean_drop, max_std)


def gate_cv(folds: DataFrame, max_mean_drop: float = 0.0, max_std: float = 0.5) -> DataFrame:
    """Per compound mean / std of fold R^2 and whether the model passes."""
    g = folds.groupBy("compound").agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                                      F.count(F.lit(1)).alias("folds"))
    ok = (F.col("cv_r2_mean") >= max_mean_drop) & (F.col("cv_r2_std") <= max_std)
    return g.withColumn("accepted", F.coalesce(ok, F.lit(False)))
