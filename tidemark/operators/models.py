"""Return models on feature tables, with Spark ML.

Splits and folds come from a hash of the row key, so a rerun task or a second run gives every
row the same side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import ratio
from tidemark.operators import fold_logits, moments
from tidemark.operators.compiled import feature_texts
from tidemark.operators.lasso import homotopy
from tidemark.operators.order import quantile_bins, row_index
from tidemark.session import discard, materialise

# Columns left out of the models (ids, raw prices and their averages).
LEFT_OUT = (
    "date", "PERMNO", "COMNAM", "SICCD", "TICKER", "SHROUT", "PRC", "BIDLO", "ASKHI", "market_cap", "RETX",
)
# The forest grid. The learner's depth limit stands in for "no limit".
FOREST_GRID = {"numTrees": [50, 100], "maxDepth": [30, 10], "minInstancesPerNode": [1, 2]}
# What the forest and the boosted trees use unless told otherwise.
FOREST_DEFAULTS = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "all"}
BOOSTED_DEFAULTS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}
# Length of a lasso penalty path and the ratio of its ends.
PATH_STEPS, PATH_RATIO = 100, 1e-3
#: Vector entries of the rows that a task of a fit holds.
FIT_VALUES = 16_000_000


def spread(df: DataFrame, vector: str = "features") -> DataFrame:
    """The rows of a stored table in so many parts that none has many more than FIT_VALUES vector entries.

    A reader packs parts by the size of the files, where vectors are small; a fit holds its rows unpacked and reads all of a part in every round.
    """
    parts = -(-df.count() * vector_size(df, vector) // FIT_VALUES)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a table that a fit reads several times, and let it go afterwards."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


# ---- splits -------------------------------------------------------------------------------

def hash_fraction(keys: Sequence[str], seed: int) -> Column:
    """A repeatable number in [0, 1) from the row key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_train_flag(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Random split by key hash."""
    return df.withColumn("is_train", hash_fraction(keys, seed) < fraction)


def with_fold(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_fraction(keys, seed + 1) * folds).cast("int"))


def with_stratified_flag(df: DataFrame, stratum: str, keys: Sequence[str], fraction: float, seed: int = 17) -> DataFrame:
    """In every stratum the first ceil(fraction * n) rows in hash order are the train set; rows without a stratum leave.

    Only strata and keys are ranked. The rows themselves are not shuffled: each is compared with the first of its stratum beyond the train set.
    Where rows of equal keys lie on both sides of that border, whole rows are ranked instead. `df` is read twice.
    """
    order, known = ["_hash", *keys], df.filter(F.col(stratum).isNotNull())
    hashed = known.withColumn("_hash", hash_fraction(keys, seed))
    train_size = F.ceil(F.col("_n") * fraction)
    ranked = row_index(hashed.select(*dict.fromkeys([stratum, *order])), order, "_i", [stratum], total="_n")
    border = materialise(
        ranked.select(stratum, F.struct(*order).alias("_cut"), (F.col("_i") - train_size).alias("_past")).filter(F.col("_past").isin(-1, 0))
    )
    if not border.groupBy(stratum, "_cut").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        placed = row_index(hashed, order, "_i", [stratum], total="_n")
        return placed.withColumn("is_train", F.col("_i") < train_size).drop("_hash", "_i", "_n")
    marked = hashed.join(border.filter("_past = 0").drop("_past"), stratum, "left")
    before = F.coalesce(F.struct(*order) < F.col("_cut"), F.lit(True))  # a stratum without a border is all train
    return marked.withColumn("is_train", before).select(*df.columns, "is_train")


def target_strata(df: DataFrame, target: str, out: str = "stratum", groups: int = 5) -> DataFrame:
    """Quantile groups of a numeric target, to stratify a split by."""
    return quantile_bins(df, target, groups, out, duplicates="drop")


# ---- features -----------------------------------------------------------------------------

def model_columns(df: DataFrame, target: str, categorical: Sequence[str], left_out: Sequence[str] = LEFT_OUT) -> list[str]:
    """Every numeric column that is neither left out, nor a category, nor the target."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    skipped = {*left_out, *categorical, target}
    return [c for c, kind in df.dtypes if c not in skipped and (kind in numeric or kind.startswith("decimal"))]


def feature_stages(
    numeric: Sequence[str], categorical: Sequence[str] = (), hashed: Sequence[str] = (), hash_size: int = 4096
) -> list:
    """Scaled numbers and one-hot categories in one vector; unseen categories are all zero.

    Columns in `hashed` share a vector of `hash_size` places chosen by a hash of column and value.
    """
    stages = []
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="_hashed", numFeatures=hash_size, categoricalCols=list(hashed)))
    if categorical:
        stages += [
            StringIndexer(
                inputCols=list(categorical), outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(
                # the index after the last known category stands for unseen ones; dropping it makes them all zero
                inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True,
            ),
        ]
    stages += [
        VectorAssembler(inputCols=list(numeric), outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(
            inputCols=["_scaled", *[f"{c}_hot" for c in categorical], *(["_hashed"] if hashed else [])], outputCol="features"
        ),
    ]
    return stages


def fit_features(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), max_categories: int = 5000
) -> PipelineModel:
    """Encoders and scaler of the train rows.

    A category list lives on the driver and widens the vector by one place per value. A column with more than
    `max_categories` different values is hashed instead, so its list is never gathered. The categories are counted and listed from
    the different combinations, so of the rows they take one pass; the scaler takes another.
    """
    wide: list[str] = []
    if categorical:
        combinations = materialise(train.select(*[F.col(c).cast("string").alias(c) for c in categorical]).distinct())
        counts = combinations.agg(*[F.count_distinct(F.col(c)).alias(c) for c in categorical]).first()
        wide = [c for c in categorical if counts[c] > max_categories]
    listed = [c for c in categorical if c not in wide]
    fitted, texts = [], train
    for stage in feature_stages(numeric, listed, wide):
        if isinstance(stage, StringIndexer):
            stage = stage.fit(combinations)
        elif isinstance(stage, OneHotEncoder):
            stage = stage.fit(fitted[-1].transform(combinations))
        elif isinstance(stage, StandardScaler):
            stage = stage.fit(fitted[-1].transform(texts))
        fitted.append(stage)
    return PipelineModel(fitted)


def apply_features(model: PipelineModel, df: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """The rows, categories as text, with their vector. Where all categories are listed, its entries are plain expressions and put together once."""
    texts = df.withColumns({c: F.col(c).cast("string") for c in categorical})
    if any(isinstance(stage, FeatureHasher) for stage in model.stages):
        return model.transform(texts)
    described = model.transform(texts.limit(0)).schema["features"].metadata
    entries = {f"_entry{i}": F.expr(text) for i, text in enumerate(feature_texts(model))}
    vectors = VectorAssembler(inputCols=list(entries), outputCol="features").transform(texts.withColumns(entries))
    return vectors.select(*[F.col(f"`{c}`") for c in df.columns], F.col("features").alias("features", metadata=described))


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of the vector's entries, from the column's metadata."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    entries = sorted((a["idx"], a.get("name", str(a["idx"]))) for g in groups.values() for a in g)
    return [name for _, name in entries]


# ---- learners -----------------------------------------------------------------------------

def lasso(label: str, penalty: float = 0.0, standardize: bool = True) -> LinearRegression:
    """`standardize=False` puts the penalty on the features as they are."""
    return LinearRegression(
        labelCol=label, regParam=penalty, elasticNetParam=1.0, standardization=standardize, predictionCol="lasso_pred"
    )


def forest(label: str, seed: int = 12, **settings) -> RandomForestRegressor:
    """All features at every split, nearly unlimited depth, 100 trees, unless the settings say otherwise."""
    return RandomForestRegressor(labelCol=label, seed=seed, predictionCol="pred_forest", **(FOREST_DEFAULTS | settings))


def tree(label: str, depth: int = 30, gain: float = 0.0) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=label, maxDepth=depth, minInfoGain=gain, predictionCol="pred_forest")


def complexity_gain(train: DataFrame, label: str, cp: float) -> float:
    """The gain per split for a complexity parameter, which is relative to the variance of all rows."""
    return cp * (train.agg(F.var_pop(label)).first()[0] or 0.0)


def boosted(label: str, seed: int = 42, **settings) -> GBTRegressor:
    """100 rounds of depth 6 at step 0.3, unless the settings say otherwise."""
    return GBTRegressor(labelCol=label, seed=seed, predictionCol="pred_boosted", **(BOOSTED_DEFAULTS | settings))


def logistic(label: str) -> LogisticRegression:
    return LogisticRegression(labelCol=label, predictionCol="log_class", probabilityCol="log_probability")


@dataclass
class Search:
    """A grid search: the settings, their mean scores, and the best one fitted on all rows."""

    settings: list[dict]
    scores: list[float]
    larger_is_better: bool
    model: Model

    @property
    def best(self) -> int:
        pick = max if self.larger_is_better else min
        return self.scores.index(pick(self.scores))


def cross_validate(
    learner, grid: dict, train: DataFrame, judge, folds: int, keys: Sequence[str], parallelism: int = 4
) -> Search:
    """Grid search on hash folds.

    The library's own cross-validator checks a fold column with a Python function on every row,
    so the folds are filtered here; a few fits run at a time.
    """
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(learner.getParam(name), list(values))
    settings = builder.build()
    with kept(with_fold(train, keys, folds)) as folded:

        def score(task: tuple[int, int]) -> float:
            fold, setting = task
            fit = learner.fit(folded.filter(F.col("fold") != fold), settings[setting])
            return judge.evaluate(fit.transform(folded.filter(F.col("fold") == fold)))

        tasks = [(fold, setting) for setting in range(len(settings)) for fold in range(folds)]
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(train.sparkSession)(score), tasks)
        scores = [sum(found[i * folds : (i + 1) * folds]) / folds for i in range(len(settings))]
        search = Search(settings, scores, judge.isLargerBetter(), None)
        search.model = learner.fit(folded, settings[search.best])
    return search


def vector_size(df: DataFrame, vector: str = "features") -> int:
    """Length of a vector column, from its metadata or else from its first row."""
    known = df.schema[vector].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        first = df.select(vector).filter(F.col(vector).isNotNull()).first()
        known = first[0].size if first else 0
    return known


def fold_products(train: DataFrame, label: str, keys: Sequence[str], folds: int, vector: str = "features") -> list[np.ndarray]:
    """Sums of products of (1, features, label) over the rows of each fold: all a linear fit needs to know.

    One pass over the rows; the triangle of each fold's matrix reaches the driver as a few arrays.
    """
    size = vector_size(train, vector) + 2
    return moments.trimmed(moments.product_matrices(with_fold(train, keys, folds), F.col("fold"), folds, vector, label), size)


def _centred(products: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and covariances of (features, label) from their products."""
    n = products[0, 0]
    means = products[0, 1:] / n
    return n, means, products[1:, 1:] / n - np.outer(means, means)


def _scaled(covariance: np.ndarray, standardize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrix and target correlations of the features, and what their slopes are to be divided by."""
    d = len(covariance) - 1
    spread = np.sqrt(np.maximum(np.diag(covariance)[:d], 0))
    scale = np.where(spread > 1e-12, spread if standardize else 1.0, np.inf)  # a constant feature stays out
    return covariance[:d, :d] / np.outer(scale, scale), covariance[:d, d] / scale, scale


def lasso_coefficients(covariance: np.ndarray, penalties: Sequence[float], standardize: bool = True) -> np.ndarray:
    """Lasso slopes for falling penalties from the covariances of (features, label)."""
    gram, target, scale = _scaled(covariance, standardize)
    return homotopy(gram, target, penalties) / scale


def penalty_path(covariance: np.ndarray, standardize: bool = True, steps: int = PATH_STEPS, ratio_: float = PATH_RATIO) -> np.ndarray:
    """Falling penalties from the smallest that leaves no feature in."""
    target = _scaled(covariance, standardize)[1]
    return np.abs(target).max(initial=0.0) * np.logspace(0, np.log10(ratio_), steps)


@dataclass
class LassoPath:
    """Penalties, their mean squared error over the folds, and the slopes and intercept at the best one."""

    penalties: np.ndarray
    errors: np.ndarray
    slopes: np.ndarray
    intercept: float

    @property
    def best(self) -> int:
        return int(np.argmin(self.errors))


def lasso_path(
    train: DataFrame, label: str, keys: Sequence[str], folds: int = 5, penalties: Sequence[float] | None = None, standardize: bool = True
) -> LassoPath:
    """Cross-validate the lasso over a path of penalties that starts at the data's own largest one.

    The rows are read once, whatever the number of folds and penalties; fits and errors follow from the fold products.
    """
    matrices = [m for m in fold_products(train, label, keys, folds) if m[0, 0] > 0]
    if not matrices:
        raise ValueError("no complete rows to fit")
    _, means, whole = _centred(sum(matrices))
    path = penalty_path(whole, standardize) if penalties is None else np.sort(np.asarray(penalties, float))[::-1]
    errors = []
    for held in matrices if len(matrices) > 1 else []:
        _, inner_means, inner = _centred(sum(matrices) - held)
        slopes = lasso_coefficients(inner, path, standardize)
        weights = np.column_stack([inner_means[-1] - slopes @ inner_means[:-1], slopes, -np.ones(len(path))])
        errors.append(((weights @ held) * weights).sum(1) / held[0, 0])
    mean = np.mean(errors, axis=0) if errors else np.zeros(len(path))  # one fold cannot judge
    slopes = lasso_coefficients(whole, path, standardize)[int(np.argmin(mean))]
    return LassoPath(path, mean, slopes, float(means[-1] - slopes @ means[:-1]))


def path_table(spark, path: LassoPath) -> DataFrame:
    """One row per penalty of a lasso path."""
    rows = [(i, float(p), float(e), i == path.best) for i, (p, e) in enumerate(zip(path.penalties, path.errors))]
    return spark.createDataFrame(rows, "step int, penalty double, score double, best boolean")


def lasso_cv(train: DataFrame, label: str, keys: Sequence[str], penalties: Sequence[float], folds: int = 5):
    """Grid search over stated penalties with the library's learner."""
    judge = RegressionEvaluator(labelCol=label, predictionCol="lasso_pred", metricName="mse")
    return cross_validate(lasso(label), {"regParam": penalties}, train, judge, folds, keys)


def forest_cv(train: DataFrame, label: str, keys: Sequence[str], grid: dict | None = None, folds: int = 3):
    judge = RegressionEvaluator(labelCol=label, predictionCol="pred_forest", metricName="r2")
    return cross_validate(forest(label), grid or FOREST_GRID, train, judge, folds, keys, parallelism=2)


def _scored_folds(train: DataFrame, label: str, keys: Sequence[str], folds: int, together: Callable) -> DataFrame:
    """fold, label, margin of every train row, a stored table: by fits that are made together, or else by fits of the library's one by one."""
    folded = with_fold(train, keys, folds)
    width = vector_size(train)
    rows = materialise(folded.select("fold", F.col(label).cast("double").alias("label"), vector_to_array("features").alias("x")))
    fits = together(rows, folds, width) if 0 < width <= fold_logits.WIDEST else [None] * folds
    missing = [fold for fold, fit in enumerate(fits) if fit is None]
    if missing:
        with kept(folded) as held:

            def fitted(fold: int) -> np.ndarray:
                fit = logistic(label).fit(held.filter(F.col("fold") != fold))
                return np.r_[fit.intercept, fit.coefficients.toArray()]

            with ThreadPool(4) as pool:
                for fold, fit in zip(missing, pool.map(inheritable_thread_target(train.sparkSession)(fitted), missing)):
                    fits[fold] = fit
    scored = materialise(fold_logits.fold_margins(rows, fits))
    discard(rows)
    return scored


def fold_scores(train: DataFrame, label: str, keys: Sequence[str], folds: int) -> DataFrame:
    """fold, label, margin of every train row, by the logistic fit that left its fold out; a stored table.

    All folds are fitted together, to the optimum; the library's learner stops near it, which areas show in the third or fourth decimal. Wide vectors, and folds that reach no optimum that way, have a fit of the library's each.
    """
    return _scored_folds(train, label, keys, folds, fold_logits.fold_coefficients)


def library_fold_scores(train: DataFrame, label: str, keys: Sequence[str], folds: int) -> DataFrame:
    """As `fold_scores`, by fits that stop where the library's learner does; all folds share the passes, and no task holds rows between them."""
    return _scored_folds(train, label, keys, folds, fold_logits.library_coefficients)


def logistic_cv(train: DataFrame, label: str, keys: Sequence[str], folds: int = 10) -> Search:
    """The mean area under the ROC curve over the folds, and the fit on all rows; without a penalty there is one setting."""
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="margin", metricName="areaUnderROC")
    scored = fold_scores(train, label, keys, folds)
    with ThreadPool(4) as pool:
        areas = pool.map(inheritable_thread_target(train.sparkSession)(lambda fold: judge.evaluate(scored.filter(F.col("fold") == fold))), range(folds))
    discard(scored)
    learner = logistic(label)
    setting = {learner.regParam: 0.0}
    with kept(with_fold(train, keys, folds)) as folded:
        return Search([setting], [sum(areas) / folds], judge.isLargerBetter(), learner.fit(folded, setting))


def roc_table(train: DataFrame, label: str, keys: Sequence[str], folds: int = 10) -> DataFrame:
    """Area under the ROC curve, sensitivity and specificity of a logistic fit on each fold left out.

    The first class is the positive one and is predicted from a probability of one half.
    """
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="margin", metricName="areaUnderROC")
    scored = library_fold_scores(train, label, keys, folds)
    up, hit = F.col("label") == 1, (F.col("margin") > 0).cast("double") == F.col("label")
    counts = scored.groupBy("fold").agg(
        F.count(F.lit(1)), F.count(F.when(up & hit, 1)), F.count(F.when(up, 1)), F.count(F.when(~up & hit, 1)), F.count(F.when(~up, 1))
    )
    found = {fold: rest for fold, *rest in counts.collect()}

    def one(fold: int) -> tuple:
        n, right_up, ups, right_down, downs = found.get(fold, [0] * 5)
        area = float(judge.evaluate(scored.filter(F.col("fold") == fold))) if ups and downs else None
        return fold, n, area, right_up / ups if ups else None, right_down / downs if downs else None

    with ThreadPool(4) as pool:
        rows = pool.map(inheritable_thread_target(train.sparkSession)(one), range(folds))
    discard(scored)
    return train.sparkSession.createDataFrame(rows, "fold int, n long, roc double, sensitivity double, specificity double")


# ---- results ------------------------------------------------------------------------------

def metrics(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean squared error, its root and R2, as a plain aggregate over the predictions."""
    y, p = F.col(label), F.col(prediction)
    complete = df.filter(y.isNotNull() & p.isNotNull())
    parts = complete.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("_var")
    )
    return parts.select(
        *groups, "n", "mse", F.sqrt("mse").alias("rmse"), (1 - ratio(F.col("mse"), F.col("_var"))).alias("r2")
    )


def as_class(df: DataFrame, column: str = "log_class", out: str = "log_pred") -> DataFrame:
    return df.withColumn(out, F.when(F.col(column) == 1.0, "Positive").when(F.col(column) == 0.0, "Negative"))


def with_probability(df: DataFrame, vector: str = "log_probability", out: str = "p_positive") -> DataFrame:
    return df.withColumn(out, vector_to_array(vector)[1])


def coefficient_table(spark, model: Model, names: Sequence[str]) -> DataFrame:
    """Non-zero coefficients with their names, intercept included."""
    rows = [("(intercept)", float(model.intercept))]
    rows += [(n, float(c)) for n, c in zip(names, model.coefficients) if c != 0.0]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def logit_table(train: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """Logistic fit with standard error, z and p for every feature."""
    fit = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label, maxIter=50, tol=1e-10).fit(train)
    summary = fit.summary
    estimates = [*fit.coefficients, fit.intercept]
    rows = [
        (name, float(b), float(e), float(z), float(p))
        for name, b, e, z, p in zip(
            [*names, "(intercept)"], estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues
        )
    ]
    return train.sparkSession.createDataFrame(
        rows, "feature string, coefficient double, std_error double, z double, p_value double"
    )


def tuning_table(spark, search: Search) -> DataFrame:
    """Mean score of every grid setting, and which one won."""
    rows = []
    for i, (setting, score) in enumerate(zip(search.settings, search.scores)):
        named = ", ".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda kv: kv[0].name))
        rows.append((named, float(score), i == search.best))
    return spark.createDataFrame(rows, "setting string, score double, best boolean")
