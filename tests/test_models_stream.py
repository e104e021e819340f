"""Model properties on planted data, and the stream against the batch."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import aggregates, fold_logits, models
from tidemark.functions.labels import label_counts, normalise_label
from tidemark.session import materialise, scratch_path
from tidemark.streaming import news_counts

C = F.col


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    data = []
    for i in range(600):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("uvw")
        data.append((i, a, b, c, 2 * a + (1.0 if c == "u" else 0.0) + rng.gauss(0, 0.3)))
    return spark.createDataFrame(data, "id int, a double, b double, c string, y double")


@pytest.fixture(scope="module")
def vectors(planted):
    flagged = models.with_train_flag(planted, ["id"], 0.8)
    pipe = models.fit_features(flagged.filter("is_train"), ["a", "b"], ["c"])
    return models.apply_features(pipe, flagged, ["c"]).cache()


def test_split_is_repeatable_and_near_its_share(planted):
    one, two = (models.with_train_flag(planted.repartition(n), ["id"], 0.8) for n in (2, 7))
    assert one.exceptAll(two).count() == 0
    assert 0.74 < one.filter("is_train").count() / 600 < 0.86


def test_stratified_split_is_exact(planted):
    split = models.with_stratified_flag(planted, "c", ["id"], 0.7)
    for row in split.groupBy("c").agg(F.count("*").alias("n"), F.sum(C("is_train").cast("int")).alias("k")).collect():
        assert row["k"] == -(-row["n"] * 7 // 10)


def test_lasso_shrinks_and_beats_the_mean(spark, vectors):
    train, test = vectors.filter("is_train"), vectors.filter("NOT is_train")
    sizes = []
    for penalty in (0.0, 0.3, 5.0):
        fit = models.lasso("y", penalty).fit(train)
        sizes.append(sum(abs(x) for x in fit.coefficients))
    assert sizes[0] > sizes[1] > sizes[2] == 0.0
    good = models.metrics(models.lasso("y", 0.01).fit(train).transform(test), "y", "lasso_pred").first()
    assert good["r2"] > 0.9 and good["rmse"] ** 2 == pytest.approx(good["mse"])


def test_same_seed_same_forest(vectors):
    def fit():
        learner = models.forest("y", numTrees=5, maxDepth=4)
        return [r[0] for r in learner.fit(vectors).transform(vectors).orderBy("id").select("pred_forest").collect()]

    assert fit() == fit()


def test_unseen_category_is_all_zero(spark, planted, vectors):
    pipe = models.fit_features(planted, ["a"], ["c"])
    odd = spark.createDataFrame([(0.0, "new")], "a double, c string")
    seen = models.apply_features(pipe, planted.limit(1), ["c"]).first()["features"].toArray()
    new = models.apply_features(pipe, odd, ["c"]).first()["features"].toArray()
    assert len(new) == len(seen) and not new[1:].any()


def test_names_and_coefficients(spark, vectors):
    names = models.feature_names(vectors)
    assert len(names) == len(vectors.first()["features"])
    fit = models.lasso("y", 0.05).fit(vectors)
    table = {r["feature"]: r["coefficient"] for r in models.coefficient_table(spark, fit, names).collect()}
    assert "(intercept)" in table and all(v != 0 for k, v in table.items() if k != "(intercept)")


def test_tuning_table(spark, vectors):
    search = models.lasso_cv(vectors, "y", ["id"], [0.001, 3.0], folds=3)
    rows = {r["setting"]: r for r in models.tuning_table(spark, search).collect()}
    assert rows["regParam=0.001"]["best"] and rows["regParam=0.001"]["score"] < rows["regParam=3.0"]["score"]


def test_logit_table(spark):
    data = [(1.0, 1.0)] * 30 + [(1.0, 0.0)] * 10 + [(0.0, 1.0)] * 15 + [(0.0, 0.0)] * 45
    frame = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(data, "x double, y double"))
    rows = {r["feature"]: r for r in models.logit_table(frame, "y", ["x"]).collect()}
    assert rows["x"]["coefficient"] == pytest.approx(2.1972, abs=1e-3)  # ln 9
    assert rows["x"]["std_error"] == pytest.approx((1 / 30 + 1 / 10 + 1 / 15 + 1 / 45) ** 0.5, abs=1e-4)


def test_wide_categories_are_hashed(planted):
    pipe = models.fit_features(planted, ["a"], ["c"], max_categories=2)
    rows = models.apply_features(pipe, planted, ["c"]).select("c", "features").collect()
    assert all(len(r["features"]) == 4097 for r in rows)
    assert len({(r["c"], tuple(r["features"].toArray()[1:].nonzero()[0])) for r in rows}) == 3


def test_lasso_path_agrees_with_the_learner(vectors):
    train = vectors.filter("is_train")
    path = models.lasso_path(train, "y", ["id"])
    assert len(path.penalties) == 100 and path.penalties[0] == pytest.approx(1000 * path.penalties[-1])
    largest = float(path.penalties[0])
    assert not models.lasso("y", largest * 1.001).fit(train).coefficients.toArray().any()
    assert models.lasso("y", largest * 0.98).fit(train).coefficients.toArray().any()
    fit = models.lasso("y", float(path.penalties[path.best])).setTol(1e-12).fit(train)
    assert path.slopes == pytest.approx(fit.coefficients.toArray(), abs=1e-4)
    assert path.intercept == pytest.approx(fit.intercept, abs=1e-4)
    grid = models.lasso_cv(train, "y", ["id"], [float(p) for p in path.penalties[[10, 50, 90]]])
    assert path.errors[[10, 50, 90]] == pytest.approx(grid.scores, rel=1e-3)


def test_plain_penalty_is_on_the_features_as_they_are(spark):
    rng = random.Random(1)
    data = [(x, 3 * x + rng.gauss(0, 0.01)) for x in (rng.gauss(0, 10) for _ in range(400))]
    frame = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(data, "x double, y double"))
    cov, var = frame.agg(F.covar_pop("x", "y"), F.var_pop("x")).first()
    assert models.lasso("y", 5.0, standardize=False).fit(frame).coefficients[0] == pytest.approx((cov - 5.0) / var, rel=1e-4)


def test_roc_table(vectors):
    labelled = vectors.withColumn("up", (C("y") > 0).cast("double"))
    rows = models.roc_table(labelled, "up", ["id"], folds=4).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3] and sum(r["n"] for r in rows) == 600
    assert all(r["roc"] > 0.95 and r["sensitivity"] > 0.8 and r["specificity"] > 0.8 for r in rows)


def test_folds_are_fitted_together_and_the_library_fits_once(vectors, monkeypatch):
    labelled = vectors.withColumn("up", (C("y") + C("a") * C("a") >= 1).cast("double")).select("id", "up", "features")
    real, fits = models.LogisticRegression.fit, []

    def counted(self, *args):
        fits.append(1)
        return real(self, *args)

    monkeypatch.setattr(models.LogisticRegression, "fit", counted)
    search = models.logistic_cv(labelled, "up", ["id"], folds=4)
    assert len(fits) == 1 and 0.8 < search.scores[0] < 1
    scored = {r["fold"]: r["m"] for r in models.fold_scores(labelled, "up", ["id"], 4).groupBy("fold").agg(F.sort_array(F.collect_list("margin")).alias("m")).collect()}
    folded = models.with_fold(labelled, ["id"], 4)
    for fold in range(4):
        tight = models.logistic("up").setTol(1e-14).setMaxIter(500).fit(folded.filter(C("fold") != fold))
        own = tight.transform(folded.filter(C("fold") == fold)).select(models.vector_to_array("rawPrediction")[1]).collect()
        assert scored[fold] == pytest.approx(sorted(r[0] for r in own), rel=1e-3, abs=1e-3)
    monkeypatch.setattr(fold_logits, "WIDEST", 1)
    fits.clear()
    wide = models.logistic_cv(labelled, "up", ["id"], folds=4)
    assert len(fits) == 5 and wide.scores[0] == pytest.approx(search.scores[0], abs=0.01)


def test_roc_folds_share_their_passes_and_stop_where_the_library_does(vectors, monkeypatch):
    labelled = vectors.withColumn("up", (C("y") + C("a") * C("a") >= 1).cast("double")).select("id", "up", "features")
    folded = models.with_fold(labelled, ["id"], 4)
    rows = materialise(folded.select("fold", C("up").alias("label"), models.vector_to_array("features").alias("x")))
    fits = fold_logits.library_coefficients(rows, 4, models.vector_size(labelled))
    for fold in range(4):
        own = models.logistic("up").fit(folded.filter(C("fold") != fold))
        assert fits[fold] == pytest.approx([own.intercept, *own.coefficients], rel=1e-6, abs=1e-7)
    monkeypatch.setattr(models, "logistic", None)  # no fit of the library's, which would hold its rows
    monkeypatch.setattr(models, "kept", None)
    table = models.roc_table(labelled, "up", ["id"], folds=4).collect()
    assert sum(r["n"] for r in table) == labelled.count() and all(0.5 < r["roc"] <= 1 for r in table)


def test_a_fold_with_one_class_left_is_certain(spark):
    rows = [(f, float(f == 0 and i % 2), [float(i), float(i % 3)]) for f in range(3) for i in range(20)]
    table = materialise(spark.createDataFrame(rows, "fold int, label double, x array<double>"))
    fits = fold_logits.fold_coefficients(table, 3, 2)
    assert fits[0][0] == -np.inf and not fits[0][1:].any() and np.isfinite(fits[1]).all()
    assert {r["margin"] for r in fold_logits.fold_margins(table, fits).filter("fold = 0").collect()} == {-np.inf}


def test_learner_defaults():
    forest, boosted = models.forest("y"), models.boosted("y")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getFeatureSubsetStrategy()) == (100, 30, "all")
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (100, 6, 0.3)


def test_complexity_is_relative_to_the_variance(planted):
    variance = planted.agg(F.var_pop("y")).first()[0]
    assert models.complexity_gain(planted, "y", 0.01) == pytest.approx(0.01 * variance)


def test_stream_equals_batch_for_closed_days(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    data = [
        (i, start + timedelta(minutes=30 * i), rng.choice("AB"), rng.choice(["Positive.", "NEGATIVE", "mixed", None]))
        for i in range(400)
    ]
    feed = spark.createDataFrame(data + data[:50], "id int, ts timestamp, TICKER string, label string")  # some ids twice
    folder = scratch_path(spark, "feed")
    feed.repartition(3).write.parquet(folder)
    places = scratch_path(spark, "counts"), scratch_path(spark, "state")

    def run():
        return news_counts.land_and_count(
            spark, folder, feed.schema, "*.parquet", lambda f: f, "ts", "TICKER", "id", "label", *places
        )

    got = run()
    batch = aggregates.news_counts(
        feed.dropDuplicates(["id"]).withColumn("enterdate", F.to_date("ts")).withColumns(label_counts(normalise_label(C("label"))))
    )
    closed = max(d[1] for d in data) - timedelta(days=1)
    batch = batch.filter(F.date_add("enterdate", 1).cast("timestamp") <= F.lit(closed))
    order = ["enterdate", "TICKER", "positive", "negative", "total"]
    streamed, counted = (sorted(tuple(r) for r in x.select(order).collect()) for x in (got, batch))
    assert streamed and streamed == counted
    again = sorted(tuple(r) for r in run().select(order).collect())
    assert again == streamed  # a second run adds nothing


def test_rows_to_fit_are_spread_where_they_are_many(vectors, monkeypatch):
    stored = materialise(vectors.coalesce(1))
    assert models.spread(stored).rdd.getNumPartitions() == stored.rdd.getNumPartitions()
    rows, width = stored.count(), models.vector_size(stored)
    monkeypatch.setattr(models, "FIT_VALUES", rows * width // 7)
    dealt = models.spread(stored)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 7 and max(r["count"] for r in sizes) <= rows // 7 + 7
    assert dealt.exceptAll(stored).count() == 0 and dealt.count() == rows


def test_stratified_rows_are_not_shuffled(spark):
    """Sizes are exact and rows stay in place; rows without a stratum leave, and equal rows at the border are told apart."""
    rows = [(i if i % 50 else None, None if i % 11 == 0 else f"s{i % 3}", "wide") for i in range(400)]
    frame = materialise(spark.createDataFrame(rows, "id long, c string, vector string"))
    split = models.with_stratified_flag(frame, "c", ["id"], 0.7)
    assert set(frame.inputFiles()) <= set(split.inputFiles())  # not a sorted copy of them
    assert split.columns == ["id", "c", "vector", "is_train"]

    def sizes(table):
        found = table.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("k")).collect()
        assert found and all(r["c"] is not None and r["k"] == -(-r["n"] * 7 // 10) for r in found)
        return sum(r["n"] for r in found)

    assert sizes(split) == frame.filter("c IS NOT NULL").count()
    hashed = split.withColumn("h", models.hash_fraction(["id"], 17)).collect()
    for c in ("s0", "s1", "s2"):
        mine = sorted(((r["h"], r["id"] is not None, r["id"] or 0, not r["is_train"]) for r in hashed if r["c"] == c))
        assert [r[3] for r in mine] == sorted(r[3] for r in mine)
    assert sizes(models.with_stratified_flag(materialise(frame.withColumn("id", F.lit(5))), "c", ["id"], 0.7)) == frame.filter("c IS NOT NULL").count()
    assert models.with_stratified_flag(frame, "c", ["id"], 1.0).filter("NOT is_train").isEmpty()
