"""Moments, the lasso path, deep forests, compiled models and p-values, each against a plain version or another engine."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.functions import distributions
from tidemark.operators import compiled, forests, lasso, models, moments

C = F.col


# ---- moments ------------------------------------------------------------------------------

@pytest.mark.parametrize("width, filled", [(3, 3), (300, 300), (300, 4)])
def test_moments_are_the_products(spark, width, filled, monkeypatch):
    monkeypatch.setattr(moments, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(width + filled)
    rows, plain = [], [np.zeros((width + 2, width + 2)) for _ in range(3)]
    for i in range(90):
        x = np.zeros(width)
        x[rng.choice(width, filled, replace=False)] = rng.normal(size=filled)
        y, group = float(rng.normal()), int(rng.integers(0, 2))  # no row in the last group
        z = np.r_[1.0, x, y]
        plain[group] += np.outer(z, z)
        rows.append((group, Vectors.dense(x) if i % 2 else Vectors.sparse(width, {int(j): float(x[j]) for j in x.nonzero()[0]}), y))
    rows += [(0, None, 1.0), (1, Vectors.dense(np.ones(width)), None), (None, Vectors.dense(np.ones(width)), 1.0)]
    df = spark.createDataFrame(rows, ["g", "features", "y"])
    got = moments.trimmed(moments.product_matrices(df.repartition(5), C("g"), 3, "features", "y"), width + 2)
    for a, b in zip(got[:2], plain):
        assert a == pytest.approx(b, abs=1e-9)
    assert not got[2].any()


# ---- the lasso path -----------------------------------------------------------------------

def design(case, n=400):
    rng = np.random.default_rng(case)
    x = rng.normal(size=(n, 8)) @ rng.normal(size=(8, 8))
    if case % 2:  # every level of a category, a total of two counts, a constant and a copy
        levels, pos, neg = np.eye(4)[rng.integers(0, 4, n)], rng.poisson(1, n), rng.poisson(1, n)
        x = np.column_stack([x, levels, pos, neg, pos + neg, np.ones(n), x[:, 0]])
    y = x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=n)
    return x, np.round(y) if case > 3 else y


@pytest.mark.parametrize("case", range(6))
def test_path_meets_the_conditions_and_equals_descent(case):
    x, y = design(case)
    covariance = np.cov(np.column_stack([x, y]).T, bias=True)
    gram, target, scale = models._scaled(covariance, True)
    penalties = models.penalty_path(covariance)
    path = lasso.homotopy(gram, target, penalties)
    standard = (x - x.mean(0)) / np.where(np.isinf(scale), 1, scale)
    beta = np.zeros(len(target))
    for penalty, slopes in zip(penalties, path):
        assert lasso.breach(gram, target, penalty, slopes) <= 1e-9 * penalties[0]
        beta = lasso.descend(gram, target, penalty, beta, close=1e-15)
        assert standard @ slopes == pytest.approx(standard @ beta, abs=1e-8)
    assert not path[0].any() and not path[:, np.isinf(scale)].any()


def test_path_of_degenerate_targets():
    gram = np.eye(3)
    assert not lasso.homotopy(gram, np.zeros(3), [0.5, 0.1]).any()
    # equal correlations enter together
    assert lasso.homotopy(gram, np.array([1.0, -1.0, 1.0]), [0.25])[0] == pytest.approx([0.75, -0.75, 0.75])
    assert lasso.homotopy(gram, np.array([1.0, 0.5, 0.0]), [2.0, 0.75, 0.0]) == pytest.approx(np.array([[0, 0, 0], [0.25, 0, 0], [1, 0.5, 0]]))


def test_a_hundred_penalties_in_five_folds_are_quick():
    import time

    x, y = design(1, 3000)
    x = np.column_stack([x, np.random.default_rng(3).normal(size=(3000, 18))])
    covariance = np.cov(np.column_stack([x, y]).T, bias=True)
    start = time.perf_counter()
    for _ in range(6):
        models.lasso_coefficients(covariance, models.penalty_path(covariance))
    assert len(covariance) > 34 and time.perf_counter() - start < 2


def test_wide_hashed_features_are_fitted(spark):
    rng = random.Random(4)
    data = [(i, rng.gauss(0, 1), f"v{rng.randrange(40)}") for i in range(500)]
    df = spark.createDataFrame(data, "id int, a double, c string").withColumn("y", 2 * C("a") + (C("c") == "v3").cast("double"))
    vectors = models.apply_features(models.fit_features(df, ["a"], ["c"], max_categories=5), df, ["c"])
    path = models.lasso_path(vectors, "y", ["id"], folds=2, penalties=[0.01])
    assert len(path.slopes) == 4097 and path.slopes[0] == pytest.approx(2 * 1.0, rel=0.1) and (path.slopes[1:] != 0).sum() < 40


# ---- deep forests -------------------------------------------------------------------------

def plain_tree(x, y, w, min_leaf, min_split, depth, root=None, level=0):
    kept = w > 0
    x, y, w = x[kept], y[kept], w[kept]
    mean = (w @ y) / w.sum()
    root = mean if root is None else root
    leaf = ("leaf", mean)
    if len(y) < max(min_split, 2 * min_leaf) or y.max() == y.min() or level >= depth:
        return leaf
    c, found = y - root, []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) >= min_leaf:
                gain = sum((w[s] @ c[s]) ** 2 / w[s].sum() for s in (left, ~left))
                found.append((gain, f, a, b))
    if not found:
        return leaf
    top, tie = max(g[0] for g in found), 1e-10 * (w @ c**2)
    _, f, a, b = next(g for g in found if g[0] >= top - tie)
    left = x[:, f] <= a
    middle = (a + b) / 2 if (a + b) / 2 < b else a
    sides = [plain_tree(x[s], y[s], w[s], min_leaf, min_split, depth, root, level + 1) for s in (left, ~left)]
    return ("split", f, middle, *sides)


def plain_value(tree, row):
    while tree[0] == "split":
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[1]


STOPS = ((10_000, 2), (3, 2), (10_000, 5), (2, 7))


@pytest.mark.parametrize("case", range(8))
def test_tree_equals_the_plain_one(case):
    rng = np.random.default_rng(case)
    n = int(rng.integers(1, 90))
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 2, n) * 2.5, np.ones(n)])
    y = rng.normal(size=n) if case % 2 else rng.integers(0, 3, n).astype(float)
    w = forests.bag_weights(rng.integers(0, 2**62, n), case, 1) if case % 3 else np.ones(n)
    w = w if w.any() else np.ones(n)
    asked = np.vstack([x, x + rng.normal(size=x.shape) * 0.3])
    for min_leaf in (1, 2, 3):
        got = forests.walk(forests.grow(x, y, w, min_leaf), asked, STOPS)
        for values, (depth, fewest) in zip(got, STOPS):
            tree = plain_tree(x, y, w, min_leaf, fewest, depth)
            assert values == pytest.approx([plain_value(tree, r) for r in asked])


def test_bags_are_poisson():
    w = forests.bag_weights(np.random.default_rng(0).integers(-(2**62), 2**62, 200_000), 3, 12)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    data = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(5)), float(rng.randrange(2))
        data.append((i, a, b, c, float(np.sin(3 * a)) + b * c + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    return models.with_fold(vectors, ["id"], 3).cache()


def r2(rows, column):
    y, p = np.array([r["y"] for r in rows]), np.array([r[column] for r in rows])
    return 1 - ((y - p) ** 2).mean() / y.var()


def test_forest_of_one_task_and_of_top_levels(planted):
    train, test = planted.filter("fold < 2").drop("fold"), planted.filter("fold = 2").drop("fold")
    for node_rows in (None, 60):
        forest = forests.grow_forest(train, "y", ["id"], trees=12, node_rows=node_rows)
        assert (forest.top is None) == (node_rows is None)
        scored = forests.forest_scores(forest, test, ["id"]).join(test.select("id", "y"), "id").collect()
        assert len(scored) == test.count() and r2(scored, "s0") > 0.95
        again = forests.forest_scores(forests.grow_forest(train.repartition(3), "y", ["id"], trees=12, node_rows=node_rows), test, ["id"]).collect()
        if node_rows is None:
            assert {r["id"]: r["s0"] for r in again} == pytest.approx({r["id"]: r["s0"] for r in scored})


def test_one_tree_without_limits_remembers_its_rows(planted):
    for node_rows in (None, 60):
        forest = forests.grow_forest(planted, "y", ["id"], trees=1, node_rows=node_rows)
        rows = forests.forest_scores(forest, planted, ["id"]).join(planted.select("id", "y"), "id").collect()
        assert [r["s0"] for r in rows] == pytest.approx([r["y"] for r in rows])


def test_nodes_that_are_put_off_grow_the_same_trees(monkeypatch):
    """Few rows at a time or all at once, as a matrix or as columns of bytes and numbers."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 9, 900), rng.integers(0, 2, 900), np.ones(900)])
    y, w = rng.normal(size=900), forests.bag_weights(rng.integers(0, 2**62, 900), 1, 1)
    asked = rng.normal(size=(500, 4)) * 2
    want = [forests.walk(forests.grow(x, y, w, *limits), asked, STOPS) for limits in ((1, 2, 10_000), (3, 5, 6))]
    monkeypatch.setattr(forests, "CHUNK_ROWS", 40)
    for columns in (x, [x[:, 0], *(x[:, c].astype(np.uint8) for c in (1, 2, 3))]):
        got = [forests.walk(forests.grow(columns, y, w, *limits), asked, STOPS) for limits in ((1, 2, 10_000), (3, 5, 6))]
        assert np.array(got) == pytest.approx(np.array(want))


def test_scoring_stores_no_trees_where_the_rows_fit(planted, monkeypatch):
    """Trees on many rows take more room than the rows; stored trees give the same scores, and more rows than fit meet those."""
    train, test = planted.filter("fold < 2").drop("fold"), planted.filter("fold = 2").drop("fold")
    forest = forests.grow_forest(train, "y", ["id"], trees=12)
    want = {r["id"]: r["s0"] for r in forests.forest_scores(forest, test, ["id"]).collect()}
    assert len(want) == test.count() and not forest._grown
    assert forest.nodes.count() == 12
    assert {r["id"]: r["s0"] for r in forests.forest_scores(forest, test, ["id"]).collect()} == pytest.approx(want)
    monkeypatch.setattr(forests, "SCORED_ROWS", 50)
    small = forests.grow_forest(train, "y", ["id"], trees=12, node_rows=700)
    assert forests.forest_scores(small, planted, ["id"]).count() == 900 and small._grown


def test_trees_do_not_depend_on_how_many_rows_fit_a_task(planted, monkeypatch):
    """The same predictions with and without top levels, for folds held out and stricter trees too."""
    monkeypatch.setattr(forests, "BLOCK_ROWS", 100)
    monkeypatch.setattr(forests, "PIECE_ROWS", 90)
    runs, own = [forests.Run(fold, leaf) for leaf in (1, 4) for fold in range(3)], F.array(C("fold"), C("fold") + 3)
    found = []
    for node_rows in (None, 250, 40):
        forest = forests.grow_forest(planted, "y", ["id"], 5, runs, node_rows=node_rows)
        assert (forest.top is None) == (node_rows is None)
        rows = forests.forest_scores(forest, planted, ["id"], [(10_000, 2), (3, 2), (10_000, 30)], (2, 5), own).collect()
        found.append(np.array(sorted(tuple(r) for r in rows)))
    assert found[0].shape == (1800, 8) and found[0] == pytest.approx(found[1], rel=1e-9) and found[0] == pytest.approx(found[2], rel=1e-9)


def test_lots_read_the_stored_rows_without_a_shuffle(planted, monkeypatch):
    """Rows are written once for all trees; a lot's task reads them itself, so disk does not grow with the trees."""
    plans, real = [], forests.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(forests, "materialise", seen)
    train, test = planted.filter("fold < 2").drop("fold"), planted.filter("fold = 2").drop("fold")
    scores = forests.forest_scores(forests.grow_forest(train, "y", ["id"], trees=30), test, ["id"])
    grown = [p for p in plans if "Union" in p and "MapInArrow" in p and "Cogroup" not in p]
    assert scores.count() == test.count() and len(grown) == 1
    assert "Exchange" not in grown[0] and grown[0].count("Coalesce 1") == 10


def test_flags_that_part_the_rows_alike_are_counted_once(monkeypatch):
    """A flag and its opposite, as one-hot pairs have it, would only tie; counts are of the rarer side."""
    rng = np.random.default_rng(8)
    flag, rare = rng.integers(0, 2, 400).astype(float), (rng.random(400) < 0.9).astype(float)
    x = np.column_stack([rng.normal(size=400), flag, 1 - flag, flag * 3, rare, 1 - rare])
    y, counted, real = rng.normal(size=400) + flag + 2 * rare, [], np.bincount

    def bincount(cells, *args, **more):
        counted.append(len(cells))
        return real(cells, *args, **more)

    monkeypatch.setattr(np, "bincount", bincount)
    got = forests.walk(forests.grow(x, y, np.ones(400), depth=1), x, STOPS)
    assert max(counted) == min(flag.sum(), 400 - flag.sum()) + (1 - rare).sum()
    monkeypatch.undo()
    for values, (depth, fewest) in zip(got, STOPS):
        tree = plain_tree(x, y, np.ones(400), 1, fewest, min(depth, 1))
        assert values == pytest.approx([plain_value(tree, r) for r in x])


def test_many_trees_of_mostly_flags_need_no_top_levels(spark):
    """A copy of the rows per tree is dealt where there are top levels, one per lot where there are none."""
    rows = spark.range(30).selectExpr("id", "cast(id as double) a", "cast(id % 2 as double) b", "cast(id as double) y")
    vectors = models.apply_features(models.fit_features(rows, ["a"], ["b"]), rows, ["b"])
    assert forests._row_values(vectors, 3) == 1 + 2 / 8
    assert forests._row_values(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows), 2) == 2


def test_search_reads_all_settings_off_the_freest_trees(planted):
    grid = {"trees": (2, 3), "depth": (None, 2), "min_split": (2, 40), "min_leaf": (1, 5)}
    search = forests.search_forest(planted, "y", ["id"], 3, grid)
    table = search.table.collect()
    assert len(table) == 16 and sum(r["best"] for r in table) == 1
    data = planted.orderBy("id").select("id", "features", "y", "fold", F.xxhash64("id").alias("h")).collect()
    x, y = np.array([r["features"].toArray() for r in data]), np.array([r["y"] for r in data])
    fold, h = np.array([r["fold"] for r in data]), np.array([r["h"] for r in data])
    order = np.argsort(h, kind="stable")
    x, y, fold, h = x[order], y[order], fold[order], h[order]
    for row in table:
        scores = []
        for held in range(3):
            mine = fold != held
            trees = [forests.grow(x[mine], y[mine], forests.bag_weights(h[mine], t, 12), row["min_leaf"], row["min_split"], row["depth"] or 10_000) for t in range(row["trees"])]
            found = np.mean([forests.walk(t, x[~mine], [(10_000, 2)])[0] for t in trees], axis=0)
            scores.append(1 - ((y[~mine] - found) ** 2).mean() / y[~mine].var())
        assert row["score"] == pytest.approx(np.mean(scores))
    predicted = search.predict(planted, ["id"]).join(planted.select("id", "y"), "id").collect()
    assert len(predicted) == 900 and r2(predicted, "pred_forest") > 0.8


# ---- compiled models ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        kind, flag = rng.choice(["it's", "b\\s", "c", None]), rng.random() < 0.5
        a, b = rng.gauss(3, 2), float(rng.randrange(4))
        data.append((i, a, b, kind, flag, a * 0.5 + (kind == "c") + b * flag + rng.gauss(0, 0.2)))
    return spark.createDataFrame(data, "id int, `a b` double, b double, kind string, flag boolean, y double").withColumn("up", (C("y") > 2.5).cast("double"))


def test_models_score_the_same_as_text_in_both_engines(mixed, tmp_path):
    pipe = models.fit_features(mixed, ["a b", "b"], ["kind", "flag"])
    vectors = models.apply_features(pipe, mixed, ["kind", "flag"]).cache()
    learners = {
        "linear": (models.lasso("y", 0.01), "lasso_pred"),
        "tree": (models.tree("y", depth=6), "pred_forest"),
        "forest": (RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=4, seed=1, predictionCol="p"), "p"),
        "boosted": (GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1, predictionCol="p"), "p"),
        "logistic": (models.logistic("up"), None),
    }
    base = duckdb.connect()
    mixed.toPandas().to_parquet(tmp_path / "rows.parquet")
    for name, (learner, column) in learners.items():
        fit = learner.fit(vectors)
        scored = fit.transform(vectors)
        scored = models.with_probability(scored) if column is None else scored
        want = {r["id"]: r["p"] for r in scored.select("id", C(column or "p_positive").alias("p")).collect()}
        here = {r["id"]: r["p"] for r in mixed.select("id", compiled.model_column(fit, pipe).alias("p")).collect()}
        text = compiled.model_text(fit, compiled.feature_texts(pipe, compiled.DUCKDB))
        there = dict(base.execute(f"SELECT id, {text} FROM '{tmp_path}/rows.parquet'").fetchall())
        assert here == pytest.approx(want, rel=1e-12), name
        assert there == pytest.approx(want, rel=1e-12), name


def test_vectors_are_those_of_the_stages(mixed):
    """One pass for the categories and plain expressions give what the learners' own stages give, names included."""
    pipe = models.fit_features(mixed, ["a b", "b"], ["kind", "flag"])
    texts = mixed.withColumns({c: C(c).cast("string") for c in ("kind", "flag")})
    plain = Pipeline(stages=models.feature_stages(["a b", "b"], ["kind", "flag"])).fit(texts).transform(texts)
    got = models.apply_features(pipe, mixed, ["kind", "flag"])
    assert got.columns == [*mixed.columns, "features"] and models.feature_names(got) == models.feature_names(plain)
    assert got.schema["features"].metadata == plain.schema["features"].metadata
    want = {r["id"]: r["features"] for r in plain.select("id", "features").collect()}
    assert {r["id"]: r["features"] for r in got.select("id", "features").collect()} == want
    # no function per category column is left in the plan
    assert got._jdf.queryExecution().optimizedPlan().toString().count("UDF(") <= 2


def test_unseen_and_missing_categories_score_as_none_of_the_known(spark, mixed):
    pipe = models.fit_features(mixed, ["a b"], ["kind"])
    fit = models.lasso("y", 0.001).fit(models.apply_features(pipe, mixed, ["kind"]))
    odd = spark.createDataFrame([(1.0, "new"), (2.0, None), (0.0, "c")], "`a b` double, kind string")
    want = [r[0] for r in fit.transform(models.apply_features(pipe, odd, ["kind"])).select("lasso_pred").collect()]
    assert [r[0] for r in odd.select(compiled.model_column(fit, pipe)).collect()] == pytest.approx(want)


def test_deep_trees_become_text():
    x = np.random.default_rng(1).normal(size=(200, 2))
    y = np.random.default_rng(2).normal(size=200)
    text = compiled.tree_text(forests.grow(x, y, np.ones(200)), ["x0", "x1"])
    base = duckdb.connect()
    base.execute("CREATE TABLE t (x0 DOUBLE, x1 DOUBLE)")
    base.executemany("INSERT INTO t VALUES (?, ?)", x.tolist())
    assert [r[0] for r in base.execute(f"SELECT {text} FROM t").fetchall()] == pytest.approx(y)


# ---- p-values -----------------------------------------------------------------------------

def test_p_values_equal_the_loops(spark):
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 6.0, 40.0) for df in (0.7, 1.0, 2.0, 7.3, 30.0, 500.0, 12_345.6)]
    rows = spark.createDataFrame([(t, df) for t, df in cases] + [(-2.0, 9.0), (None, 1.0), (1.0, None), (float("nan"), 2.0)], "t double, df double")
    out = rows.select(distributions.t_p_value("t", "df").alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = [r["p"] for r in out.collect()]
    assert got[: len(cases)] == pytest.approx([distributions.student_two_sided(t, df) for t, df in cases], rel=1e-9, abs=1e-300)
    near_zero = spark.createDataFrame([(1e-6, 12_345.6)], "t double, df double").select(distributions.t_p_value("t", "df")).first()[0]
    assert 1 - near_zero == pytest.approx(2e-6 / np.sqrt(2 * np.pi), rel=1e-4)
    assert got[-4] == pytest.approx(distributions.student_two_sided(-2.0, 9.0)) and got[-3:] == [None] * 3


def test_p_values_of_many_degrees_of_freedom_go_over_to_the_normal(spark):
    rows = spark.createDataFrame([(t, df) for t in (0.0, 0.5, 2.0, 8.0) for df in (distributions.LARGE + 1, 1e6, 1e12)], "t double, df double")
    for r in rows.select("t", "df", distributions.t_p_value("t", "df").alias("p")).collect():
        near = distributions.student_two_sided(r["t"], distributions.LARGE - 1)
        assert r["p"] == pytest.approx(near, rel=2e-2)
        if r["df"] == 1e12:
            assert r["p"] == pytest.approx(distributions.normal_two_sided(r["t"]), rel=1e-9)
    edge = spark.createDataFrame([(t, d) for t in (0.1, 1.0, 3.0, 6.0) for d in (distributions.LARGE, distributions.LARGE * (1 + 1e-12))], "t double, df double")
    ps = [r[0] for r in edge.select(distributions.t_p_value("t", "df")).collect()]
    assert ps[::2] == pytest.approx(ps[1::2], rel=1e-9)


def test_normal_p_values(spark):
    zs = [0.0, 1e-9, 0.4, 1.0, 3.5, 3.54, 6.0, 20.0, 37.0, -2.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select(distributions.z_p_value("z")).collect()]
    assert got[:-1] == pytest.approx([distributions.normal_two_sided(z) for z in zs], rel=1e-12) and got[-1] is None
