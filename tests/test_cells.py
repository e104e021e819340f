"""Forests and boosted trees on cells against the library's learners on the rows."""

import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import cells, models
from tidemark.plans import study

C = F.col


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b), float(c), float(2 * a + b * c + d)) for i, (a, b, c, d) in enumerate(zip(rng.normal(size=3000), rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.normal(size=3000) / 3))]
    raw = spark.createDataFrame(data, "id long, a double, b double, c double, y double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(raw).withColumn("_draw", F.xxhash64("id")).persist()
    yield vectors
    vectors.unpersist()


def _celled(rows):
    places = cells.feature_places(rows, "_draw")
    return places, rows.withColumns({"cell": cells.cell_of(places), "asked": C("id") % 3 == 0, "_learnt": F.when(C("id") % 3 > 0, C("y"))})


def test_places_are_the_librarys(rows):
    places = cells.feature_places(rows, "_draw")
    assert [len(p) for p in places] == [31, 4, 2]
    text = models.tree("y", depth=30).fit(rows).toDebugString
    used = {(int(f), float(v)) for f, v in re.findall(r"feature (\d+) <= (\S+)\)", text)}
    assert used and all(any(abs(v - p) < 1e-12 for p in places[f]) for f, v in used)


def test_boosting_cells_is_boosting_rows(rows):
    learner = models.boosted("y", maxIter=8, maxDepth=4)
    places = cells.feature_places(rows, "_draw")
    celled = rows.withColumns({"cell": cells.cell_of(places), "asked": F.lit(True)})
    got = celled.join(cells.boosted_cells(celled, "y", learner), "cell").select("id", C("pred_boosted").alias("p"))
    both = got.join(learner.fit(rows).transform(rows), "id")
    assert both.count() == 3000 and both.agg(F.max(F.abs(C("p") - C("pred_boosted")))).first()[0] < 1e-9


def test_forest_of_cells_predicts_as_the_library_does(rows):
    _, celled = _celled(rows)
    found = celled.filter("asked").join(cells.forest_cells(celled, "_learnt", "_draw", 40, 30, 1), "cell")
    fit = models.forest("y", numTrees=40).fit(rows.filter("id % 3 > 0"))
    both = fit.transform(rows).withColumnRenamed("pred_forest", "p").join(found.select("id", "pred_forest"), "id")
    near, own, theirs, spread = both.agg(F.avg((C("p") - C("pred_forest")) ** 2), F.avg((C("y") - C("pred_forest")) ** 2), F.avg((C("y") - C("p")) ** 2), F.var_pop("y")).first()
    assert both.count() == 1000 and near < 0.01 * spread and own == pytest.approx(theirs, rel=0.1)


def test_annual_predictions_store_no_deep_trees(spark, rows, monkeypatch):
    """Every model on every row asked about, once, whatever the rows; equal rows are drawn for themselves."""
    monkeypatch.setattr(models, "forest", lambda *a, **k: pytest.fail("grown on the rows"))
    data = rows.select((C("id") % 40).cast("string").alias("TICKER"), (2000 + C("id") % 5).cast("int").alias("YEAR"), "a", "b", C("y").alias("P"))
    errors, predicted = study.annual_predictions(data, ["a", "b"], "P", 2003)
    assert {r["MODEL"]: r["n"] for r in errors.collect()} == {"LR": 600, "RF": 600, "XGB": 600}
    assert {r["MODEL"]: r["count"] for r in predicted.groupBy("MODEL").count().collect()} == {"LR": 1200, "RF": 1200, "XGB": 1200}
    assert all(r["r2"] > 0.2 for r in errors.collect() if r["MODEL"] != "LR")
