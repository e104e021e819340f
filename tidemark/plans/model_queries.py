"""I: fitting, scoring and judging return models.

Fits on the full feature set have no SQL form and are checked by their row counts and by tests.
Saturated fits (one binary feature) have a closed form, which the SQL states.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.config import BY_NAME, DAILY, TREE
from tidemark.operators import compiled, forests, models, windows
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.summary_queries import edges_sql
from tidemark.plans.window_queries import predictions, PREDICTIONS_SQL
from tidemark.session import discard, materialise

C = F.col
KEYS = ["TICKER", "date"]
NUMBERS = ["VOL", "RET", "positive", "negative", "total", "sprtrn", "yesterday_return", "yesterday_volume", "Ask_minus_Bid"]
CATEGORIES = study.model_categories("daily")
FLAGS = study.average_flags("daily")
TARGET, MONTHLY_TARGET = DAILY.target, BY_NAME["monthly"].target


def model_frame(t):
    return study.model_frame(t.features(), "daily")


def prepared(t, fraction: float = 0.8):
    return materialise(study.feature_vectors(model_frame(t), "daily", fraction))


def _complete_sql() -> str:
    """Rows with every standardised number present, with the quantile bin of the size."""
    spreads = ", ".join(f'stddev_samp("{c}") OVER w AS s{i}' for i, c in enumerate(NUMBERS))
    kept = " AND ".join([f'"{c}" IS NOT NULL AND s{i} > 0' for i, c in enumerate(NUMBERS)] + [f'"{c}" IS NOT NULL' for c in FLAGS])
    flags = ", ".join(f'CASE WHEN "{c}" > PRC THEN 1 WHEN "{c}" <= PRC THEN 0 END AS {name}' for name, c in FLAGS.items())
    source = f"(SELECT *, {flags}, {spreads} FROM features WINDOW w AS (PARTITION BY TICKER))"
    return f"SELECT * FROM ({edges_sql('market_cap', 10, source)}) WHERE tomorrow_return IS NOT NULL AND {kept}"


@query(
    "i01_feature_assembly",
    "features:i rows:i",
    f"""SELECT {len(NUMBERS)} + count(DISTINCT bin) + {" + ".join(f"count(DISTINCT {c})" for c in CATEGORIES[1:])} AS features,
               count(*) AS rows
        FROM ({_complete_sql()})""",
    ["features"],
)
def _(t):
    vectors = prepared(t)
    sizes = models.vector_to_array("features")
    return vectors.groupBy(F.size(sizes).alias("features")).agg(F.count(F.lit(1)).alias("rows"))


HASH_SQL = "CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "i02_seeded_split",
    "TICKER:s date:d is_train:b",
    f"""SELECT TICKER, date, {HASH_SQL.format(text="'42|' || TICKER || '|' || CAST(date AS VARCHAR)")} < 0.8 AS is_train
        FROM panel""",
    ["panel"],
)
def _(t):
    return models.with_train_flag(t.prices, KEYS, 0.8)


@query(
    "i03_stratified_split",
    "doc_id:i quality:i is_train:b",
    f"""SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id)
              <= ceil(count(*) OVER (PARTITION BY quality) * 0.7) AS is_train
        FROM (SELECT *, {HASH_SQL.format(text="'17|' || doc_id")} AS h FROM labels)""",
)
def _(t):
    return models.with_stratified_flag(t["labels"], "quality", ["doc_id"], 0.7)


@query(
    "i03_stratified_by_target",
    "stratum:i train:i test:i",
    """SELECT stratum, ceil(count(*) * 0.7) AS train, count(*) - ceil(count(*) * 0.7) AS test FROM (
         SELECT CAST(x > e1 AND e1 > e0 AS INT) + CAST(x > e2 AND e2 > e1 AS INT) + CAST(x > e3 AND e3 > e2 AS INT)
                + CAST(x > e4 AND e4 > e3 AS INT) AS stratum
         FROM (SELECT tomorrow_return AS x FROM features WHERE tomorrow_return IS NOT NULL) CROSS JOIN (
           SELECT min(tomorrow_return) AS e0, quantile_cont(tomorrow_return, 0.2) AS e1, quantile_cont(tomorrow_return, 0.4) AS e2,
                  quantile_cont(tomorrow_return, 0.6) AS e3, quantile_cont(tomorrow_return, 0.8) AS e4 FROM features))
       GROUP BY 1""",
    ["features"],
)
def _(t):
    rows = materialise(windows.with_lags(t.prices, DAILY).select(*KEYS, TARGET).dropna())
    split = models.with_stratified_flag(models.target_strata(rows, TARGET), "stratum", KEYS, 0.7)
    return split.groupBy("stratum").agg(
        F.count(F.when(C("is_train"), 1)).alias("train"), F.count(F.when(~C("is_train"), 1)).alias("test")
    )


@query(
    "i04_time_split",
    "part:s n:i",
    """SELECT 'train' AS part, count(*) FILTER (YEAR < 2000) AS n FROM pay
       UNION ALL SELECT 'test', count(*) FILTER (YEAR = 2000) FROM pay
       UNION ALL SELECT 'predict', count(*) FILTER (YEAR >= 2000) FROM pay""",
    ["pay"],
)
def _(t):
    from tidemark.operators.annual import split_by_year

    parts = [
        p.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        for name, p in zip(("train", "test", "predict"), split_by_year(t.pay, 2000))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _fitted(t, learner, prediction: str, fraction: float = 0.8):
    data = prepared(t, fraction)
    with models.kept(models.spread(data.filter("is_train"))) as train:
        fit = learner.fit(train)
    return fit, fit.transform(data.filter("NOT is_train")), prediction


GROUP_MEANS = """SELECT DISTINCT dummy_total, avg(tomorrow_return) OVER (PARTITION BY dummy_total) AS prediction
       FROM features WHERE tomorrow_return IS NOT NULL"""


METRICS = "n:i mse:f9 rmse:f9 r2:f"


#: Penalty of the fits that do not search for one.
PENALTY = 0.0005


@query("i05_lasso", METRICS)
def _(t):
    _, scored, name = _fitted(t, models.lasso(TARGET, PENALTY), "lasso_pred")
    return models.metrics(scored, TARGET, name)


@query("i05_lasso_cv", METRICS)
def _(t):
    """Five folds over a path of 100 penalties, the best one fitted on the train rows."""
    data = prepared(t)
    path = models.lasso_path(data.filter("is_train"), TARGET, KEYS)
    fit = models.lasso(TARGET, float(path.penalties[path.best])).fit(data.filter("is_train"))
    return models.metrics(fit.transform(data.filter("NOT is_train")), TARGET, "lasso_pred")


def _entry(i: int):
    return C("x")[i]


@query(
    "i05_lasso_optimality",
    "n:i violations:i",
    f"""SELECT count(*) FILTER (h < 0.8) AS n, 0 AS violations FROM (
         SELECT {HASH_SQL.format(text="'42|' || TICKER || '|' || CAST(date AS VARCHAR)")} AS h FROM ({_complete_sql()}))""",
    ["features"],
)
def _(t):
    """The conditions of a lasso optimum on the train rows, one per feature.

    With r the residual and s the deviation of a feature, |cov(x, r)| / s is the penalty, with the sign of the
    coefficient, where that is not zero, and at most the penalty elsewhere.
    """
    train = prepared(t).filter("is_train")
    fit = models.lasso(TARGET, PENALTY).setTol(1e-12).setMaxIter(1000).fit(train)
    rows = fit.transform(train).select(models.vector_to_array("features").alias("x"), (C(TARGET) - C("lasso_pred")).alias("r"))
    size = len(fit.coefficients)
    parts = [F.struct(F.covar_pop(_entry(i), "r").alias("c"), F.stddev_pop(_entry(i)).alias("s")) for i in range(size)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("pulls")).first()
    wrong = 0
    for b, pull in zip(fit.coefficients, found["pulls"]):
        if pull["s"]:
            c, near = pull["c"] / pull["s"], 1e-3 * PENALTY
            wrong += abs(c - PENALTY * (1 if b > 0 else -1)) > near if b else abs(c) > PENALTY + near
    return t.spark.createDataFrame([(found["n"], int(wrong))], "n long, violations int")


def _one_feature(t):
    """The next return against a single yes/no feature."""
    rows = t.features("daily", "prices").filter(C(TARGET).isNotNull()).select(*KEYS, TARGET, "dummy_total")
    vectors = VectorAssembler(inputCols=["dummy_total"], outputCol="features").transform(rows)
    return vectors.withColumn("up", (C(TARGET) >= 0).cast("double"))


@query(
    "i05_lasso_one_feature",
    "feature:s coefficient:f",
    """SELECT f.u.feature, f.u.v AS coefficient FROM (
         SELECT unnest([{'feature': 'sprtrn', 'v': slope}, {'feature': '(intercept)', 'v': my - slope * mx}]) AS u FROM (
           SELECT sign(r) * greatest(abs(r) - 0.001 / sy, 0) * sy / sx AS slope, mx, my FROM (
             SELECT corr(RET, sprtrn) AS r, stddev_pop(sprtrn) AS sx, stddev_pop(RET) AS sy, avg(sprtrn) AS mx, avg(RET) AS my
             FROM panel))) f""",
    ["panel"],
)
def _(t):
    """With one feature the penalty shrinks the correlation by penalty / deviation of the target."""
    data = VectorAssembler(inputCols=["sprtrn"], outputCol="features").transform(t.panel.select("RET", "sprtrn"))
    return models.coefficient_table(t.spark, models.lasso("RET", 0.001).fit(data), ["sprtrn"])


def _judged(scored, test, target: str = TARGET):
    """Errors of predictions that stand in a table of their own."""
    return models.metrics(scored.join(test.select(*KEYS, target), KEYS), target, "pred_forest")


@query("i06_forest", METRICS)
def _(t):
    """100 trees over all features, each grown until its leaves are pure."""
    data = prepared(t)
    test = data.filter("NOT is_train")
    forest = forests.grow_forest(data.filter("is_train"), TARGET, KEYS)
    return _judged(forests.forest_scores(forest, test, KEYS).withColumnRenamed("s0", "pred_forest"), test)


EXACT = ["VOL", "RET", "total", "positive", "dummy_negative"]


@query(
    "i06_deep_tree_exact",
    "TICKER:s date:d prediction:f9",
    f"""SELECT TICKER, date, avg(tomorrow_return) OVER (PARTITION BY {", ".join(EXACT)}) AS prediction
        FROM features WHERE tomorrow_return IS NOT NULL""",
    ["features"],
)
def _(t):
    """One tree without bagging or limits tells all rows apart that differ in any feature, so it predicts the mean of equal rows."""
    rows = t.features("daily", "prices").filter(C(TARGET).isNotNull()).select(*KEYS, TARGET, *EXACT)
    data = materialise(VectorAssembler(inputCols=EXACT, outputCol="features").transform(rows).select(*KEYS, TARGET, "features"))
    return forests.forest_scores(forests.grow_forest(data, TARGET, KEYS, trees=1), data, KEYS).withColumnRenamed("s0", "prediction")


@query("i06_forest_one_feature", "dummy_total:i prediction:f9", f"{GROUP_MEANS}", ["features"])
def _(t):
    """A single tree on all rows, which is the mean of each side."""
    data = _one_feature(t)
    fit = models.forest(TARGET, numTrees=1, maxDepth=1, bootstrap=False).fit(data)
    return fit.transform(data).groupBy("dummy_total").agg(F.avg("pred_forest").alias("prediction"))


def _forest_search(t):
    """The whole grid on the monthly study: 600 trees to purity; the daily one, six times the rows, takes minutes at the same settings."""
    data = materialise(study.feature_vectors(study.model_frame(t.features("monthly"), "monthly"), "monthly", 0.8))
    train = materialise(models.with_fold(data.filter("is_train"), KEYS, 3).select(*KEYS, MONTHLY_TARGET, "features", "fold"))
    return data, forests.search_forest(train, MONTHLY_TARGET, KEYS)


@query("i06_forest_grid", METRICS)
def _(t):
    """All 16 settings over three folds; the best one's forest on the test rows."""
    data, search = _forest_search(t)
    test = data.filter("NOT is_train")
    return _judged(search.predict(test, KEYS), test, MONTHLY_TARGET)


@query("i14_forest_grid_table", "trees:i depth:i min_split:i min_leaf:i score:f best:b")
def _(t):
    """The mean R2 of every setting of the forest search."""
    return _forest_search(t)[1].table


@query("i07_boosted_trees", METRICS)
def _(t):
    _, scored, name = _fitted(t, models.boosted(TARGET), "pred_boosted")
    return models.metrics(scored, TARGET, name)


@query("i07_boosted_one_feature", "dummy_total:i prediction:f9", GROUP_MEANS, ["features"])
def _(t):
    data = _one_feature(t)
    fit = models.boosted(TARGET, maxIter=1, maxDepth=1).fit(data)
    return fit.transform(data).groupBy("dummy_total").agg(F.avg("pred_boosted").alias("prediction"))


@query("i08_regression_tree", METRICS)
def _(t):
    """Fitted on the trimmed train rows at the daily depth and complexity, judged on the others."""
    vectors = materialise(study.feature_vectors(model_frame(t), "daily"))
    fit = _daily_tree(vectors)[0]
    test = study.split_for(vectors, "daily", "tree").filter("NOT is_train")
    return models.metrics(fit.transform(test), TARGET, "pred_forest")


def _daily_tree(vectors):
    train = study.train_rows(vectors, "daily", "tree")
    fit = models.tree(TARGET, TREE["depth"], models.complexity_gain(train, TARGET, TREE["cp"])).fit(train)
    return fit, train


@query("i08_tree_leaf_means", "off:i", "SELECT 0 AS off")
def _(t):
    """Leaves of the fitted tree whose prediction is not the mean of their train rows."""
    fit, train = _daily_tree(materialise(study.feature_vectors(model_frame(t), "daily")))
    leaves = fit.transform(train).groupBy("pred_forest").agg(F.avg(TARGET).alias("mean"))
    return leaves.agg(F.count(F.when(F.abs(C("mean") - C("pred_forest")) > 1e-9, 1)).alias("off"))


@query("i08_tree_one_feature", "dummy_total:i prediction:f9", GROUP_MEANS, ["features"])
def _(t):
    data = _one_feature(t)
    fit = models.tree(TARGET, depth=1).fit(data)
    return fit.transform(data).groupBy("dummy_total").agg(F.avg("pred_forest").alias("prediction"))


@query("i09_logistic_cv", "log_pred:s n:i mean_probability:f")
def _(t):
    vectors = materialise(study.feature_vectors(model_frame(t), "daily"))
    data = study.split_for(vectors, "daily", "logistic")
    search = models.logistic_cv(data.filter("is_train"), "up", KEYS)
    scored = models.with_probability(models.as_class(search.model.transform(data.filter("NOT is_train"))))
    return scored.groupBy("log_pred").agg(F.count(F.lit(1)).alias("n"), F.avg("p_positive").alias("mean_probability"))


@query(
    "i09_logistic_one_feature",
    "dummy_total:i p_positive:f4",
    """SELECT dummy_total, avg(CASE WHEN tomorrow_return >= 0 THEN 1.0 ELSE 0.0 END) AS p_positive
       FROM features WHERE tomorrow_return IS NOT NULL GROUP BY 1""",
    ["features"],
)
def _(t):
    data = _one_feature(t)
    scored = models.with_probability(models.logistic("up").setTol(1e-10).fit(data).transform(data))
    return scored.groupBy("dummy_total").agg(F.max("p_positive").alias("p_positive"))


@query(
    "i10_metrics",
    "n:i mse:f9 rmse:f9 r2:f",
    """SELECT count(*) AS n, avg(pow(y - p, 2)) AS mse, sqrt(avg(pow(y - p, 2))) AS rmse, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2
       FROM (SELECT tomorrow_return AS y, lasso_pred AS p FROM scored WHERE tomorrow_return IS NOT NULL AND lasso_pred IS NOT NULL)""",
    ["scored"],
)
def _(t):
    return models.metrics(t.scored, TARGET, "lasso_pred")


@query(
    "i10_metrics_by_model",
    "MODEL:s n:i mse:f2 rmse:f4 r2:f",
    f"""SELECT MODEL, count(*) AS n, avg(pow(y - EXP, 2)) AS mse, sqrt(avg(pow(y - EXP, 2))) AS rmse,
               1 - avg(pow(y - EXP, 2)) / var_pop(y) AS r2
        FROM (SELECT p.*, lead(EXP) OVER (PARTITION BY TICKER, MODEL ORDER BY YEAR) AS y FROM ({PREDICTIONS_SQL}) p)
        WHERE y IS NOT NULL GROUP BY 1""",
    ["pay"],
)
def _(t):
    """Each model's value as a forecast of the same value next year."""
    from pyspark.sql import Window

    yearly = Window.partitionBy("TICKER", "MODEL").orderBy("YEAR")
    return models.metrics(predictions(t).withColumn("y", F.lead("EXP").over(yearly)), "y", "EXP", ["MODEL"])


@query("i09_roc_table", "fold:i n:i roc:f sensitivity:f specificity:f")
def _(t):
    """Ten folds of the classifier's train rows, each judged by a fit on the others."""
    frame = model_frame(t)
    vectors = materialise(study.feature_vectors(frame, "daily"))
    discard(frame)
    return models.roc_table(study.train_rows(vectors, "daily", "logistic"), "up", KEYS)


@query("i11_score_panel", "TICKER:s date:d lasso_pred:f pred_forest:f log_pred:s")
def _(t):
    """All three models, each fitted on its own split, on every row of the panel."""
    return study.score(materialise(study.feature_vectors(model_frame(t), "daily")), "daily")


@query(
    "i11_compiled_scores",
    "model:s n:i off:i",
    " UNION ALL ".join(f"SELECT '{m}' AS model, (SELECT count(*) FROM frame) AS n, 0 AS off" for m in ("lasso", "tree", "logistic", "boosted")).join(
        [f"WITH frame AS MATERIALIZED (SELECT 1 FROM ({_complete_sql()})) ", ""]
    ),
    ["features"],
)
def _(t):
    """Rows on which a model's expression over the plain columns differs from the fitted model: none."""
    frame = model_frame(t)
    numbers = [c for c in frame.columns if c not in {*KEYS, *CATEGORIES, TARGET}]
    pipe = models.fit_features(frame, numbers, CATEGORIES)
    vectors = materialise(models.apply_features(pipe, frame, CATEGORIES).withColumn("up", (C(TARGET) >= 0).cast("double")).select(*KEYS, *numbers, *CATEGORIES, TARGET, "up", "features"))
    learners = {
        "lasso": (models.lasso(TARGET, PENALTY), "lasso_pred"), "tree": (models.tree(TARGET, depth=7), "pred_forest"),
        "logistic": (models.logistic("up"), "p_positive"), "boosted": (models.boosted(TARGET, maxIter=3, maxDepth=4), "pred_boosted"),
    }
    with models.kept(models.spread(vectors.select(TARGET, "up", "features"))) as rows:
        fits = {name: learner.fit(rows) for name, (learner, _) in learners.items()}
    parts = None
    for name, (_, column) in learners.items():
        fit = fits[name]
        scored = fit.transform(vectors)
        scored = models.with_probability(scored) if name == "logistic" else scored
        off = F.abs(C(column) - compiled.model_column(fit, pipe)) > 1e-9
        row = scored.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).alias("off")).withColumn("model", F.lit(name))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def _quintile_edges(column: str) -> str:
    return ", ".join(f"quantile_cont({column}, {p}) AS e{i}" for i, p in enumerate((0.2, 0.4, 0.6, 0.8), 1))


@query(
    "i11_split_sizes",
    "learner:s train:i test:i",
    f"""WITH frame AS MATERIALIZED (SELECT TICKER, date, tomorrow_return AS y FROM ({_complete_sql()})),
        quintile AS (SELECT CAST(y > e1 AND e1 > e0 AS INT) + CAST(y > e2 AND e2 > e1 AS INT) + CAST(y > e3 AND e3 > e2 AS INT)
                            + CAST(y > e4 AND e4 > e3 AS INT) AS s
                     FROM frame CROSS JOIN (SELECT min(y) AS e0, {_quintile_edges("y")} FROM frame)),
        drawn AS (SELECT y, {HASH_SQL.format(text="'42|' || TICKER || '|' || CAST(date AS VARCHAR)")} < 0.7 AS is_train FROM frame)
        SELECT 'lasso' AS learner, sum(k) AS train, sum(n - k) AS test FROM (SELECT count(*) AS n, ceil(count(*) * 0.7) AS k FROM quintile GROUP BY s)
        UNION ALL SELECT 'tree', (SELECT count(*) FROM drawn CROSS JOIN (SELECT quantile_cont(y, 0.025) AS lo, quantile_cont(y, 0.975) AS hi
                                  FROM drawn WHERE is_train) WHERE is_train AND y BETWEEN lo AND hi), count(*) FILTER (NOT is_train) FROM drawn
        UNION ALL SELECT 'logistic', sum(k), sum(n - k) FROM (SELECT count(*) AS n, ceil(count(*) * 0.7) AS k FROM frame GROUP BY y >= 0)""",
    ["features"],
)
def _(t):
    vectors = materialise(study.feature_vectors(model_frame(t), "daily").drop("features"))
    parts = None
    for learner in ("lasso", "tree", "logistic"):
        train = study.train_rows(vectors, "daily", learner).agg(F.count(F.lit(1)).alias("train"))
        test = study.split_for(vectors, "daily", learner).filter("NOT is_train").agg(F.count(F.lit(1)).alias("test"))
        row = train.select(F.lit(learner).alias("learner"), "train", test.scalar().alias("test"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query("i12_nonzero_coefficients", "feature:s coefficient:f9")
def _(t):
    data = prepared(t)
    with models.kept(data.filter("is_train")) as train:
        fit = models.lasso(TARGET, PENALTY).fit(train)
    return models.coefficient_table(t.spark, fit, models.feature_names(data))


@query(
    "i13_logit_table",
    "feature:s coefficient:f std_error:f z:f4",
    """SELECT f.u.feature, f.u.b AS coefficient, f.u.e AS std_error, f.u.b / f.u.e AS z FROM (
         SELECT unnest([{'feature': '(intercept)', 'b': ln(c / d), 'e': sqrt(1 / c + 1 / d)},
                        {'feature': 'dummy_total', 'b': ln(a / b) - ln(c / d), 'e': sqrt(1 / a + 1 / b + 1 / c + 1 / d)}]) AS u
         FROM (SELECT CAST(count(*) FILTER (dummy_total = 1 AND tomorrow_return >= 0) AS DOUBLE) AS a,
                      CAST(count(*) FILTER (dummy_total = 1 AND tomorrow_return < 0) AS DOUBLE) AS b,
                      CAST(count(*) FILTER (dummy_total = 0 AND tomorrow_return >= 0) AS DOUBLE) AS c,
                      CAST(count(*) FILTER (dummy_total = 0 AND tomorrow_return < 0) AS DOUBLE) AS d FROM features)) f""",
    ["features"],
)
def _(t):
    return models.logit_table(_one_feature(t), "up", ["dummy_total"])


@query("i13_logit_table_all_features", "feature:s coefficient:f std_error:f z:f4 p_value:f")
def _(t):
    """Numbers and one flag; the news counts and the total flag determine one another, so the total stays out."""
    names = [c for c in NUMBERS if c != "total"] + ["dummy_negative"]
    rows = model_frame(t).withColumn("up", (C(TARGET) >= 0).cast("double"))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return models.logit_table(vectors, "up", names)


@query("i14_tuning_table", "step:i penalty:f9 score:f9 best:b")
def _(t):
    """The mean squared error of every penalty of the path over the folds."""
    path = models.lasso_path(prepared(t).filter("is_train"), TARGET, KEYS)
    return models.path_table(t.spark, path)


PENALTIES = (0.0005, 0.002, 0.004)


def _market_feature(t):
    rows = t.panel.select(*KEYS, "RET", "sprtrn")
    return VectorAssembler(inputCols=["sprtrn"], outputCol="features").transform(rows)


@query(
    "i14_tuning_table_one_feature",
    "setting:s score:f9 best:b",
    f"""WITH folded AS (
          SELECT RET AS y, sprtrn AS x,
                 floor({HASH_SQL.format(text="'43|' || TICKER || '|' || CAST(date AS VARCHAR)")} * 5) AS fold FROM panel),
        stats AS (
          SELECT f, corr(y, x) AS r, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg(x) AS mx, avg(y) AS my
          FROM folded JOIN (SELECT unnest(range(5)) AS f) ON fold <> f GROUP BY f),
        lines AS (
          SELECT p, f, my, mx, sign(r) * greatest(abs(r) - p / sy, 0) * sy / sx AS slope
          FROM stats CROSS JOIN (SELECT unnest([{', '.join(map(str, PENALTIES))}]) AS p)),
        errors AS (
          SELECT p, f, avg(pow(y - (my + slope * (x - mx)), 2)) AS mse FROM folded JOIN lines ON fold = f GROUP BY p, f),
        means AS (SELECT p, avg(mse) AS score FROM errors GROUP BY p)
        SELECT 'regParam=' || CASE {' '.join(f"WHEN p = {p} THEN '{p}'" for p in PENALTIES)} END AS setting, score,
               score = (SELECT min(score) FROM means) AS best FROM means""",
    ["panel"],
)
def _(t):
    return models.tuning_table(t.spark, models.lasso_cv(_market_feature(t), "RET", KEYS, PENALTIES))


@query(
    "i12_all_coefficients_shrunk",
    "feature:s coefficient:f9",
    "SELECT '(intercept)' AS feature, avg(RET) AS coefficient FROM panel",
    ["panel"],
)
def _(t):
    """A penalty above every correlation leaves the mean alone."""
    return models.coefficient_table(t.spark, models.lasso("RET", 1.0).fit(_market_feature(t)), ["sprtrn"])
