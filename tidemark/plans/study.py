"""Whole studies: one function per step, for any universe and frequency.

The parameters that differ between universes and frequencies are data in `tidemark.config`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import values
from tidemark.operators import aggregates, annual, cells, models, order, portfolio, resample, windows
from tidemark.session import materialise
from tidemark.sources.files import write_table

C = F.col


# ---- summaries of returns and news --------------------------------------------------------

def as_panel(periods: DataFrame) -> DataFrame:
    """Give rolled-up periods the column names of a daily panel."""
    return periods.withColumnsRenamed(
        {
            "start": "date", "sum_RET": "RET", "sum_sprtrn": "sprtrn", "sum_total": "total", "sum_positive": "positive",
            "sum_negative": "negative", "mean_market_cap": "market_cap",
        }
    )


def summary_rows(panel: DataFrame, freq: str) -> DataFrame:
    """Rows with a previous return, written once because a dozen summaries read them."""
    single = windows.one_row_per_day(panel)
    rows = single if freq == "daily" else as_panel(resample.rollup(single, freq))
    columns = ["TICKER", "date", "SICCD", "market_cap", "RET", "sprtrn", *aggregates.NEWS]
    return materialise(windows.with_lagged_return(rows.select(*columns)))


def market_rows(rows: DataFrame, freq: str) -> DataFrame:
    """News per date with that date's market return: news rows only for days, all rows for periods."""
    if freq == "daily":
        return aggregates.market_summary(aggregates.with_news(rows))
    return rows.groupBy("date").agg(
        F.min_by("sprtrn", "TICKER").alias("sprtrn"), *[F.sum(c).alias(f"sum_{c}") for c in aggregates.NEWS]
    )


def size_label(rank: Column, groups: int) -> Column:
    """Names of the size groups, smallest first: two for 30 groups, one each otherwise."""
    if groups == 30:
        return values.band_label((rank > 20).cast("int"), ("11-30", "Top 10"))
    if groups == 10:
        return values.band_label(rank, ("Smallest", *config.DECILE_LABELS[1:-1], "Largest"))
    return values.band_label(rank, values.even_labels(groups))


def market_deciles(rows: DataFrame, universe: str, freq: str) -> DataFrame:
    ranked = order.rank_groups(materialise(market_rows(rows, freq)), "sprtrn", 10, "rank")
    banded = ranked.withColumn("percentile_range", values.band_label(C("rank"), config.DECILE_LABELS))
    return aggregates.market_band_summary(banded, "percentile_range")


def stock_deciles(rows: DataFrame, universe: str, freq: str, news_only: bool = False) -> DataFrame:
    ranked = order.rank_groups(rows, "RET", 10, "rank")
    banded = ranked.withColumn("percentile_range", values.band_label(C("rank"), config.DECILE_LABELS))
    return aggregates.stock_band_summary(aggregates.with_news(banded) if news_only else banded, "percentile_range")


def industries(rows: DataFrame, universe: str, freq: str, news_only: bool = False) -> DataFrame:
    limit = config.INDUSTRY_MIN_FIRMS.get((universe, freq))
    kept = aggregates.with_news(rows) if news_only else rows
    result = aggregates.industry_summary(kept, values.industry(C("SICCD")), limit)
    return aggregates.per_company(result) if news_only else result


def sizes(rows: DataFrame, universe: str, freq: str, news_only: bool = False) -> DataFrame:
    groups = config.SIZE_GROUPS[universe, freq]
    ranked = order.rank_groups(rows, "market_cap", groups, "comp_size")
    named = ranked.withColumn("size_group", size_label(C("comp_size"), groups))
    return aggregates.size_summary(aggregates.with_news(named) if news_only else named, "size_group")


def news_count_table(rows: DataFrame, universe: str, freq: str, count: str) -> DataFrame:
    below = config.NEWS_COUNT_LIMIT if (universe, freq) in config.NEWS_COUNT_LIMITED else None
    return aggregates.by_news_count(rows, count, below=below)


def return_summaries(panel: DataFrame, universe: str, freq: str) -> dict[str, Callable[[], DataFrame]]:
    """Every summary of one study, each built when called."""
    rows = summary_rows(panel, freq)
    tables: dict[str, Callable[[], DataFrame]] = {
        "market": lambda: market_rows(rows, freq),
        "market_deciles": lambda: market_deciles(rows, universe, freq),
    }
    for name, build in (("stock_deciles", stock_deciles), ("industries", industries), ("sizes", sizes)):
        for news_only in (False, True):
            label = f"{name}_news" if news_only else name
            tables[label] = lambda build=build, news_only=news_only: build(rows, universe, freq, news_only)
    for count in aggregates.NEWS:
        tables[f"by_{count}"] = lambda count=count: news_count_table(rows, universe, freq, count)
    return tables


# ---- features, models and backtests -------------------------------------------------------

def features_of(panel: DataFrame, freq: str) -> DataFrame:
    """Lags, averages, spread and dummies of a daily panel at some frequency.

    A panel with several rows for a ticker and day keeps the first, as the windows rely on that key.
    """
    single = windows.one_row_per_day(panel)
    rows = single if freq == "daily" else resample.resample(single, freq)
    return windows.with_features(rows, config.BY_NAME[freq])


def store_features(panels: Mapping[str, DataFrame], path: str, frequencies: Sequence[str] = config.FREQUENCIES) -> None:
    """One feature table per universe and frequency, in folders that readers can prune by."""
    for universe, panel in panels.items():
        for freq in frequencies:
            write_table(features_of(panel, freq), f"{path}/universe={universe}/freq={freq}")


KEYS = ["TICKER", "date"]


def average_flags(freq: str) -> dict[str, str]:
    """Names of the flags for a price average above the price, and the averages."""
    f = config.BY_NAME[freq]
    return {f"move_avg_{n}": c for n, c in zip(f.averages, f.average_columns)}


def model_categories(freq: str) -> list[str]:
    return ["comp_size", "proper", "dummy_negative", "dummy_positive", "dummy_total", *average_flags(freq)]


def model_numbers(features: DataFrame, freq: str) -> list[str]:
    """Every numeric column of a feature table but ids, raw prices, averages, categories and the target."""
    f = config.BY_NAME[freq]
    return models.model_columns(features, f.target, model_categories(freq), [*models.LEFT_OUT, *f.average_columns])


def model_frame(features: DataFrame, freq: str, universe: str = "dowjones") -> DataFrame:
    """Size bins and average flags, and the numbers standardised within each ticker; complete rows only.

    Written once, before the bins, which are a few comparisons: encoders, scalers and every fitting round read it again. The numbers are
    standardised on the shuffle by ticker that the features came from.
    """
    target = config.BY_NAME[freq].target
    numbers, categories, flags = model_numbers(features, freq), model_categories(freq), average_flags(freq)
    whole = features.dropna() if universe in config.WHOLE_ROWS_ONLY else features
    plain = [c for c in categories if c != "comp_size" and c not in flags]
    flagged = whole.withColumns({name: windows.average_above_price(C(f"`{c}`"), C("PRC")) for name, c in flags.items()})
    scaled = windows.standardise(flagged.select(*KEYS, *numbers, *plain, *flags, "market_cap", target), numbers)
    stored = materialise(scaled)
    # edges are of all rows; the rest reads complete rows
    binned = order.quantile_bins(stored, "market_cap", 10, "comp_size", duplicates="drop")
    return binned.select(*KEYS, *numbers, *categories, target).dropna()


def feature_vectors(frame: DataFrame, freq: str, fraction: float | None = None) -> DataFrame:
    """Feature vectors with the class outcome, and train flags for a fraction.

    With a fraction the encoders learn from the train rows, otherwise from all.
    """
    target, categories = config.BY_NAME[freq].target, model_categories(freq)
    numbers = [c for c in frame.columns if c not in {*KEYS, *categories, target}]
    flagged = frame if fraction is None else models.with_train_flag(frame, KEYS, fraction)
    encoder = models.fit_features(flagged if fraction is None else flagged.filter("is_train"), numbers, categories)
    vectors = models.apply_features(encoder, flagged, categories)
    kept = [] if fraction is None else ["is_train"]
    return vectors.select(*KEYS, target, (C(target) >= 0).cast("double").alias("up"), "features", *kept)


def split_for(vectors: DataFrame, freq: str, learner: str) -> DataFrame:
    """Train flags as each learner has them: by target quintile, at random, or by class."""
    target, share = config.BY_NAME[freq].target, config.TRAIN_SHARE
    if learner == "lasso":
        return models.with_stratified_flag(models.target_strata(vectors, target), "stratum", KEYS, share).drop("stratum")
    if learner == "tree":
        return models.with_train_flag(vectors, KEYS, share)
    return models.with_stratified_flag(vectors, "up", KEYS, share, seed=123)


def train_rows(vectors: DataFrame, freq: str, learner: str) -> DataFrame:
    """The rows a learner is fitted on; the tree's are trimmed to the middle of the target."""
    train = split_for(vectors, freq, learner).filter("is_train")
    if learner != "tree":
        return train
    return windows.trim_to_quantiles(train, train, config.BY_NAME[freq].target, *config.TRIM)


def score(vectors: DataFrame, freq: str, universe: str = "dowjones") -> DataFrame:
    """Fit the three models, each on its own split, and predict every row.

    `vectors` should be a stored table: each split and fit reads it.
    """
    target, settings = config.BY_NAME[freq].target, config.TREE_OF.get((universe, freq), config.TREE)
    with models.kept(train_rows(vectors, freq, "lasso")) as train:
        path = models.lasso_path(train, target, KEYS)
        scored = models.lasso(target, float(path.penalties[path.best])).fit(train).transform(vectors)
    with models.kept(train_rows(vectors, freq, "tree")) as train:
        gain = models.complexity_gain(train, target, settings["cp"])
        scored = models.tree(target, settings["depth"], gain).fit(train).transform(scored)
    with models.kept(train_rows(vectors, freq, "logistic")) as train:
        scored = models.logistic("up").fit(train).transform(scored)
    return models.as_class(scored)


def strategies(scored: DataFrame, universe: str, freq: str, after: str | None = config.BACKTEST_START) -> DataFrame:
    """Equity curves of all rules with the universe's news gates."""
    gates = config.NEWS_GATES.get((universe, freq), {})
    return portfolio.backtest(scored, config.BY_NAME[freq].target, gates, after)


# ---- annual factors to a ranked portfolio -------------------------------------------------

def annual_predictions(
    factors: DataFrame, features: Sequence[str], target: str, test_year: int, penalty: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """Three models on yearly factors: errors in the test year, and predictions from it on, in long form.

    The lasso penalty is on the factors as they are.
    """
    vectors = materialise(
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
        .transform(factors.filter(C(target).isNotNull()))
        .select("TICKER", "YEAR", target, "features", F.xxhash64(F.rand(42)).alias("_draw"))
    )
    train, test, predict = annual.split_by_year(vectors, test_year)
    with models.kept(train) as rows:
        linear = models.lasso(target, penalty, standardize=False).fit(rows)
    places = cells.feature_places(train, "_draw")
    # the trees learn from the years before and are asked about the others
    celled = materialise(
        vectors.withColumns({"cell": cells.cell_of(places), "asked": C("YEAR") >= test_year, "_learnt": F.when(C("YEAR") < test_year, C(target))})
    )
    wooded = cells.forest_cells(celled, "_learnt", "_draw", models.FOREST_DEFAULTS["numTrees"], models.FOREST_DEFAULTS["maxDepth"], seed=42)
    boosted = cells.boosted_cells(celled, "_learnt", models.boosted(target))
    named = {"lasso_pred": "LR", "pred_forest": "RF", "pred_boosted": "XGB"}
    scored = linear.transform(celled.filter("asked")).join(materialise(wooded), "cell").join(boosted, "cell").withColumnsRenamed(named)
    long = materialise(scored.unpivot(["TICKER", "YEAR", target], list(named.values()), "MODEL", "EXP"))
    return models.metrics(long.filter(C("YEAR") == test_year), target, "EXP", ["MODEL"]), long.drop(target)


def ranked_portfolio(predictions: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily returns of the long/short portfolio each model's ranking gives."""
    return portfolio.portfolio_returns(portfolio.join_positions(returns, portfolio.all_positions(predictions)))
