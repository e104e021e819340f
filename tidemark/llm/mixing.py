"""Mixing sources to target weights by iterative proportional fitting (raking). Built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

FACETS = ("source", "lang", "topic")
#: Exponent by which the observed share of a value becomes its target, where no target is stated.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: Share of all tokens that the query and the pipeline keep, whatever the largest weight is.
KEPT_TOKENS = 0.75
#: Rounds of fitting at most, and the deviation from a target share that ends it.
ROUNDS = 60
CLOSE = 1e-6
#: Cells that one task rakes without a shuffle.
CELLS_TOGETHER = 1 << 16


def lexical_topic(text: Column) -> Column:
    """A coarse topic by form: none, table, symbols, shouting or prose."""
    filled = F.coalesce(text, F.lit(""))
    return (
        F.when(~filled.rlike(r"\S"), "none")
        .when(filled.contains(" | "), "table")
        .when(filled.rlike(r"[*#$%&]{3}"), "symbols")
        .when((F.upper(filled) == filled) & (F.lower(filled) != filled), "shouting")
        .otherwise("prose")
    )


def _coded(value: Column) -> Column:
    """Text that keeps null apart from every value, so that joins on it match."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _parts(cells: DataFrame) -> int:
    """In how many parts a stored table of cells is raked: few cells lie in one, where sums and joins by facet move nothing."""
    return -(-cells.count() // CELLS_TOGETHER) or 1


def _targets(cells: DataFrame, facet: str, stated: Mapping[str | None, float] | None, temper: float) -> DataFrame:
    """(facet value, target share) of the values that occur; stated weights are scaled to those."""
    seen = cells.groupBy(facet).agg(F.sum("tokens").alias("_tokens")).where(F.col("_tokens") > 0)
    if stated is None:
        weighed = seen.withColumn("_w", F.pow(F.col("_tokens").cast("double"), F.lit(float(temper))))
    else:
        pairs = [x for value, weight in stated.items() for x in (F.lit("" if value is None else f"={value}"), F.lit(float(weight)))]
        weighed = seen.withColumn("_w", F.coalesce(F.element_at(F.create_map(*pairs), F.col(facet)), F.lit(0.0)) if pairs else F.lit(0.0))
    total = weighed.agg(F.sum("_w").alias("w")).scalar()
    return materialise(weighed.withColumn("target", F.try_divide(F.col("_w"), total)).select(facet, "target"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Scale the `weight` of cells in turn to the target shares of each facet until all fit.

    `cells` has one row per combination that occurs, so its size follows the facets and not the corpus; one
    number a round reaches the driver. Up to CELLS_TOGETHER of them are raked in one task, without shuffles and
    broadcasts, of which some dozens of rounds would burden the driver. Targets that the occurring combinations cannot meet leave
    the weights of the last round.
    """
    for facet, target in targets.items():
        cells = cells.join(target.select(facet, F.col("target").alias(f"_target_{facet}")), facet)
    cells = materialise(cells)
    parts = _parts(cells)
    cells = cells.coalesce(parts)
    for _ in range(rounds):
        for facet in targets:
            wanted = F.first(f"_target_{facet}")
            sums = cells.groupBy(facet).agg(F.sum("weight").alias("_sum"), wanted.alias("_wanted"))
            factor = F.coalesce(F.try_divide("_wanted", "_sum"), F.lit(0.0))
            factors = sums.select(facet, factor.alias("_factor"), F.abs(F.col("_wanted") - F.col("_sum")).alias("_gap"))
            cells = (
                cells.join(factors.hint("shuffle_hash") if parts == 1 else factors, facet)
                .withColumn("weight", F.col("weight") * F.col("_factor")).withColumn("gap", F.greatest("gap", "_gap")).drop("_factor", "_gap")
                .coalesce(parts)  # stated again, or Spark shuffles the one part before the next join
            )
        cells = materialise(cells).coalesce(parts)
        worst = cells.agg(F.max("gap")).first()[0]
        if worst is None or worst < close:
            break
        cells = cells.withColumn("gap", F.lit(0.0))
    return cells.drop(*[f"_target_{facet}" for facet in targets])


def mixture(
    docs: DataFrame, targets: Mapping[str, Mapping[str | None, float]] | None = None, temper: Mapping[str, float] = TEMPER,
    id_column: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 11, size: float | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, selected of every row of `docs`.

    Tokens (white-space words) are summed by source, language and topic; those cells are raked to the
    target shares of each facet (stated, or the observed share to the power in `temper`, scaled to sum to one).
    A cell's `weight` is its raked over its observed share, and a document is selected with a
    probability in proportion to it: by default the largest proportion at which no probability exceeds one, so the sample
    meets the marginals in expectation. `size` instead asks for that share of all tokens; probabilities
    are then cut at one and the others raised to make up. The draw is a hash of id, text and seed.

    A null source or language is a value of its own. A text without words has no tokens and the weight of
    its cell, 0 if the cell has no tokens at all. Rows without an id draw by text. Repeated rows have equal
    draws. An empty table gives an empty table. Other columns are not read.
    """
    body = F.col(text).cast("string")
    rows = materialise(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col("source").cast("string").alias("_s"), F.col("lang").cast("string").alias("_l"),
        _coded(F.col("source")).alias("source"), _coded(F.col("lang")).alias("lang"), _coded(lexical_topic(body) if topic is None else topic).alias("topic"),
        F.coalesce(F.regexp_count(body, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(F.lit(seed), F.col(id_column).cast("long"), body).alias("_draw"),
    ))
    seen = rows.groupBy(*FACETS).agg(F.sum("tokens").alias("tokens"))
    whole = seen.agg(F.sum("tokens").alias("t")).scalar()
    cells = materialise(seen.withColumn("weight", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole), F.lit(0.0))).withColumn("gap", F.lit(0.0)))
    cells = cells.coalesce(_parts(cells))
    wanted = {f: _targets(cells, f, (targets or {}).get(f), temper.get(f, 1.0)) for f in FACETS}
    share = cells.select(*FACETS, F.col("weight").alias("_share"))
    fitted = materialise(
        raked(cells, wanted).select(*FACETS, "tokens", F.col("weight").alias("_fit")).join(share, list(FACETS))
        .withColumn("weight", F.coalesce(F.try_divide("_fit", "_share"), F.lit(0.0)))
    )
    scale = _scale(fitted, size)
    rated = fitted.select(*FACETS, "weight", F.least(F.col("weight") * F.lit(scale), F.lit(1.0)).alias("probability"))
    unit = F.call_function("shiftrightunsigned", F.col("_draw"), F.lit(11)).cast("double") / float(1 << 53)
    return rows.join(rated, list(FACETS), "left").select(
        "doc_id", F.col("_s").alias("source"), F.col("_l").alias("lang"), F.substring("topic", 2, 1 << 20).alias("topic"), "tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce(unit < F.col("probability"), F.lit(False)).alias("selected"),
    )


def _scale(fitted: DataFrame, size: float | None) -> float:
    top = fitted.agg(F.max("weight"), F.sum("tokens")).first()
    if not top[0]:
        return 0.0
    if size is None:
        return 1.0 / top[0]
    scale, wanted = size, size * top[1]
    for _ in range(ROUNDS):
        cut = F.col("weight") * scale >= 1
        free = F.sum(F.when(~cut, F.col("tokens") * F.col("weight")))
        full, rest = fitted.agg(F.coalesce(F.sum(F.when(cut, F.col("tokens"))), F.lit(0)), F.coalesce(free, F.lit(0.0))).first()
        if not rest:
            break
        further = max(scale, (wanted - full) / rest)
        if further <= scale * (1 + 1e-12):
            break
        scale = further
    return scale
