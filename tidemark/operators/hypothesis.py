"""Two-sample tests; one row per tested feature comes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distributions import t_p_value, z_p_value
from tidemark.functions.values import ratio
from tidemark.operators.aggregates import dummy_contrast
from tidemark.operators.order import value_counts_in_order
from tidemark.session import materialise


def _two_sample(df: DataFrame, tests: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Size, mean and variance of two sides for each (name, value, in first side): one aggregate."""
    parts, rows = [], []
    for i, (name, value, first) in enumerate(tests):
        fields = [F.lit(name).alias("feature")]
        for side, cond in ((1, first), (0, ~first)):
            x = F.when(cond, value)
            for stat, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp)):
                parts.append(agg(x).alias(f"_{i}_{stat}{side}"))
                fields.append(F.col(f"_{i}_{stat}{side}").alias(f"{stat}{side}"))
        rows.append(F.struct(*fields))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def pooled_t_test(df: DataFrame, value: str, dummies: Sequence[str]) -> DataFrame:
    """Mean of `value` with the dummy against without, pooled variance."""
    sides = _two_sample(df, [(d, F.col(value), F.col(d) == 1) for d in dummies])
    pooled = ratio(
        (F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0"), F.col("n1") + F.col("n0") - 2
    )
    spread = F.sqrt(pooled * (ratio(F.lit(1), F.col("n1")) + ratio(F.lit(1), F.col("n0"))))
    tested = sides.withColumn("t", ratio(F.col("mean1") - F.col("mean0"), spread)).withColumn(
        "df", (F.col("n1") + F.col("n0") - 2).cast("double")
    )
    return tested.select("feature", "n1", "n0", "mean1", "mean0", "t", "df", t_p_value("t", "df").alias("p_value"))


def welch_t_test(df: DataFrame, columns: Sequence[str], ret: str) -> DataFrame:
    """Every column where the return is at least zero against below zero, unequal variances."""
    kept = df.filter(F.col(ret).isNotNull())
    sides = _two_sample(kept, [(c, F.col(c), F.col(ret) >= 0) for c in columns])
    a, b = ratio(F.col("var1"), F.col("n1")), ratio(F.col("var0"), F.col("n0"))
    tested = sides.withColumn("t", ratio(F.col("mean1") - F.col("mean0"), F.sqrt(a + b))).withColumn(
        "df", ratio((a + b) * (a + b), ratio(a * a, F.col("n1") - 1) + ratio(b * b, F.col("n0") - 1))
    )
    return tested.select(
        "feature",
        F.col("mean0").alias("mean_negative"),
        F.col("mean1").alias("mean_positive"),
        (F.col("mean1") - F.col("mean0")).alias("mean_difference"),
        "t",
        "df",
        t_p_value("t", "df").alias("p_value"),
    )


def mann_whitney(df: DataFrame, value: str, dummies: Sequence[str]) -> DataFrame:
    """Rank test of `value` with against without each dummy, tie corrected, two-sided.

    Ranks come from counts per distinct value, shared by all dummies; the rows themselves are
    never ranked.
    """
    flags = [F.sum((F.col(d) == 1).cast("bigint")).alias(f"_n_{d}") for d in dummies]
    counts = value_counts_in_order(df, value, extra=flags)
    rank = F.col("before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = counts.agg(
        F.sum("n").alias("_all"),
        F.sum(n * n * n - n).alias("_ties"),
        *[F.sum(f"_n_{d}").alias(f"_n_{d}") for d in dummies],
        *[F.sum(F.col(f"_n_{d}") * rank).alias(f"_r_{d}") for d in dummies],
    )
    rows = [
        F.struct(
            F.lit(d).alias("feature"),
            F.col(f"_n_{d}").cast("double").alias("n1"),
            (F.col("_all") - F.col(f"_n_{d}")).cast("double").alias("n0"),
            F.col(f"_r_{d}").alias("rank_sum"),
            F.col("_ties").alias("ties"),
        )
        for d in dummies
    ]
    sides = sums.select(F.inline(F.array(*rows)))
    n1, n0 = F.col("n1"), F.col("n0")
    size = n1 + n0
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (size + 1 - ratio(F.col("ties"), size * (size - 1))))
    z = ratio(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - F.lit(0.5), spread)
    return sides.select("feature", u.alias("u"), z.alias("z")).select(
        "feature", "u", "z", F.when(F.col("z") < 0, 1.0).otherwise(z_p_value("z")).alias("p_value")
    )


def dummy_test_table(df: DataFrame, value: str, dummies: Sequence[str]) -> DataFrame:
    """Means, deviations, differences and both p-values for every dummy. The input is written once."""
    df = materialise(df.select(value, *dummies))
    contrast = dummy_contrast(df, value, dummies)
    means = pooled_t_test(df, value, dummies).select(
        F.col("feature").alias("dummy"), F.col("p_value").alias("mean_p_value")
    )
    ranks = mann_whitney(df, value, dummies).select(
        F.col("feature").alias("dummy"), F.col("p_value").alias("volatility_p_value")
    )
    return contrast.join(means, "dummy").join(ranks, "dummy")
