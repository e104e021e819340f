"""Ranks, positions and quantiles over a whole table.

A window without ``partitionBy`` moves every row into one task, and so does an exact
percentile aggregate for its distinct values. Here rows are pre-aggregated to one row per
distinct value, spread by value range, counted inside each range, and the ranges are then
shifted by the totals of the ranges before them (one small row per range and group).

The quantile and rank-group operators read their input up to three times and keep their answers
as literals. Give them a stored table (see `materialise`) when the input is costly to derive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise, shuffle_width

# Quantile sketches are off by at most 1 / accuracy of the rows; brackets are twice as wide.
SKETCH_ACCURACY = 1000
# Size of a stored sketch, and the part of the rows by which its ranks may be off (for some sketches it is more: then all values are counted).
STORED_K, STORED_ERROR = 4000, 0.0025


def value_sketches(df: DataFrame, value: str, periods: Sequence[str]) -> DataFrame:
    """One quantile sketch per period, to be stored: the sketches of any span can be merged without the rows."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*periods).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(STORED_K)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def sketched_quantiles(sketches: DataFrame, ranks: Sequence[float]) -> list[float | None]:
    """Near values of some quantiles over all the sketches given, and nothing but them read."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    found = merged.select("n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(r)))).alias(f"_{i}") for i, r in enumerate(ranks)]).first()
    return [found[f"_{i}"] for i in range(len(ranks))]


def running_total(
    df: DataFrame, order: Sequence[str], amount: str, out: str, groups: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """Add `out`: the sum of `amount` over all rows that come before, within the group.

    `groups` + `order` must be unique and non-null, `amount` non-negative. The ranged rows are
    written once, because both the totals and the result must see the same ranges. `total` also
    adds the sum of the whole group.
    """
    keys = [*groups, *order]
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *keys).withColumn(
        "_range", F.spark_partition_id()
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(*order)
    counted = materialise(
        ranged.withColumn("_upto", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    offsets = _offsets(counted.groupBy(*groups, "_range").agg(F.max("_upto").alias("_sum")), groups)
    result = counted.join(offsets, [*groups, "_range"]).withColumn(out, F.col("_offset") + F.col("_upto") - F.col(amount))
    if total is not None:
        result = result.withColumn(total, F.col("_whole"))
    return result.select(*df.columns, out, *([total] if total else []))


def _offsets(sums: DataFrame, groups: Sequence[str]) -> DataFrame:
    """What lies before each range within its group, and the group's whole sum.

    The input has one row per range, plus one per group border: small however many rows there are.
    """
    ranges = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(ranges), F.lit(0))).withColumn(
        "_whole", F.sum("_sum").over(Window.partitionBy(*groups))
    )
    # without groups there is one row per range; with groups Spark decides from the size of the written table
    return materialise(offsets) if groups else F.broadcast(offsets)


def row_index(
    df: DataFrame, order: Sequence[str], out: str, groups: Sequence[str] = (), descending: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Add a zero-based position in the stated unique order (numeric columns may run downwards).

    Rows are shuffled once, by range. The position inside a sorted range is the low part of the
    increasing id; the ranges before are added to it. `total` also adds the rows of the group.
    """
    keys = [*groups, *[-F.col(name) if name in descending else F.col(name) for name in order]]
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    ids = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(
        ids.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    )
    offsets = _offsets(
        placed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_sum"), F.min("_at").alias("_first")), groups
    )
    result = placed.join(offsets, [*groups, "_range"]).withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first"))
    if total is not None:
        result = result.withColumn(total, F.col("_whole"))
    return result.select(*df.columns, out, *([total] if total else []))


def value_counts_in_order(
    df: DataFrame, value: str, groups: Sequence[str] = (), extra: Sequence[Column] = (), total: str | None = None
) -> DataFrame:
    """One row per distinct value: `n` rows, `before` rows with a smaller value, plus `extra` sums."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    return running_total(counts, [value], "n", "before", groups, total)


def counts_near(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), total: str = "total", sketches: DataFrame | None = None
) -> DataFrame:
    """Exact counts of the values around some quantiles; everything between is one lump each.

    A coarse sketch brackets every quantile. A second pass counts the values inside the brackets
    and adds up the rows between them, so a few percent of the distinct values are shuffled, not
    all of them. The result holds the groups, `value`, `n`, `before`, `lump` and the group's row
    count; a lump stands under its smallest value. With stored `sketches` of the same rows (without groups) the first pass is
    not needed: the rows are read once.
    """
    probs = sorted(probs)
    accuracy = max(SKETCH_ACCURACY, 200 * len(probs)) if sketches is None else 1 / STORED_ERROR  # many brackets are narrow ones
    marks = [min(max(p + s * 2.0 / accuracy, 0.0), 1.0) for s in (-1, 1) for p in probs]
    known = df.filter(F.col(value).isNotNull())
    if sketches is not None:
        if groups:
            raise ValueError("stored sketches are for a whole column")
        marked = known.select(value)
        at = [F.lit(m) for m in sketched_quantiles(sketches, marks)]
    elif groups:
        sketch = known.groupBy(*groups).agg(F.percentile_approx(F.col(value), marks, accuracy).alias("_marks"))
        # written, so that Spark knows its size and broadcasts it when small
        marked = known.select(*groups, value).join(materialise(sketch), list(groups))
        at = [F.col("_marks")[i] for i in range(len(marks))]
    else:
        marked = known.select(value)
        sketch = known.agg(F.percentile_approx(F.col(value), marks, accuracy).alias("_marks"))
        at = [F.lit(m) for m in sketch.first()["_marks"] or [None] * len(marks)]
    v = F.col(value)
    near, passed = F.lit(False), F.lit(0)
    for low, high in zip(at[: len(probs)], at[len(probs) :]):
        near = near | ((v >= low) & (v <= high))
        passed = passed + (v > high).cast("int")
    cells = (
        marked.withColumn("_near", F.when(near, v))
        .withColumn("_gap", F.when(F.col("_near").isNull(), passed))
        .groupBy(*groups, "_gap", "_near")
        .agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"))
        .select(*groups, value, "n", F.col("_near").isNull().alias("lump"))
    )
    return running_total(cells, [value], "n", "before", groups, total).select(
        *groups, value, "n", "before", "lump", total
    )


def _lumped(positions: Sequence[Column | int]) -> Column:
    """Whether any of the (one-based) positions falls into a lump."""
    missed = F.lit(False)
    for position in positions:
        missed = missed | ((F.col("before") < position) & (position <= F.col("before") + F.col("n")))
    return F.coalesce(F.max(F.col("lump") & missed), F.lit(False))


def grouped_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], groups: Sequence[str]
) -> DataFrame:
    """Exact quantiles, linear between neighbours, one row per group (one in all without groups)."""
    pick = _neighbours(value, probs, groups)
    picked = materialise(pick(counts_near(df, value, probs, groups)))
    if not picked.filter("_missed").isEmpty():  # the sketch was off; count every distinct value instead
        full = value_counts_in_order(df, value, groups, total="total").withColumn("lump", F.lit(False))
        picked = pick(full)
    between = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("total") - 1) * F.lit(float(p))
        between.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (h - F.floor(h))).alias(name))
    return picked.select(*groups, *between)


def _neighbours(value: str, probs: Sequence[float], groups: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """From counts in order to the values on both sides of each quantile, and whether one of them fell into a lump."""
    steps = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]

    def at(position: Column) -> Column:
        here = (F.col("before") < position) & (position <= F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    def pick(counts: DataFrame) -> DataFrame:
        ends = []
        for i, h in enumerate(steps):
            ends += [at(F.floor(h) + 1).alias(f"_low{i}"), at(F.ceil(h) + 1).alias(f"_high{i}")]
        missed = _lumped([f(h) + 1 for h in steps for f in (F.floor, F.ceil)])
        return counts.groupBy(*groups).agg(F.max("total").alias("total"), missed.alias("_missed"), *ends)

    return pick


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], sketches: DataFrame | None = None) -> list[float | None]:
    """Exact quantiles of a whole column. One row of neighbours reaches the driver."""
    pick = _neighbours(value, probs, ())
    stored = {} if sketches is None else {"sketches": sketches}
    row = pick(counts_near(df, value, probs, **stored)).first()
    if row["_missed"]:  # the sketch was off; count every distinct value instead
        row = pick(value_counts_in_order(df, value, total="total").withColumn("lump", F.lit(False))).first()
    found = []
    for i, p in enumerate(probs):
        low, high = row[f"_low{i}"], row[f"_high{i}"]
        if low is None:
            found.append(None)
            continue
        h = (row["total"] - 1) * float(p)
        found.append(float(low) + (float(high) - float(low)) * (h - math.floor(h)))
    return found


def values_at(df: DataFrame, value: str, positions: Sequence[int], rows: int) -> list:
    """The values at some one-based positions in ascending order; `rows` is the non-null row count."""
    picks = [
        F.max(F.when((F.col("before") < k) & (k <= F.col("before") + F.col("n")), F.col(value))).alias(f"_{k}")
        for k in positions
    ]
    near = counts_near(df, value, [(k - 0.5) / rows for k in positions])
    missed, *found = near.agg(_lumped(positions), *picks).first()
    if missed:  # the sketch was off; count every distinct value instead
        found = list(value_counts_in_order(df, value).agg(*picks).first())
    return found


def quantile_bins(
    df: DataFrame, value: str, bins: int, out: str, duplicates: str = "raise", keep_edges: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Bin by quantile edges: right closed, lowest value included, zero-based, null stays null.

    Equal edges are an error unless `duplicates="drop"`. The few edges enter the plan as literals.
    """
    edges = quantile_values(df, value, [i / bins for i in range(bins + 1)], sketches)
    if edges[0] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    # an edge equal to the one before it bounds an empty bin
    unique = edges[:1] + [high for low, high in zip(edges, edges[1:]) if high > low]
    if len(unique) < len(edges) and duplicates == "raise":
        raise ValueError(f"quantile edges of {value} are not unique: {edges}")
    rank = F.lit(0)
    for edge in unique[1:-1]:
        rank = rank + (F.col(value) > edge).cast("int")
    result = df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    if keep_edges:
        bounds = F.array(*[F.lit(e) for e in unique])
        result = result.withColumn(f"{out}_low", F.element_at(bounds, (F.col(out) + 1).cast("int")))
        result = result.withColumn(f"{out}_high", F.element_at(bounds, (F.col(out) + 2).cast("int")))
    return result


def rank_groups(df: DataFrame, value: str, groups: int, out: str) -> DataFrame:
    """Group floor(rank * groups / (n + 1)) with mean ranks on ties; nulls stay unranked.

    Groups rise with the value, so each is fixed by its smallest value: the table is compared
    with fewer than `groups` literal thresholds and is never shuffled by value.
    """
    size = F.col("total")
    # a lump starts at its smallest value's first position, which bounds that value's rank
    mean_rank = F.when(F.col("lump"), F.col("before") + 1).otherwise(F.col("before") + (F.col("n") + 1) / 2)
    group = F.floor(mean_rank * groups / (size + 1))
    starts = [F.min(F.when(group >= g, F.col(value))).alias(f"_{g}") for g in range(1, groups)]
    positions = [F.ceil(g * (size + 1) / groups) for g in range(1, groups)]
    near = counts_near(df, value, [g / groups for g in range(1, groups)])
    missed, *starts_found = near.agg(_lumped(positions), *starts).first()
    if missed:  # the sketch was off; count every distinct value instead
        full = value_counts_in_order(df, value, total="total").withColumn("lump", F.lit(False))
        starts_found = full.agg(*starts).first()
    rank = F.lit(0)
    for start in starts_found:
        if start is not None:
            rank = rank + (F.col(value) >= start).cast("int")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
