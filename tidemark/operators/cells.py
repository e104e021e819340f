"""Forests and boosted trees on few features, for any number of rows.

The library's learners split a feature at no more than BINS - 1 places, so a tree tells rows apart by their bins only. Rows with the same bins make a
cell, and what a tree needs of a cell is its weight and its mean. The rows are read once to sum up the cells, for every bag; trees are grown on cells, whose
number does not grow with the rows, and a row's prediction is its cell's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forests
from tidemark.session import materialise

# functions that run on executors travel with their tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature, and rows that the places between them are chosen from: the library's own numbers.
BINS, PLACE_ROWS = 32, 10_000
#: Trees that a task grows.
LOT = 2
#: Tasks that the rows of a cell are dealt to.
SHARES = 8


def split_places(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Where a feature may be split, as the library's learners choose from a sample: between any two values, or else at even shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles.tolist()
    places, stride = [], len(values) / bins
    target, before = stride, int(counts[0])
    for middle, count in zip(middles, counts[1:]):
        if abs(before - target) < abs(before + count - target):
            places.append(float(middle))
            target += stride
        before += int(count)
    return places


def feature_places(train: DataFrame, draw: str, vector: str = "features") -> list[list[float]]:
    """The places of every feature; `draw` is a column of evenly spread numbers of 64 bits that rows are sampled by where they are many."""
    rows = train.count()
    share = 2**63 if rows <= PLACE_ROWS else int(2**63 * (PLACE_ROWS / rows))
    taken = train.filter(F.col(draw).bitwiseAND(2**63 - 1) < F.lit(share - 1)).select(vector_to_array(vector).alias("x")).toPandas()["x"]
    return [split_places(values) for values in np.stack(taken.to_list()).T] if len(taken) else []


def cell_of(places: Sequence[Sequence[float]], vector: str = "features") -> Column:
    """The bins of a row: how many places of each feature lie below it."""
    x = vector_to_array(vector)

    def below(value: Column, some: Sequence[float]) -> Column:
        return F.array_size(F.filter(F.array(*[F.lit(float(p)) for p in some]), lambda place: place < value)) if len(some) else F.lit(0)

    return F.array(*[below(x[i], some).cast("int") for i, some in enumerate(places)])


def _bags(trees: int, seed: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell of a batch the weight and the sum of the label in every tree's bag."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, h, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "h", "asked"))
            order = np.lexsort(cells.T)
            cells, learnt = cells[order], ~np.isnan(y[order])
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(1)])
            y, h, asked = np.where(learnt, y[order], 0.0), h[order], asked[order].astype(np.int64)
            weights, totals = np.empty((len(starts), trees)), np.empty((len(starts), trees))
            for tree in range(trees):
                w = forests.bag_weights(h, tree, seed) * learnt
                weights[:, tree], totals[:, tree] = np.add.reduceat(w, starts), np.add.reduceat(w * y, starts)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.from_numpy_dtype(v.dtype))) for v in (cells[starts], weights, totals)]
            yield pa.RecordBatch.from_arrays([lists[0], pa.array(np.add.reduceat(asked, starts) > 0), *lists[1:]], names=["cell", "asked", "w", "wy"])

    return sums


def _grown(depth: int):
    def predictions(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grow a lot's trees on its cells and hand on the sum of their predictions for every cell that is asked for."""
        parts = [[batch.column(c) for c in ("cell", "asked", "w", "wy")] for batch in batches if batch.num_rows]
        wide = [np.concatenate([p[i].flatten().to_numpy(zero_copy_only=False).reshape(len(p[i]), -1) for p in parts]) for i in (0, 2, 3)]
        cells, at = np.unique(wide[0], axis=0, return_inverse=True)
        asked = np.zeros(len(cells), bool)
        np.logical_or.at(asked, at.ravel(), np.concatenate([p[1].to_numpy(zero_copy_only=False) for p in parts]))
        x, found = cells.astype(float), np.zeros(int(asked.sum()))
        for w, wy in zip(wide[1].T, wide[2].T):
            w, wy = (np.bincount(at.ravel(), v, len(cells)) for v in (w, wy))
            with np.errstate(invalid="ignore"):
                tree = forests.grow(x, wy / w, w, depth=depth, restart=False)
            found += forests.walk(tree, x[asked], [(depth, 0)])[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(cells[asked].astype(np.int32)), pa.list_(pa.int32())), pa.array(found)], names=["cell", "total"])

    return predictions


def forest_cells(rows: DataFrame, label: str, draw: str, trees: int, depth: int, seed: int) -> DataFrame:
    """cell and pred_forest for the cells with an `asked` row; rows without a label are not learnt from.

    A row is in a tree's bag as often as its number `draw` says, so the bags are drawn row by row whatever the cells are.
    """
    given = rows.select("cell", F.col(draw).alias("h"), F.col(label).cast("double").alias("y"), "asked")
    # rows without a label reach numpy as NaN
    sums = materialise(given.repartition("cell", F.pmod("h", F.lit(SHARES))).sortWithinPartitions("cell").mapInArrow(_bags(trees, seed), "cell array<int>, asked boolean, w array<double>, wy array<double>"))
    lots = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // LOT))).alias("lot")
    dealt = sums.select("cell", "asked", "w", "wy", lots).withColumns({c: F.slice(c, F.col("lot") * LOT + 1, LOT) for c in ("w", "wy")})
    tasks = -(-trees // LOT)
    grown = dealt.repartitionByRange(tasks, "lot").groupBy("lot").applyInArrow(_grown(depth), "cell array<int>, total double")
    return grown.groupBy("cell").agg((F.sum("total") / trees).alias("pred_forest"))


def boosted_cells(rows: DataFrame, label: str, learner: GBTRegressor) -> DataFrame:
    """cell and pred_boosted for the cells with an `asked` row, from the library's learner on weighted cells."""
    cells = materialise(
        rows.groupBy("cell").agg(F.count(label).alias("n"), F.avg(label).alias("y"), F.max("asked").alias("asked"))
        .select("cell", "n", "y", "asked", array_to_vector(F.col("cell").cast("array<double>")).alias("features"))
    )
    # cells are few, and so many bins that no cell's value is left out of the places
    learner = learner.copy().setLabelCol("y").setWeightCol("n").setMaxBins(max(BINS, int(np.ceil(np.sqrt(cells.count())))))
    fit = learner.fit(cells.filter("n > 0").coalesce(cells.sparkSession.sparkContext.defaultParallelism))
    return fit.transform(cells.filter("asked")).select("cell", "pred_boosted")
