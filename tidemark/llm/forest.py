"""Near-duplicate vectors through a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import finite_vector, local_roots
from tidemark.llm.graph import components
from tidemark.session import materialise

TREES = 4
#: Vectors the trees are fitted on; every vector is indexed. 16,384 rows of doubles go to the driver.
FIT_ROWS = 16384
#: Fitted rows that a leaf needs, rows per leaf that the depth aims at, and rows of a block in a task.
LEAF_FIT_ROWS = 32
LEAF_ROWS = 16
BLOCK_ROWS = 1024
#: Half width of the overlap at a split, as a multiple of the spread that linked vectors show there.
SPILL = 0.8


def fit_forest(sample: np.ndarray, depth: int, trees: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree the directions and thresholds of the inner nodes, heap order; splits at random quantiles around the middle.

    A node needs LEAF_FIT_ROWS fitted rows a side for a split of its own. Below that depth the nodes of a level share one more direction,
    cut in the middle of the whole sample: a large label is split on, as far as it takes, by a tree of bounded size.
    """
    made = []
    own = min(depth, int(math.log2(max(1, len(sample) / LEAF_FIT_ROWS))))
    for tree in range(trees):
        draw = np.random.default_rng([seed, tree])
        inner = (1 << own) - 1
        directions = draw.standard_normal((inner + depth - own, sample.shape[1]))
        directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
        share = draw.uniform(0.4, 0.6, inner + depth - own)
        cuts = np.zeros(inner + depth - own)
        held = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = held.pop(node, np.zeros(0, np.int64))
            if len(rows) == 0:
                continue
            along = sample[rows] @ directions[node]
            cuts[node] = np.quantile(along, share[node])
            held[2 * node + 1], held[2 * node + 2] = rows[along <= cuts[node]], rows[along > cuts[node]]
        for at in range(inner, len(cuts)):
            cuts[at] = np.quantile(sample @ directions[at], share[at])
        made.append((directions, cuts))
    return made


def leaves_of(vectors: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray]], depth: int, spill: float, own: int | None = None) -> list[list[int]]:
    """Leaf numbers of each vector at some depth, ascending: tree * 2**depth + leaf; more than one per tree near a split.

    `own` is the depth to which nodes have splits of their own; by default the whole.
    """
    own = depth if own is None else own
    out: list[list[int]] = [[] for _ in range(len(vectors))]
    for tree, (directions, cuts) in enumerate(forest):
        held = {0: np.arange(len(vectors))}
        for level in range(depth):
            below: dict[int, np.ndarray] = {}
            for node in sorted(held):
                rows = held[node]
                at = (1 << level) - 1 + node if level < own else (1 << own) - 1 + level - own
                along = vectors[rows] @ directions[at] - cuts[at]
                for child, chosen in ((2 * node, rows[along <= spill]), (2 * node + 1, rows[along >= -spill])):
                    if len(chosen):
                        below[child] = chosen
            held = below
        for node in sorted(held):
            for row in held[node]:
                out[row].append((tree << depth) + node)
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # large components would overflow when squared
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _index(forests: dict[int, tuple[int, list]], least: float):
    spread = math.sqrt(max(0.0, 2 - 2 * least))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for (size, depth), rows in part.groupby([part["embedding"].map(len), "depth"]):
                x = _unit(rows["embedding"].to_list())
                own, forest = forests[int(size)]
                leaves = leaves_of(x, forest, int(depth), SPILL * spread / math.sqrt(size), own)
                yield pd.DataFrame({"rep": rows["rep"].to_numpy(), "label": rows["label"].to_numpy(), "copies": rows["copies"].to_numpy(), "size": int(size), "unit": list(x), "leaves": leaves})

    return mapped


def _padded(lists, below: int, fill: int) -> np.ndarray:
    cut = [[v for v in x if v < below] for x in lists]
    out = np.full((len(cut), max(map(len, cut), default=0)), fill, np.int64)
    for at, x in enumerate(cut):
        out[at, : len(x)] = x
    return out


def _compare(least: float):
    def cell_links(leaf: int, low: int, high: int, ids, copies, block, unit: list, leaves: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links between the blocks `low` and `high` of one leaf, reduced to a sum and one edge per row.

        A pair that meets in several leaves is counted in the smallest leaf number both have.
        """
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        x = np.stack(unit)
        a, b = np.nonzero(x[left] @ x[right].T >= least)
        a, b = left[a], right[b]
        if low == high:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return ids[:0], ids[:0], ids[:0]
        ours, theirs = _padded(leaves, leaf, -1), _padded(leaves, leaf, -2)
        met = np.zeros(len(a), bool)
        for at in range(0, len(a), 65536):
            s = slice(at, at + 65536)
            for column in range(ours.shape[1]):
                met[s] |= (ours[a[s], column][:, None] == theirs[b[s]]).any(1)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a[~met], copies[b[~met]])
        np.add.at(links, b[~met], copies[a[~met]])
        root = local_roots(len(ids), a, b)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return ids[told], ids[root[told]], links[told]

    def compare(lot: pd.DataFrame) -> pd.DataFrame:
        """The cells of a lot, one after the other: most leaves are small, so a task takes many."""
        ids, copies, block = lot["rep"].to_numpy(), lot["copies"].to_numpy(), lot["block"].to_numpy()
        unit, leaves = lot["unit"].to_numpy(), lot["leaves"].to_numpy()
        found = [
            cell_links(int(leaf), int(low), int(high), ids[at], copies[at], block[at], list(unit[at]), list(leaves[at]))
            for (_, _, leaf, low, high), at in lot.groupby(["label", "size", "leaf", "low", "high"]).indices.items() if len(at) > 1
        ]
        rep, other, links = (np.concatenate(part) for part in zip(*found)) if found else (ids[:0], ids[:0], ids[:0])
        return pd.DataFrame({"rep": rep, "other": other, "links": links})

    return compare


def near_vectors(vectors: DataFrame, least: float = 0.98, trees: int = TREES, seed: int = 29, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links are cosines of `least` or more within a label.

    Equal vectors of a label are one node with a weight. The trees are fitted on at most FIT_ROWS nodes (the
    smallest hashes of their ids) and index every node, to a depth that the size of its label asks for (`leaf_rows` nodes a leaf); vectors
    near a split go to both sides. Nodes of a leaf and label
    are compared exactly; a leaf of more than `block_rows` nodes is cut into blocks whose pairs are tasks of their
    own. Compared pairs give one row per node and task: a sum of links and an edge.

    A vector that is null, empty, zero, or holds null or non-finite components, or has no label, links with
    nothing. Vectors of different length are not compared. Rows without an id are left out; of rows that
    repeat an id the smallest label and vector counts. An empty table gives an empty table; other
    columns are not read.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    usable = finite_vector(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    rows = materialise(
        rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("one", F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")))
        .withColumn("two", F.when(F.col("usable"), F.xxhash64(F.lit(2), "embedding")))
    )
    nodes = materialise(
        rows.where("usable").groupBy("label", "one", "two").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding")
        )
    )
    # as many levels as the nodes of the label ask for
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / leaf_rows))).cast("int")
    depths = materialise(nodes.groupBy("label").agg(levels.alias("depth")))
    forests = _fit(nodes, depths, trees, seed)
    indexed = materialise(
        nodes.join(depths, "label").select("rep", "label", "copies", "embedding", "depth").mapInPandas(
            _index(forests, least), "rep long, label long, copies long, size int, unit array<double>, leaves array<long>"
        )
    )
    leaf = ["label", "size", "leaf"]
    filed = indexed.select("*", F.explode("leaves").alias("leaf"))
    sized = filed.groupBy(*leaf).agg(F.count(F.lit(1)).alias("rows"))
    blocks = materialise(sized.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int")))
    celled = (
        filed.join(blocks.drop("rows"), leaf)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "_other"))
        .withColumn("high", F.greatest("block", "_other"))
    )
    rows_to_meet = blocks.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    lots = max(1, rows_to_meet // (4 * block_rows))
    found = materialise(
        celled.select("rep", "copies", "unit", "leaves", "block", "low", "high", *leaf)
        .withColumn("lot", F.pmod(F.xxhash64(*leaf, "low", "high"), F.lit(lots)))
        .groupBy("lot").applyInPandas(_compare(least), "rep long, other long, links long")
    )
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "other").withColumnRenamed("node", "rep")
    named = nodes.join(sums, "rep", "left").join(groups, "rep", "left").select(
        "label", "one", "two",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    return (
        rows.select("vec_id", "label", "one", "two").join(materialise(named), ["label", "one", "two"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _fit(nodes: DataFrame, depths: DataFrame, trees: int, seed: int) -> dict[int, tuple[int, list]]:
    """For each vector length the depth of a node's own splits and a forest deep enough for the largest label."""
    depth = depths.agg(F.max("depth")).first()[0] or 0
    drawn = nodes.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("embedding").toPandas()
    known = {int(r[0]) for r in nodes.select(F.size("embedding")).distinct().collect()}
    forests = {}
    sizes = drawn["embedding"].map(len).to_numpy() if len(drawn) else np.zeros(0, int)
    for size in known:
        drawn_here = drawn["embedding"][sizes == size].to_list()
        # a length too rare to be in the sample is split by directions alone
        sample = _unit(drawn_here) if drawn_here else np.zeros((1, size))
        forests[size] = (min(depth, int(math.log2(max(1, len(sample) / LEAF_FIT_ROWS)))), fit_forest(sample, depth, trees, seed))
    return forests
