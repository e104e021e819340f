"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import finite_vector
from tidemark.session import materialise, shuffle_width

#: Rows of a candidate block and of a query block; a task holds one block of each.
CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 4096
#: Dimensions accumulated between two bounds.
DIMENSION_BLOCK = 8
SAFE = 2**52


def block_search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, width: int = DIMENSION_BLOCK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query within one block: positions of queries, row ids, scores.

    Rows stand in vertical layout, one array per dimension, dimensions of large mass first. After each
    stretch of dimensions a row's score lies within what the remaining masses of query and row allow
    (Cauchy-Schwarz); rows whose upper bound is below the k-th best lower bound leave, and the survivors
    are compacted. Sums of integers below 2**52 are exact in doubles; larger ones take whole-number
    arithmetic without pruning.
    """
    nothing = np.zeros(0, np.int64)
    if len(rows) == 0 or len(queries) == 0:
        return nothing, nothing, nothing
    d = rows.shape[1]
    peak = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0))
    if peak * max(d, 1) >= SAFE:
        return _plain_search(queries, query_ids, rows, row_ids, k)
    mass = (rows.astype(np.float64) ** 2).sum(0)
    order = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(rows[:, order].T.astype(np.float64))
    asked = queries[:, order].astype(np.float64)
    cuts = [*range(0, d, width), d]
    row_rest = [np.sqrt((columns[c:] ** 2).sum(0)) for c in cuts]
    query_rest = [np.sqrt((asked[:, c:] ** 2).sum(1)) for c in cuts]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(asked), 64):
        part = asked[start : start + 64]
        first = part[:, : cuts[1]] @ columns[: cuts[1]] if d else np.zeros((len(part), len(rows)))
        for at in range(len(part)):
            q = start + at
            alive = np.flatnonzero(row_ids != query_ids[q])
            score = first[at][alive]
            whole = columns
            held = alive  # positions of the survivors in the layout in use
            for b in range(1, len(cuts) - 1):
                if len(alive) > k:
                    slack = query_rest[b][q] * row_rest[b][alive] * (1 + 1e-9) + 1e-6
                    least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                    keep = score + slack >= least
                    if keep.sum() < 0.7 * len(alive):
                        alive, score, held = alive[keep], score[keep], held[keep]
                        whole, held = whole[:, held], np.arange(len(alive))
                stretch = whole[cuts[b] : cuts[b + 1]]
                score = score + part[at, cuts[b] : cuts[b + 1]] @ (stretch if len(held) == stretch.shape[1] else stretch[:, held])
            found.append(_best(q, alive, score, row_ids, k))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (nothing, nothing, nothing)


def _best(q, alive, score, row_ids, k):
    if len(alive) > k:
        edge = np.partition(score, len(alive) - k)[len(alive) - k]
        top = score >= edge
        alive, score = alive[top], score[top]
    ids = row_ids[alive]
    chosen = np.lexsort((ids, -score))[:k]
    return np.full(len(chosen), q), ids[chosen], score[chosen].astype(np.int64)


def _plain_search(queries, query_ids, rows, row_ids, k):
    limit = 2**63 - 1
    out = []
    exact = rows.astype(object)
    for q, query in enumerate(queries.astype(object)):
        alive = np.flatnonzero(row_ids != query_ids[q])
        scores = [max(-limit, min(limit, int(x))) for x in (exact[alive] @ query)]
        chosen = sorted(range(len(alive)), key=lambda i: (-scores[i], row_ids[alive[i]]))[:k]
        out.append(([q] * len(chosen), [row_ids[alive[i]] for i in chosen], [scores[i] for i in chosen]))
    return tuple(np.array([x for part in column for x in part], dtype=np.int64) for column in zip(*out))


def _search(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = queries["vector"].map(len).to_numpy() if len(queries) else np.zeros(0, int)
        there = rows["vector"].map(len).to_numpy() if len(rows) else np.zeros(0, int)
        for size in np.unique(sizes):
            q, r = queries[sizes == size], rows[there == size]
            if len(r) == 0:
                continue
            ids = q["vec_id"].to_numpy()
            at, row_id, score = block_search(
                np.stack(q["vector"].to_list()).reshape(len(q), size), ids,
                np.stack(r["vector"].to_list()).reshape(len(r), size), r["vec_id"].to_numpy(), k,
            )
            out.append(pd.DataFrame({"query_id": ids[at], "vec_id": row_id, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return search


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query row.

    `vectors` has vec_id and embedding; components become floor(scale * x). Queries and candidates are
    cut into blocks; every query block meets every candidate block in one task of bounded size, which
    keeps k rows per query, and the best k over all blocks remain. The number of candidate blocks is the
    larger of the shuffle width and what CANDIDATE_BLOCK asks for.

    Ties go to the smaller vec_id. A query's own id is not a candidate. Vectors that are null or hold
    null, NaN or infinite components, and rows without an id, take no part. Of rows that repeat an id the
    smallest vector counts. Vectors of different length are not compared. Empty tables give no rows;
    other columns are not read.
    """
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = known.where(F.col("vec_id").isNotNull() & finite_vector(F.col("embedding")))
    rows = materialise(
        known.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(
            "vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector")
        )
    )
    asked = rows.where(is_query)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    wide = max(shuffle_width(vectors.sparkSession), math.ceil(counts["n"] / CANDIDATE_BLOCK))
    deep = max(1, math.ceil(counts["q"] / QUERY_BLOCK))
    draw = F.xxhash64("vec_id")
    left = asked.select(
        "vec_id", "vector", F.pmod(draw, F.lit(deep)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("_c")
    )
    right = rows.select(
        "vec_id", "vector", F.pmod(draw, F.lit(wide)).cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("_q")
    ).withColumn("_q", F.col("_q").cast("long"))
    best = (
        left.groupBy("_q", "_c")
        .cogroup(right.groupBy("_q", "_c"))
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
