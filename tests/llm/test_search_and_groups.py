"""Top-k search, SimHash groups and embedding near-duplicates against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import simhash, topk
from tidemark.llm.common import local_roots
from tidemark.llm.forest import near_vectors
from tidemark.llm.graph import components

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("score", T.StringType()), T.StructField("copies", T.StringType()),
    ]
)


def least_reachable(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for start in sorted(nodes):
        if start in root:
            continue
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in root:
                root[n] = start
                stack += near[n]
    return root


def vector_rows(n=400, dims=16, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.06 * draw.standard_normal(dims) if i % 3 else draw.standard_normal(dims)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), i % 2 if i % 17 else None, "s", "c"))
    rows[7] = (7, None, 1, "s", "c")
    rows[8] = (8, [float("nan")] * dims, 0, "s", "c")
    rows[9] = (9, [None] + [1.0] * (dims - 1), 1, "s", "c")
    rows[10] = (10, [0.0] * dims, 0, "s", "c")
    rows[11] = (11, [float("inf")] + [1.0] * (dims - 1), 1, "s", "c")
    rows += [(n, rows[1][1], 1, "s", "c"), (n + 1, rows[1][1], 1, "s", "c"), (n + 2, [1.0, 2.0], 1, "s", "c"), (n + 3, [1.0, 2.0], 1, "s", "c")]
    rows += [(n + 4, [], 1, "s", "c"), (None, rows[1][1], 1, "s", "c"), rows[20], rows[20]]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("blocks", [(16384, 4096), (37, 5)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rows = vector_rows()
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, k=5)
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, *_ in rows if i is not None and usable(v)}
    want = []
    for q in (i for i in ints if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_prunes_and_stays_exact_with_ties_and_huge_numbers():
    draw = np.random.default_rng(5)
    rows = draw.integers(-3, 4, (500, 24))
    ids = np.arange(500)
    for scale in (1, 10**17):
        q, i, s = topk.block_search(rows[:9] * scale, ids[:9], rows, ids, 4)
        for query in range(9):
            scores = rows @ rows[query] * scale
            best = sorted((-int(scores[j]), j) for j in ids if j != query)[:4]
            mine = q == query
            assert list(zip(-s[mine], i[mine])) == best


def test_top_k_of_nothing(spark):
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).collect() == []


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(spark, make_docs, odd_texts):
    got = simhash.simhash_groups(make_docs(odd_texts)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in odd_texts]
    known = sorted({(i, p) for i, p in prints if i is not None})
    links = [(a, b) for a, p in known for b, q in known if a < b and bin(p ^ q).count("1") <= 3]
    root = least_reachable({i for i, _ in known}, links)
    by_print = {p: root[i] for i, p in known}
    want = [(i, f"{p:016x}", by_print.get(p)) for i, p in prints]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=lambda r: str(r)) == sorted(want, key=lambda r: str(r)), key
    assert len({r[2] for r in want}) < len(want) - 40  # the near copies are linked


def near_prints(n, seed):
    draw = np.random.default_rng(seed)
    out = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, n, dtype=np.uint64)
    for i in range(n // 2):  # chains of small steps from earlier prints
        bits = draw.choice(64, int(draw.integers(1, 5)), replace=False)
        out[n // 2 + i] = out[draw.integers(0, n // 2 + i)] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
    return np.unique(out)


@pytest.mark.parametrize("node_rows", [4096, 3])
def test_index_finds_every_link(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    prints = near_prints(700, 11)
    rows = [(i, int(p.astype(np.int64))) for i, p in enumerate(prints)]
    links = simhash.near_links(spark.createDataFrame(rows, "id long, print long"))
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    want = least_reachable(range(len(prints)), zip(a.tolist(), b.tolist()))
    assert {i: got.get(i, i) for i in range(len(prints))} == want


def test_one_node_lists_each_close_pair_once():
    prints = near_prints(900, 4)
    order = np.argsort(simhash.gray_rank(prints))
    prints = prints[order]
    found = [p for a, b in simhash.close_pairs(np.zeros(len(prints), np.int64), prints) for p in zip(a.tolist(), b.tolist())]
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    assert sorted(found) == sorted(zip(a.tolist(), b.tolist()))


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000), (None, 3), (3, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1201)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_local_roots():
    assert local_roots(6, np.array([4, 3, 5]), np.array([3, 1, 0])).tolist() == [0, 1, 2, 1, 1, 0]


def brute_vectors(rows, least=0.98):
    # of rows that repeat an id the smallest label and vector counts
    best = {}
    for i, v, label, *_ in rows:
        if i is not None and i not in best:
            best[i] = (v, label)
    ok = [i for i, (v, label) in best.items() if label is not None and usable(v) and any(v)]
    links = []
    for x, a in enumerate(ok):
        for b in ok[x + 1 :]:
            (v, s), (w, t) = best[a], best[b]
            if s == t and len(v) == len(w):
                v, w = np.array(v, np.float64), np.array(w, np.float64)
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                    links.append((a, b))
    root = least_reachable(best, links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], root[i], root[i] == i) for i in best}, links


@pytest.mark.parametrize("sizes", [(512, 1024), (20, 8)])
def test_near_vectors_find_nearly_all_links_and_no_other(spark, sizes):
    rows = vector_rows(700)
    got = {r[0]: tuple(r[1:]) for r in near_vectors(spark.createDataFrame(rows, VECTORS), leaf_rows=sizes[0], block_rows=sizes[1]).collect()}
    want, links = brute_vectors(rows)
    assert set(got) == set(want)
    assert len(links) > 1000
    found = sum(g[0] for g in got.values()) / (2 * len(links))
    assert 0.97 <= found <= 1
    assert all(got[i][0] <= want[i][0] for i in want)
    if sizes[0] == 512:  # one leaf a tree: all links
        assert got == want


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    only_bad = near_vectors(spark.createDataFrame([(1, None, 1, "", ""), (2, [0.0], 1, "", "")], VECTORS)).collect()
    assert sorted(tuple(r) for r in only_bad) == [(1, 0, 1, True), (2, 0, 2, True)]
