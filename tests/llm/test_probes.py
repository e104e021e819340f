"""Probes of single rules: furniture of pages, deep projection forests, groups of best neighbours, equal rows in shards."""

import random

import numpy as np
import pytest

from tidemark.llm.forest import FIT_ROWS, fit_forest, leaves_of, near_vectors
from tidemark.llm.graph import best_groups, components
from tidemark.llm.html_template import blocks_of, main_blocks
from tidemark.llm.sharding import interleaved_shards


def kept(html):
    blocks = [b for b in blocks_of(html) if not b.furniture]
    return " ".join(b.text() for b in main_blocks(blocks) or blocks)


@pytest.mark.parametrize(
    "mark",
    ['class="user-comments"', 'class="comment-list"', 'class="commentlist"', 'id="respond"', 'class="ad-slot"', 'class="ad_container"', 'class="adsbygoogle"',
     "hidden", 'style="color:red; display: none"', 'role="navigation"'],
)
def test_marked_elements_are_furniture(mark):
    assert kept(f"<body><div><p>story one</p></div><div {mark}><p>inner</p></div><p>two</p></body>") == "story one two"
    assert kept(f"<article><p>a <span {mark}>x</span>b</p><div {mark}>no</div></article>") == "a b"


@pytest.mark.parametrize("name", ["content-with-sidebar", "post has-comments", "no-sidebar", "main-menu-page", "hidden-gem", "adventure", "add"])
def test_names_that_speak_of_the_whole_stay(name):
    assert kept(f'<body><div class="{name}"><p>inner</p></div></body>') == "inner"


def test_advert_links_and_unclosed_links():
    assert kept('<article><p>x <a class="ad" href="q">buy <b>now</b></a> y</p></article>') == "x y"
    blocks = blocks_of("<div><p>a <a href=x>link</p><p>rest of text</p></div><p>more</p>")
    assert [(b.text(), b.linked > 0) for b in blocks] == [("a link", True), ("rest of text", False), ("more", False)]
    assert [b.linked for b in blocks_of("<p><a href=x>one <b>two</b></a> three</p>")] == [7]


def test_levels_beyond_the_fitted_ones_split_on():
    draw = np.random.default_rng(2)
    sample = draw.standard_normal((256, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    forest = fit_forest(sample, 8, 2, 1)
    own = 3  # 256 rows bear 8 leaves of 32
    assert all(len(cuts) == 7 + 5 for _, cuts in forest)
    leaves = leaves_of(sample, forest, 8, 0.0, own)
    sizes = np.bincount([x for row in leaves for x in row if x < 256])
    assert sizes.max() < 20 and all(len(row) >= 2 for row in leaves)
    near = leaves_of(sample + 1e-9, forest, 8, 0.01, own)
    assert all(set(a) <= set(b) for a, b in zip(leaves, near))


def test_forest_recall_on_deep_trees(spark):
    draw = np.random.default_rng(7)
    rows, pairs = [], []
    for i in range(3000):
        v = draw.standard_normal(24)
        rows.append((2 * i, i % 3 if i % 3 else 0, v.tolist()))
        noise = draw.standard_normal(24)
        noise -= (noise @ v) / (v @ v) * v
        near = v / np.linalg.norm(v) + noise / np.linalg.norm(noise) * np.sqrt(1 / 0.9805**2 - 1)
        rows.append((2 * i + 1, i % 3 if i % 3 else 0, near.tolist()))
        pairs.append((2 * i, 2 * i + 1))
    made = near_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), leaf_rows=4)
    root = {r["vec_id"]: r["component_id"] for r in made.collect()}
    assert len(rows) < FIT_ROWS and np.mean([root[a] == root[b] for a, b in pairs]) >= 0.98


def test_best_groups_are_the_components_of_best_links(spark):
    rng = random.Random(3)
    score = {}
    for _ in range(900):
        a, b = sorted(rng.sample(range(400), 2))
        score[a, b] = rng.randrange(6)
    best = {}
    for (a, b), s in score.items():
        for x, y in ((a, b), (b, a)):
            key = (s, hash((a, b)), y)
            if x not in best or key > best[x]:
                best[x] = key
    links = spark.createDataFrame([(x, k[2]) for x, k in best.items()] + [(1000 + i, 1000 + i + 1) for i in range(200)] + [(1200, 1199)], "a long, b long")
    got = {r["node"]: r["component"] for r in best_groups(links).collect()}
    want = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert set(got) == set(want)
    pairs = {(got[n], want[n]) for n in got}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, None, None)] * 400 + [(i, "text", "a") for i in range(200)], "doc_id long, text string, source string")
    got = interleaved_shards(docs, 8).collect()
    for shard in range(8):
        mine = [r for r in got if r["shard"] == shard]
        assert len(mine) == 75 and sorted(r["slot"] for r in mine) == list(range(75))
        assert sum(r["doc_id"] is None for r in mine) == 50
