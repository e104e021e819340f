"""Substring removal, extraction, archives, toxicity, sharding, mixing and packing against brute force."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing, substring, warc
from tidemark.llm.html_template import blocks_of, main_blocks, main_texts
from tidemark.llm.mixing import TEMPER, mixture
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.sharding import interleaved_shards
from tidemark.llm.toxicity import FEATURES, TokenFacts, features_of, toxicity
from tidemark.session import scratch_path

PAGES = "page_id long, url string, html string, payload string, file string"


def as_text(rows):
    return sorted(map(str, rows))


# substring removal


def plain_removal(rows, window):
    split = [(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for at in range(len(words) - window + 1):
                key = tuple(words[at : at + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if i is not None and first[tuple(words[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = b" ".join(w for at, w in enumerate(words) if at not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,limits", [(50, (64, 1024)), (50, (2, 3)), (12, (3, 2))])
def test_removal_equals_brute_force(make_docs, odd_texts, monkeypatch, window, limits):
    monkeypatch.setattr(substring, "REFERENCE_PASSAGES", limits[0])
    monkeypatch.setattr(substring, "STREAM_ROWS", limits[1])
    got = substring.remove_repeats(make_docs(odd_texts), window=window).collect()
    want = plain_removal(odd_texts, window)
    assert as_text(tuple(r) for r in got) == as_text(want)
    assert sum(r[2] for r in want) > 5000


def test_removal_keeps_whole_rows(make_docs):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, passage), (2, f"before\t{passage}  after"), (3, "a  b"), (4, None)])
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, whole_rows=True).collect()}
    assert [got[i]["kept_text"] for i in (1, 2, 3, 4)] == [passage, "before after", "a  b", None]
    assert got[2]["row"]["source"] == "s2" and got[2]["row"]["tokens"] == "y"
    assert substring.remove_repeats(make_docs([])).collect() == []


@pytest.mark.parametrize("repeats", [(0, 100), (40, 100)])
def test_a_document_past_the_reference_limit_keeps_its_own_repeats(make_docs, repeats):
    """A document with more than REFERENCE_PASSAGES passages of an anchor loses only what a smaller one holds."""
    draw = random.Random(21)
    paragraph = " ".join(f"p{i}" for i in range(60))

    def text(times):
        return " ".join(" ".join([*(f"x{draw.randrange(10**6)}" for _ in range(30)), paragraph]) for _ in range(times))

    def other(times):  # shares half of the paragraph's windows with the first
        return " ".join(" ".join([*(f"y{draw.randrange(10**6)}" for _ in range(30)), "q", *paragraph.split()[:55]]) for _ in range(times))

    rows = [(i, make(n)) for i, (make, n) in enumerate([(other, repeats[0]), (text, repeats[1]), (text, 1), (other, 2)]) if n]
    got = substring.remove_repeats(make_docs(rows)).collect()
    assert as_text(tuple(r) for r in got) == as_text(plain_removal(rows, 50))


def test_automaton_matches_every_substring():
    draw = random.Random(1)
    known = [[b"%d" % draw.randrange(3) for _ in range(draw.randrange(1, 40))] for _ in range(12)]
    automaton = substring.SuffixAutomaton()
    for words in known:
        automaton.add(words)
    text = [b"%d" % draw.randrange(3) for _ in range(200)]
    pieces = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
    want = [max(n for n in range(at + 2) if n == 0 or tuple(text[at + 1 - n : at + 1]) in pieces) for at in range(len(text))]
    assert automaton.matched(text) == want


def test_anchors_depend_on_the_window_alone():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 2**63, 300).astype(np.uint64)
    words[100:180] = words[100]  # a run of equal words
    anchor, first, last, place, passage = substring.anchors_of(words)
    assert ((place >= first) & (place <= first + 42)).all()
    assert first[0] == 0 and last[-1] == 250 and (first[1:] == last[:-1] + 1).all()
    for a, f, t, p in zip(anchor, first, last, passage):
        for start in range(f, t + 1):
            assert substring.anchors_of(words[start : start + 50])[0][0] == a
        assert substring.anchors_of(words[f : t + 50])[4][0] == p


# extraction


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


CASES = [
    (page("<nav><ul><li><a href='/x'>x</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>A &amp; B</h1><p><b>One<br><p>two  &eacute;\n three</p></article><footer>&copy; x</footer>"), "A & B One two é three"),
    (page("<main><aside>side</aside><p>Te<i>x</i>t</p><form><input><p>f</p></form><div id='comments'><p>c</p></div><p>more</main>"), "Text more"),
    (page("<article><p>cut &am"), "cut &am"),
    (page("<article><p>a &lt;p&gt; b</p><!-- no --><script>x</script><p>c</article>"), "a <p> b c"),
    ("", ""),
    (None, ""),
    ("<p>un<closed", "un"),
    ("plain text", "plain text"),
    ('<article><div class="cookie-notice">ok?</div><ul><li>p<li>q</ul></article>', "p q"),
    ('<header><h1>Site</h1></header><article><header><h1>Head</h1></header>x</article>', "Head x"),
]


def test_extraction_of_cases(spark):
    rows = [(i, f"https://h{i}.example/a", h, "p", "f") for i, (h, _) in enumerate(CASES)] + [(99, None, CASES[0][0], "p", "f"), (99, None, CASES[0][0], "p", "f")]
    got = main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert as_text((r["page_id"], r["text"], r["n_chars"]) for r in got) == as_text(
        [(i, t, len(t)) for i, (_, t) in enumerate(CASES)] + [(99, CASES[0][1], len(CASES[0][1]))] * 2
    )
    assert main_texts(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("body", [
    '<html class="has-menu"><body class="no-sidebar"><article><p>x y</p></article></body></html>',
    '<body class="search"><p>x y</p></body>',
    '<div id="content-with-sidebar"><article class="post tag-search comments-open"><p>x y</p></article></div>',
    '<main class="related"><p>x y</p></main>', '<body><form id="f"><div class="page"><p>x y</p></div></form></body>',
    '<div><form><article>x y</article></form></div>', '<div class="social"><main>x y</main></div>', '<div class="with-ad">x y</div>',
    '<article>x y<div class="comments"><article class="comment">no</article></div></article>',
    '<main><article>x <i class="no-ad">y</i></article><div id="comments"><article>no</article></div></main>',
])
def test_names_of_whole_pages_are_no_furniture(body):
    kept = [b for b in blocks_of(body) if not b.furniture]
    assert " ".join(b.text() for b in main_blocks(kept) or kept) == "x y"


def test_template_of_a_host_without_articles(spark):
    rows = []
    for i in range(8):
        body = f"<div class='top'>Our site</div><div class='links'><a href='a'>news {i}</a> <a href='b'>more {i}</a></div><div class='x'><h2>Title {i}</h2><p>Words of page {i}.</p></div><div class='end'>All rights</div>"
        rows.append((i, "http://plain.example/" + str(i), page(body), "p", "f"))
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i} Words of page {i}." for i in range(8)}


def test_template_texts_among_paragraphs(spark):
    """A fixed text goes, in an article too, though its path is that of paragraphs; copies and common lines stay."""
    rows, want = [], {}
    for i in range(12):
        line = ["A line of some pages."] if i < 5 else []
        own = [f"Story {i} begins." if i > 3 else "One story in four copies.", *line, f"It ends {i} times."]
        inner = "".join(f"<p>{x}</p>" for x in ["Fixed notice.", *own, "Read us again."])
        for host, tag in (("plain", "div"), ("marked", "article"), ("mained", "main")):
            at = len(rows)
            rows.append((at, f"http://{host}.example/{i}", page(f"<div><{tag}>{inner}</{tag}></div>"), "p", "f"))
            want[at] = " ".join(own)
        at = len(rows)
        rows.append((at, f"http://mirror.example/{i}", page("<article><p>Same text.</p></article>"), "p", "f"))
        want[at] = "Same text."
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_every_character_of_an_article_is_kept(spark, folder):
    got = main_texts(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    import html as entities

    for r in got:
        inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        want = " ".join(entities.unescape(x) for x in re.split(r"<[^>]*>", inner))
        assert r["text"] == " ".join(want.split())


def test_long_page():
    source = "<article>" + "<p>word " * 50000 + "</article>"
    assert len(blocks_of(source)) == 50000


# archives


def archive_rows():
    trap = f"x{warc.MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{warc.MAGIC}"
    return [
        (1, "http://a/ b", "<p>é</p>"), (2, None, ""), (3, "u\r\nx: y", None), (4, "u", "<p>é</p>"), (5, "u", trap), (6, "u", trap * 3 + "tail"),
        (7, "u", warc.MAGIC), (8, "u", "a\r\n\r\nb\r\n\r\n"), (9, "u", "long " * 60000), (10, "u", trap), (4, "u", "<p>é</p>"), (11, "u", "\r\n"), (12, "u", "🙂" * 10),
        (None, "u", "only"), (None, "u", "<p>é</p>"),
    ]


@pytest.mark.parametrize("records,split", [(20000, "128m"), (3, "4k"), (20000, "2k")])
def test_archives_round_trip(spark, records, split):
    rows = archive_rows()
    folder = scratch_path(spark, "archives")
    pages = spark.createDataFrame([(*r, "p", "f") for r in rows], PAGES).coalesce(2)
    warc.write_archives(pages, folder, records_per_file=records)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archives(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h in first and first[h] != i
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((i, "revisit" if again else "response", first[h] if again else None, digest, "" if again else h))
    assert as_text((r["page_id"], r["record_type"], r["refers_to"], r["declared_digest"], r["payload"]) for r in got) == as_text(want)
    assert all(r["digest"] == r["declared_digest"] for r in got if r["record_type"] == "response")
    assert {r["page_id"]: r["url"] for r in got}[1] == "http://a/%20b"


def test_archive_query_rows(spark):
    rows = [r for r in archive_rows() if r[0] is not None]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "p", "f") for r in rows], PAGES), scratch_path(spark, "archives")).collect()
    sizes = {i: len((h or "").encode()) for i, _, h in rows}
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == sorted((i, sizes[i]) for i, *_ in rows)
    empty = warc.archive_round_trip(spark.createDataFrame([], PAGES), scratch_path(spark, "archives"))
    assert empty.collect() == []


def test_archive_with_damage(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    good = record.format(1, 3, "abc")
    (tmp_path / "a.warc").write_bytes((good + record.format(2, 5, "hello") + record.format(3, 99, "short")).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + good).encode())
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2]


# toxicity


def test_toxicity_learns_words_and_stems(make_docs, spark):
    draw = random.Random(7)
    plain = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("lo", "mi", "na", "ru", "ta", "ve")]
    rows, labels = [], []
    for i in range(1500):
        words = [draw.choice(plain) for _ in range(draw.randrange(10, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[draw.randrange(len(words))] = draw.choice(["zlurp", "vexor" + draw.choice(plain), "gr0k"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    rows += [(5000, None), (5001, ""), (None, "zlurp zlurp"), (0, rows[0][1]), (5002, "balo " * 40000)]
    labels += [(3, None, "x"), (None, 1, "x"), (4, 0, "x")]
    got = toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int, score string")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1500]
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert len(held) > 300 and right / len(held) > 0.97
    assert not any(r["predicted"] for r in got if r["doc_id"] in (5000, 5001, 5002))


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs([(1, "a"), (2, None)])
    assert [r["score"] for r in toxicity(docs, none).collect()] == [0.0, 0.0]
    one_kind = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, one_kind).collect()} == {1.0}
    assert toxicity(make_docs([]), none).collect() == []


def test_features():
    facts = TokenFacts({"=idiot": 6.0, "scum": 4.0})
    f = dict(zip(FEATURES, features_of("You IDIOT! what scumbag 1d10t!!", facts)))
    assert f["strong_count"] > 0 and f["near_rate"] > 0 and f["capital_words"] == 0.2 and f["disguised_rate"] == 0.2 and f["hit_count"] == np.log1p(3)
    assert features_of(None, facts) == [0.0] * len(FEATURES)


# sharding


def test_shards_follow_the_mixture(make_docs):
    draw = random.Random(4)
    rows = [(i, f"text {i % 50}" if i % 9 else None, "en", draw.choice(["big"] * 6 + ["a", "b", None])) for i in range(997)] + [(3, "same", "en", "a")] * 4
    got = interleaved_shards(make_docs(rows), shards=40).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    text = {i: t or "" for i, t, *_ in rows[:997]}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]].encode())) for r in got if r["doc_id"] != 3)
    source = {i: s for i, _, _, s in rows[:997]}
    for name in ("big", "a", "b", None):
        each = [sum(source[r["doc_id"]] == name for r in x) for x in by.values()]
        assert max(each) - min(each) <= 2 + 4 * (name == "a")
    again = interleaved_shards(make_docs(rows[::-1]), shards=40).collect()
    assert as_text(tuple(r) for r in again) == as_text(tuple(r) for r in got)


def test_shards_of_little(make_docs):
    assert interleaved_shards(make_docs([])).collect() == []
    got = interleaved_shards(make_docs([(1, "é", "en", None), (None, None, None, None)]), shards=5).collect()
    assert sorted(r["size"] for r in got) == [16, 18] and all(r["slot"] == 0 for r in got)


# mixing


def plain_rake(cells, targets, rounds=500):
    w = dict(cells)
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    for _ in range(rounds):
        for at, target in enumerate(targets):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[at]] += v
            w = {k: v * target[k[at]] / sums[k[at]] for k, v in w.items()}
    return {k: v / (cells[k] / total) for k, v in w.items()}


def mixing_rows():
    draw = random.Random(8)
    rows = []
    for i in range(900):
        text = " ".join(["w"] * draw.randrange(1, 80))
        text = text.upper() if draw.random() < 0.3 else "a | b " + text if draw.random() < 0.2 else text
        rows.append((i, text, draw.choice(["en", "en", "de", None]), draw.choice(["hot"] * 5 + ["x", "y"])))
    return rows


def test_weights_equal_plain_raking(make_docs):
    rows = mixing_rows() + [(None, "w w", "en", "x"), (5, *mixing_rows()[5][1:])]
    targets = {"lang": {"en": 2.0, "de": 1.0, None: 1.0, "absent": 5.0}}
    got = mixture(make_docs(rows), targets=targets).collect()
    cells, facets = defaultdict(int), [defaultdict(int) for _ in range(3)]
    for r in got:
        key = (r["source"], r["lang"], r["topic"])
        cells[key] += r["tokens"]
        for held, value in zip(facets, key):
            held[value] += r["tokens"]
    assert sorted(r["tokens"] for r in got) == sorted(len(r[1].split()) for r in rows)

    def share(weights):
        return {k: v / sum(weights.values()) for k, v in weights.items()}

    want = plain_rake(cells, [share({k: v ** TEMPER["source"] for k, v in facets[0].items()}), share({"en": 2, "de": 1, None: 1}), share({k: v ** TEMPER["topic"] for k, v in facets[2].items()})])
    for r in got:
        assert r["weight"] == pytest.approx(want[(r["source"], r["lang"], r["topic"])], rel=1e-3)
        assert r["probability"] == pytest.approx(r["weight"] / max(want.values()), rel=1e-3)
    chosen = [r for r in got if r["selected"]]
    expected = sum(r["probability"] for r in got)
    assert abs(len(chosen) - expected) < 5 * expected**0.5


def test_mixture_of_a_stated_size(make_docs):
    got = mixture(make_docs(mixing_rows()), size=0.8).collect()
    total = sum(r["tokens"] for r in got)
    assert sum(r["tokens"] * r["probability"] for r in got) == pytest.approx(0.8 * total, rel=1e-6)
    assert max(r["probability"] for r in got) == 1


def test_mixture_of_little(make_docs):
    assert mixture(make_docs([])).collect() == []
    assert [(r["tokens"], r["selected"]) for r in mixture(make_docs([(1, None), (2, " ")])).collect()] == [(0, False)] * 2


def test_few_cells_are_raked_without_shuffles_and_many_alike(make_docs, monkeypatch):
    real, plans = mixing.materialise, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    def weights():
        plans.clear()
        return {r["doc_id"]: r["weight"] for r in mixture(make_docs(mixing_rows())).collect()}

    monkeypatch.setattr(mixing, "materialise", noted)
    together = weights()
    rounds = [plan for plan in plans if "_gap" in plan]
    assert len(rounds) > 1 and not any("Exchange" in plan for plan in rounds)
    monkeypatch.setattr(mixing, "CELLS_TOGETHER", 5)
    assert weights() == pytest.approx(together) and any("Exchange" in plan for plan in plans if "_gap" in plan)


# packing


@pytest.mark.parametrize("shard_tokens", [1_000_000, 3000])
def test_packing_is_whole(make_docs, odd_texts, shard_tokens):
    got = packing.retrieval_packing(make_docs([(i, t) for i, t in odd_texts]), tokenizer_path(), window=256, shard_tokens=shard_tokens).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for i, t in odd_texts:
        want[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 2])
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 256 or at & (at - 1) == 0
    for i, pieces in by_doc.items():
        told = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces)
        if len(want[i]) > 1:  # rows that share an id
            assert sum(p[1] for p in told) == sum(map(len, want[i]))
            continue
        ids, at = want[i][0], 0
        for start, length, crc, total in told:
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert set(by_doc) == set(want)


def test_word_ids_equal_the_tokenizer():
    draw = random.Random(5)
    signs = ["a", "É", "é", "ß", "Σ", "ς", "1", "٣", "'s", "'", "!", " ", " ", "\x1c", "\x85", "\t", "\r", "\x0b", " ", " ", "文", "🙂", "́", "<|endoftext|>", "<|startoftext|>", "İ", "ǅ"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(3000)] + ["", None]
    whole = Tokenizer.from_file(tokenizer_path())
    texts += ["Don't a-'s we'll!'ve x'd ok.it's", "ÀÉ ßÿ÷ø þ 12ab34 a1", "<|ENDOFTEXT|> <|endoftext|>x", "thed$$$ a\u0301b e\u0301 \u00e9\u0301", "ñ" * 40]
    for text, ids in zip(texts, packing.WordIds(tokenizer_path()).of(pa.array(texts, pa.string()))):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_neighbours_are_lexically_close():
    draw = np.random.default_rng(0)
    docs = [draw.integers(100 * (i % 4), 100 * (i % 4) + 60, 50).astype(np.uint32) for i in range(80)]
    frequency = np.zeros(500)
    for d in docs:
        frequency[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - frequency + 0.5) / (frequency + 0.5))
    held = defaultdict(set)
    for doc, _, _, sequence, _ in packing.pack_shard(docs, idf, 50.0, 200):
        held[sequence].add(doc % 4)
    assert np.mean([len(x) for x in held.values()]) < 1.5


def test_related_documents_meet_across_the_corpus(make_docs):
    """The best neighbour by brute-force BM25 over all documents lies in the same shard, wherever the input has it."""
    draw = random.Random(12)
    letters = "bcdfghjklmnpqrstvwz"
    own = [["".join(draw.choice(letters) for _ in range(6)) for _ in range(30)] for _ in range(60)]
    rows = []
    for i in range(240):
        rows.append((i, " ".join(draw.choice(own[i % 60]) if draw.random() < 0.4 else draw.choice(["common", "words", "stand", "here"]) for _ in range(60))))
    draw.shuffle(rows)
    got = packing.retrieval_packing(make_docs(rows), tokenizer_path(), window=256, shard_tokens=3000).collect()
    shard = {r["doc_id"]: r["sequence_id"] >> 32 for r in got}
    ids = [np.append(x, 2).astype(np.int64) for x in packing.WordIds(tokenizer_path()).of(pa.array([t for _, t in rows]))]
    frequency = np.zeros(1 + max(x.max() for x in ids))
    for x in ids:
        frequency[np.unique(x)] += 1
    idf = np.log(1 + (len(ids) - frequency + 0.5) / (frequency + 0.5))
    index = packing.Bm25(ids, idf, np.mean([len(x) for x in ids]))
    met = 0
    for at, (i, _) in enumerate(rows):
        scores = index.scores(at)
        scores[at] = -1
        met += shard[i] == shard[rows[int(scores.argmax())][0]]
    assert len(set(shard.values())) > 5 and met / len(rows) > 0.9


def test_rows_that_share_an_id_are_spread(make_docs):
    got = packing.retrieval_packing(make_docs([(None, "")] * 500), tokenizer_path(), window=16, shard_tokens=50).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["sequence_id"] >> 32] += r["length"]
    assert sum(sizes.values()) == 500 and max(sizes.values()) <= 60


def test_packing_of_nothing(make_docs):
    assert packing.retrieval_packing(make_docs([]), tokenizer_path()).collect() == []
    assert [tuple(r)[:5] for r in packing.retrieval_packing(make_docs([(9, None)]), tokenizer_path()).collect()] == [(9, 0, 1, zlib.crc32(b"\2\0\0\0"), 1)]


def test_tables_of_the_search_are_deleted(make_docs):
    """Postings and edges have left the shared folder when shards are known; sketches take two bytes a term and two a weight."""
    docs = make_docs([(i, f"w{i % 7} w{i % 11} w{i % 13} all") for i in range(60)])
    spark = docs.sparkSession
    tokens = packing.materialise(packing.token_table(docs, tokenizer_path()).withColumn("row", packing.F.monotonically_increasing_id()))
    frequency = np.full(49_153, 2.0)
    idf = np.log(1 + (60 - frequency + 0.5) / (frequency + 0.5))
    width = tokens.select("row", "ids").mapInArrow(packing._postings(idf, 9.0, frequency), "term long, near long, next long, row long, sketch binary")
    assert {len(r[0]) for r in width.select("sketch").collect()} == {4 * packing.SKETCH_TERMS}
    made = []
    real = packing.materialise
    try:
        packing.materialise = lambda df: made.append(real(df)) or made[-1]
        shards = packing._shards(tokens, idf, 9.0, frequency, 50)
    finally:
        packing.materialise = real
    files = [t.inputFiles() for t in made[:2]]  # the listing is of the time of writing
    assert ["sketch" in t.columns for t in made[:2]] == [True, False] and all(files)
    assert not any(os.path.exists(f.removeprefix("file:")) for names in files for f in names)
    assert shards.count() == 60 and spark.read.parquet(tokens.inputFiles()[0]).count() > 0


def test_large_vocabularies_keep_their_term_of_two_bytes():
    """A term 65535 of a large vocabulary is not taken for a place without a term."""
    for size, other in ((50_000, 49_999), (70_000, 65_535)):
        kind = packing._id_kind(np.zeros(size))
        none = np.iinfo(np.dtype(kind)).max
        ids = np.full((packing.SKETCH_TERMS, 2), none, kind)
        ids[:2] = [[7, 7], [other, 8]]
        weight = np.zeros((2, packing.SKETCH_TERMS), np.float32)
        weight[:, :2] = [[1, 2], [4, 8]]
        assert packing._common_weight(ids[:, :1], weight[:1], ids[:, 1:], weight[1:]).tolist() == [5.0]
