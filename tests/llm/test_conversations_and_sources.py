"""Prefix trie, chat formatting and source divergence against plain versions, on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark.llm import chat, divergence, trie
from tidemark.session import materialise

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("near", T.DoubleType()),
    ]
)


@pytest.fixture(scope="session")
def make_turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1.0) for r in rows], TURNS)

    return make


def ordered(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in talks.items()}


def plain_trie(talks):
    nodes = defaultdict(list)
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    kids = Counter(k[:-1] for k in nodes if k)
    own = {k: (len(v) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, v in nodes.items()}
    saved, leaves = Counter(), Counter()
    for k in nodes:
        for d in range(len(k) + 1):
            saved[k[:d]] += own[k]
            leaves[k[:d]] += kids[k] == 0
    out = set()
    for k, v in nodes.items():
        ends = sorted(c for c in v if len(talks[c]) == len(k))
        out.add((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), kids[k], leaves[k], saved[k],
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def splice(talks, every=20):
    out = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        near = c - (c % every if c >= 0 else -(-c % every))
        out[c] = talks.get(near, [])[:h] + turns[h:]
    return out


def odd_talks(seed=5, size=400):
    draw = random.Random(seed)
    rows = []
    for c in range(-5, size):
        if draw.random() < 0.05:
            continue
        length = 60 if c == 33 else draw.choice([1, 1, 2, 3, 5, 20])
        shared = draw.random() < 0.4
        for turn in range(length):
            text = draw.choice(["same words here", "", None, "a  b\tc", f"own {draw.randrange(6)} words"])
            rows.append((c, turn, draw.choice(["user", "assistant", None, "u"]) if not shared else "user", "hot turn of four" if shared else text))
    rows += [(7, None, "system", "first by null"), (None, 1, "user", "nobody"), (None, None, None, None), (900, 0, "a", "bc"), (901, 0, "ab", "c")]
    rows += [(1000 + i, 0, "user", "all alike") for i in range(120)]
    draw.shuffle(rows)
    return rows


def nodes_of(df):
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()]


@pytest.mark.parametrize("shard_turns", [40, 10**6])
def test_trie_of_odd_conversations(make_turns, shard_turns, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    rows = odd_talks()
    got = nodes_of(trie.prefix_trie(trie.turn_sequences(make_turns(rows)), shard_turns))
    want = plain_trie(ordered(rows))
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("shard_turns", [25, 10**6])
def test_trie_of_spliced_conversations(make_turns, shard_turns):
    rows = odd_talks(8, 250)
    got = nodes_of(trie.prefix_trie(trie.spliced(make_turns(rows)), shard_turns))
    want = plain_trie(splice(ordered(rows)))
    assert len(got) == len(want) and set(got) == want
    assert any(len(turns) == 0 for turns in splice(ordered(rows)).values())


def test_trie_of_nothing_and_of_turnless_conversations(make_turns):
    assert trie.prefix_trie(trie.spliced(make_turns([]))).collect() == []
    assert trie.prefix_trie(trie.spliced(make_turns([(None, 0, "user", "x")]))).collect() == []
    # 21 has no first conversation, and its only turn lies within the replaced ones
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    got = nodes_of(trie.prefix_trie(trie.spliced(make_turns([(alone, 0, "user", "x")]))))
    assert got == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_levels_do_not_depend_on_the_band():
    draw = np.random.default_rng(4)
    lengths = draw.integers(0, 9, 60)
    codes = draw.integers(1, 4, lengths.sum())
    words = codes * 2  # equal turns have equal words
    conv = draw.permutation(60)
    wide, narrow = (trie.shard_levels(conv, lengths, codes, words, band) for band in (16, 2))
    for a, b in zip(wide, narrow, strict=True):
        assert all(np.array_equal(a[k], b[k]) for k in a)


# ---- chat formatting ----------------------------------------------------------------------

PIECES = st.sampled_from(["<", "[", "\\", "/", "s>", "<s>", "</s>", "[INST]", "[/INST]", "INST]", "[/TURN]", "[ROLE]", "x", "é", "🙂", "\n", " "])
TEXTS = st.lists(PIECES, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]", "<s>"]) | TEXTS, TEXTS), max_size=6))
def test_every_conversation_reads_back(turns):
    made = chat.compile_template()([{"role": r, "text": t} for r, t in turns])
    text = "".join(made.parts)
    assert len(text) == made.size
    assert chat.read_turns(text) == turns
    guard = chat.Guard(chat.CONTROLS)
    assert "".join(guard.undo(text[a:b]) for a, b in made.learned) == "".join(t for r, t in turns if r == "assistant")


@given(TEXTS)
def test_a_guarded_text_holds_no_control_string(text):
    guarded = chat.Guard(chat.CONTROLS)(text)
    assert not any(c in guarded for c in chat.CONTROLS)
    assert chat.Guard(chat.CONTROLS).undo(guarded) == text


def test_templates_fold_and_choose():
    source = "{% if 'a' == 'a' and not false %}<s>{{ 'x' ~ 1 | guard }}</s>{% else %}never{% endif %}{# note #}"
    filters = {**chat.FILTERS, "guard": chat.Guard(chat.CONTROLS)}
    tree = chat.fold(chat.parse(source, (), filters), filters)
    assert [(p.kind, p.value) for p in tree.parts] == [("text", "<s>x1</s>")]
    loop = "{% for t in turns %}{% if loop.first %}[INST]{% elif not loop.last or t.role != 'b' %}-{% else %}.{% endif %}{{ t.text | trim | guard }}{{ name | guard }}{% endfor %}"
    render = chat.compile_template(loop, values=("name",))
    made = render([{"role": "a", "text": " 1 "}, {"role": "b", "text": "<s>"}, {"role": "b", "text": "3"}], name="N")
    assert "".join(made.parts) == "[INST]1N-<\\s>N.3N"


@pytest.mark.parametrize(
    "source",
    [
        "{{ turns }}", "{{ secret | guard }}", "{% for t in turns %}{{ t.__class__ | guard }}{% endfor %}", "{% for t in turns %}{{ t.text }}{% endfor %}",
        "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}", "{% for t in turns %}", "{% if 'a' %}{% endfor %}", "{% import os %}",
        "{{ 'a'.upper() | guard }}", "{{ 'a' | eval | guard }}", "less < than", "{{ 'x' | guard }} [", "{% if 'a' %}{% else %}{% else %}{% endif %}",
        "{% for turns in turns %}{% endfor %}", "{{ }}", "{% for t in turns %}{% endfor %}{{ t.text | guard }}",
    ],
)
def test_templates_stay_in_the_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_control_strings_that_cannot_be_guarded():
    for controls in (("<s>", "s<"), ("<",), ("a\\b",)):
        with pytest.raises(chat.TemplateError):
            chat.compile_template("", controls)


def test_formatting_of_odd_conversations(make_turns):
    long = "word <s> [INST] " * 60_000
    rows = [
        (1, 1, "assistant", "</s> \\"), (1, 0, "user", "[INST] hi"), (1, None, "system", "<\\\\s>"), (2, 0, "assistant", None), (2, 0, "assistant", None),
        (3, 0, None, long), (3, 1, "assistant", long), (None, 0, "user", "left out"), (4, 2, "assistant", "b"), (4, 2, "assistant", "a"), (5, 0, "tool", ""),
    ]
    made = materialise(chat.formatted_chats(make_turns(rows)))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in made.collect()}
    talks = ordered(rows)
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(texts[conv]))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted_chats(make_turns([]))).collect() == []


# ---- source divergence --------------------------------------------------------------------

def plain_divergence(rows, least=3, top=200):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)

    docs = [(r[2] or "", r[3] or "", terms(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if t in kept)
        whole = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        for s in p:
            found = {"pair": [], "term": []}
            for o in p:
                if o != s:
                    found["pair"].append((sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o))
            found["term"] = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(items, 1) if part == "pair" or n <= top]
    return sorted(out)


def odd_documents(seed=3):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünï", "文字", "Same", "SAME", "É"]
    rows = []
    for i in range(240):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s0", "s0", "s0", "s1", "s2", None, f"rare{i % 7}"])
        size = draw.choice([0, 1, 30, 200])
        rows.append((i, " ".join(draw.choice(words[: draw.choice([3, 40, 305])]) for _ in range(size)), lang, source))
    rows += [(1, None, "fr", "s0"), (1, "", "fr", "s1"), (None, "once only", "fr", None), (5, "x" * 70_000 + " same-same_same9same", "en", "s0")] + rows[:3]
    return rows


@pytest.mark.parametrize("met", [64, 2])
def test_divergence_of_odd_documents(make_docs, met):
    rows = odd_documents()
    made = divergence.divergence(make_docs([]).union(make_docs(rows)), top=20, met=met, held=50)
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in made.collect())
    want = plain_divergence([(r[0], r[1], r[2], r[3]) for r in rows], top=20)
    assert got == want


def test_divergence_of_nothing(make_docs):
    assert divergence.divergence(make_docs([])).collect() == []


def test_shares_are_exact_beyond_longs(spark):
    row = spark.range(1).selectExpr("90000000000000L n", "90000000000123L w").select(divergence.share(trie.F.col("n"), trie.F.col("w")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (90000000000000 + 1) // 90000000000123


def test_term_sums_are_dealt_once(make_docs):
    """One shuffle by language and term, and no hash table of a task's sums before it."""
    by_term = divergence.Window.partitionBy("lang", "term")
    counts = divergence.term_counts(make_docs([(1, "b a a", "en", "x"), (2, "a", "en", "y")]))
    made = counts.withColumn("of_lang", divergence.F.sum("n").over(by_term))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" not in plan.split("Exchange hashpartitioning")[1]
    assert sorted(map(tuple, made.collect())) == [("en", "x", "a", 2, 1, 3), ("en", "x", "b", 1, 1, 1), ("en", "y", "a", 1, 1, 3)]
