import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()

#: Documents with the columns of the driver's table and columns whose names the operators use inside.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("tokens", T.StringType()), T.StructField("shard", T.DoubleType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", f"s{(r[0] or 0) % 3}")), len(r[1] or ""), "x", "y", 1.0) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and long texts, copies, near copies, shared passages, other alphabets, repeated rows."""
    draw = random.Random(3)

    def prose(n, seed):
        own = random.Random(seed)
        return " ".join(f"{own.choice(WORDS)}{own.randrange(400)}" for _ in range(n))

    passage = prose(70, 1)
    base = prose(300, 2)
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, base.upper()),
        (9, prose(80, 5) + " " + passage + " " + prose(40, 6)), (10, passage), (11, prose(20, 7) + "\n" + passage + "\t" + prose(200, 8)),
        (12, " ".join(["again"] * 400)), (13, " ".join(["again"] * 170)), (14, prose(30000, 9)), (15, "Ünïcödé 文字 🙂 " * 30),
        (16, base.replace("alpha", "omega", 1)), (17, "\x1cgs\x1dfs \x85nel  em nbsp"), (6, base), (None, base), (None, None),
    ]
    for i in range(60):
        words = base.split()
        words[draw.randrange(len(words))] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    return rows
