"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, slices
from tidemark.session import materialise

#: Labelled rows the model is fitted on, at most: the smallest hashes of their ids.
FIT_ROWS = 20000
#: Terms of the lexicon, documents of label 1 that a term needs, and its least log odds ratio.
LEXICON_TERMS = 4000
TERM_DOCUMENTS = 3
TERM_ODDS = 2.0
#: Lengths of the word beginnings that count as terms beside whole words.
STEMS = (4, 5, 6, 7)
#: Words between a lexicon word and a second-person word that still count as near.
NEAR_WORDS = 5
#: Share of the uncalibrated probability in the score; it orders texts that calibration puts level.
ORDER_SHARE = 0.02
#: Score from which a text is predicted toxic.
THRESHOLD = 0.7
CACHE_WORDS = 150_000

# fixed values: second-person words of the languages at hand
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros vuestro".split()
)
# fixed values: signs written in place of letters
DISGUISE = str.maketrans("013457@$!", "oieastasi")

FEATURES = (
    "strong_rate", "middle_rate", "weak_rate", "strong_count", "hit_count", "distinct_hits", "greatest_odds", "odds_rate", "near_rate",
    "second_rate", "capital_words", "capital_letters", "punctuation", "exclamations", "disguised_rate", "words", "word_length",
)

_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$*#!]+[^\W\d_]|(?:[^\W\d_][.*_-]){3,}")


def terms_of(word: str) -> list[str]:
    """The whole word and its beginnings, as lexicon terms."""
    return ["=" + word, *[word[:n] for n in STEMS if len(word) >= n]]


def _plain(token: str) -> list[str]:
    return _LETTERS.findall(token.lower())


def _revealed(token: str) -> str:
    return "".join(_LETTERS.findall(token.lower().strip("!?.,;:").translate(DISGUISE)))


class TokenFacts(dict):
    """Facts about a white-space token: odds, second person, capitals, letters, capital letters, signs, '!', disguise."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.table = np.zeros((CACHE_WORDS // 4, 8))

    def __missing__(self, token: str) -> int:
        capitals = 0 if token.islower() else sum(map(str.isupper, token))
        hidden = 0.0
        if token.isalpha():  # most tokens: one word and nothing else
            words, letters, signs = [token.lower()], len(token), 0
        else:
            words = _plain(token)
            letters, signs = sum(map(len, words)), len(token) - sum(map(str.isalnum, token))
            hidden = float(_MIXED.search(token) is not None)
        odds = max(map(self.odds, words), default=0.0)
        if hidden:
            odds = max(odds, self.odds(_revealed(token)))
        second = float(not SECOND_PERSON.isdisjoint(words))
        shouted = float(letters > 1 and capitals == letters)
        at = len(self)
        self[token] = at
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = (odds, second, shouted, letters, capitals, signs, token.count("!") if signs else 0, hidden)
        return at

    def odds(self, word: str) -> float:
        known = self.lexicon.get
        return max([known(t, 0.0) for t in terms_of(word)]) if word else 0.0

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def features_of(text: str | None, facts: TokenFacts) -> list[float]:
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(FEATURES)
    at = np.fromiter(map(facts.__getitem__, tokens), np.int64, len(tokens))
    table = facts.table[at]
    sums = table.sum(0)
    odds = table[:, 0]
    n, letters = len(tokens), max(1.0, sums[3])
    spots = np.flatnonzero(odds)
    found = odds[spots]
    strong, middle = int((found >= 5).sum()), int(((found >= 3.5) & (found < 5)).sum())
    near = 0
    if len(spots) and sums[1]:
        second = np.flatnonzero(table[:, 1])
        place = np.searchsorted(second, spots)
        before = spots - second[np.maximum(place - 1, 0)]
        after = second[np.minimum(place, len(second) - 1)] - spots
        near = int(((np.abs(before) <= NEAR_WORDS) | (np.abs(after) <= NEAR_WORDS)).sum())
    return [
        strong / n, middle / n, (len(spots) - strong - middle) / n, np.log1p(strong), np.log1p(len(spots)),
        np.log1p(len(set(at[spots].tolist()))), found.max(initial=0.0), sums[0] / n, near / n, sums[1] / n, sums[2] / n,
        sums[4] / letters, sums[5] / (letters + sums[5]), sums[6] / n, sums[7] / n, np.log1p(n), letters / n,
    ]


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Documents per term, half and label; one row per task, term and half."""
    seen: list[list[Counter]] = [[Counter(), Counter()], [Counter(), Counter()]]

    def told():
        for half in (0, 1):
            terms = sorted(set(seen[half][0]) | set(seen[half][1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([half] * len(terms), pa.int32()), pa.array([seen[half][1][t] for t in terms], pa.int64()), pa.array([seen[half][0][t] for t in terms], pa.int64())],
                ["term", "half", "toxic", "clean"],
            )
            seen[half] = [Counter(), Counter()]

    for batch in slices(batches):
        for text, half, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = {w for token in set((text or "").split()) for w in _plain(token)}
            seen[half][label].update({t for w in words for t in terms_of(w)})
        if sum(len(c) for pair in seen for c in pair) > 2 * CACHE_WORDS:
            yield from told()
    yield from told()


def _lexicon(counts: DataFrame, totals: dict[int, tuple[int, int]], halves: tuple[int, ...]) -> dict[str, float]:
    """Log odds ratio, less its standard error, of the terms that mark label 1 in the given halves."""
    toxic, clean = (sum(totals.get(h, (0, 0))[i] for h in halves) for i in (0, 1))
    sums = counts.where(F.col("half").isin(*halves)).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= TERM_DOCUMENTS)
    half = F.lit(0.5)
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + half) / (F.lit(toxic) - t + half)) - F.log((c + half) / (F.lit(clean) - c + half))
    doubt = F.sqrt(1 / (t + half) + 1 / (c + half))
    ranked = sums.select("term", (odds - doubt).alias("odds"), "t").where(F.col("odds") >= TERM_ODDS)
    return {r["term"]: r["odds"] for r in ranked.orderBy(F.desc("odds"), F.desc("t"), "term").limit(LEXICON_TERMS).collect()}


def _featured(lexicons: list[dict[str, float]], names: list[str]):
    def mapped(batches) -> Iterator[pa.RecordBatch]:
        facts = [TokenFacts(x) for x in lexicons]
        for batch in slices(batches):
            which = batch.column(1).to_pylist()
            made = [features_of(t, facts[w]) for t, w in zip(batch.column(0).to_pylist(), which)]
            for f in facts:
                f.trim()
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), *[batch.column(i) for i in range(1, batch.num_columns)]], ["dense", *names])

    return mapped


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class ToxicityModel:
    """A fitted lexicon, trees and calibration; `share` alone when there was nothing to tell apart."""

    def __init__(self, lexicon=None, trees=None, calibration=None, share: float = 0.0) -> None:
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, score of every row."""
        rows = docs.select(F.col(text).cast("string").alias("text"), F.lit(0).alias("which"), F.col(id_column).cast("long").alias("doc_id"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(float(self.share)).alias("score"))
        dense = rows.mapInArrow(_featured([self.lexicon], ["which", "doc_id"]), "dense array<double>, which int, doc_id long")
        scored = _margins(self.trees, dense)
        level = self.calibration.transform(scored).withColumn("level", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
        return level.select("doc_id", ((1 - ORDER_SHARE) * F.col("level") + ORDER_SHARE * F.col("probable")).alias("score"))


def _margins(trees, dense: DataFrame) -> DataFrame:
    made = trees.transform(dense.withColumn("features", array_to_vector("dense")))
    return made.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumn("probable", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> ToxicityModel:
    """Learn from the labelled rows that are not held out, at most `fit_rows` of them.

    Lexicon odds count documents of the sample by label. Features of a sampled text use the lexicon of the
    other half of the sample, so that the trees see terms as they occur in new texts. A quarter of the sample calibrates
    the trees and does not grow them. Halves and quarters are drawn by a hash of the text: copies stay together.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = materialise(
        known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("text")), F.lit(4)).cast("int")
    rows = materialise(  # the drawn labels are at most fit_rows short rows
        texts.join(F.broadcast(drawn), "doc_id").select("text", "label", draw.alias("quarter"))
    )
    sums = rows.groupBy(F.pmod("quarter", F.lit(2)).alias("half")).agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()
    totals = {r["half"]: (r["t"], r["c"]) for r in sums}
    toxic, clean = (sum(x[i] for x in totals.values()) for i in (0, 1))
    if not toxic or not clean:
        return ToxicityModel(share=toxic / max(1, toxic + clean))
    counts = materialise(
        rows.select("text", F.pmod("quarter", F.lit(2)).alias("half"), "label").mapInArrow(_counted, "term string, half int, toxic long, clean long")
        .groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    across = [_lexicon(counts, totals, (1 - h,)) for h in (0, 1)]
    dense = materialise(
        rows.select("text", F.pmod("quarter", F.lit(2)).alias("which"), "quarter", "label")
        .mapInArrow(_featured(across, ["which", "quarter", "label"]), "dense array<double>, which int, quarter int, label int")
    )
    vectors = dense.withColumn("features", array_to_vector("dense"))
    growing = vectors.where("quarter < 3")
    if growing.select("label").distinct().count() < 2:
        growing = vectors
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=25, maxDepth=3, stepSize=0.3, seed=seed).fit(growing)
    level = _margins(trees, dense)
    held = level.where("quarter = 3")
    if held.select("label").distinct().count() < 2:
        held = level
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held.select("margin", F.col("label").cast("double").alias("label")))
    return ToxicityModel(_lexicon(counts, totals, (0, 1)), trees, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text), learned from `labels` (doc_id, toxic).

    Only the text enters a score. A null text scores as an empty one. Labels that are null or lie on held-out
    ids are not read; an id with several labels counts as toxic if one of them is. Without labels of both kinds every score is
    the share of label 1, 0 without any. Rows without an id are scored and not held out; repeated rows are all
    returned; an empty table gives an empty table. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    scored = fit_toxicity(docs, labels, fit_rows).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
