"""Text expressions over whole documents; everything but the scorer hook stays inside the JVM."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the scoring hook with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def long_lines(text: Column, at_least: int = 20) -> Column:
    """Stretches of at least so many characters within a line, joined by newlines."""
    runs = F.regexp_extract_all(text, F.lit(f"[^\\n]{{{at_least},}}"), F.lit(0))
    return F.array_join(runs, "\n")


def first_characters(text: Column, limit: int) -> Column:
    """The leading `limit` characters, for scorers with an input limit."""
    return F.substring(text, 1, limit)


def first_integer(text: Column) -> Column:
    digits = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def last_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n", -1), -1)


def sentences(text: Column) -> Column:
    """Non-empty stretches between sentence marks."""
    return F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")


def topic_sentences(text: Column, terms: Sequence[str]) -> Column:
    """Number of sentences holding at least one of the terms, in any letter case."""

    def hit(sentence: Column) -> Column:
        found = F.lit(False)
        for term in terms:
            found = found | sentence.contains(term.lower())
        return found

    return F.size(F.filter(sentences(F.lower(text)), hit))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def label_with(
    df: DataFrame, text: str, scorer: Callable[[pd.Series], pd.Series], out: str = "Sentiment"
) -> DataFrame:
    """Label every text with a scorer of the user's own, which sees Arrow batches of whole texts."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: scorer(batch[text])})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInPandas(label, schema)


def word_list_label(text: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """positive, negative or neutral by which list has more different words in the text."""
    found = words(text)
    ups = F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in good])))
    downs = F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in bad])))
    return (
        F.when(text.isNull(), None)
        .when(ups > downs, "positive")
        .when(ups < downs, "negative")
        .otherwise("neutral")
    )
