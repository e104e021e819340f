"""Sentiment label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_label(text: Column) -> Column:
    """Free text to positive, negative or neutral, first match first; null stays null."""
    low = F.lower(text)
    return (
        F.when(text.isNull(), None)
        .when(low.contains("positive"), "positive")
        .when(low.contains("negative"), "negative")
        .otherwise("neutral")
    )


def mentions(text: Column, word: str) -> Column:
    """1 when the word occurs in any letter case, 0 otherwise and for null."""
    return F.coalesce(F.lower(text).contains(word.lower()).cast("int"), F.lit(0))


def label_counts(label: Column) -> dict[str, Column]:
    """Indicator columns of a normalised label."""
    return {
        "positive": F.coalesce((label == "positive").cast("int"), F.lit(0)),
        "negative": F.coalesce((label == "negative").cast("int"), F.lit(0)),
        "total": label.isNotNull().cast("int"),
    }


def last_true(flags: Sequence[tuple[Column, str]], empty: str = "") -> Column:
    """Name of the last flag equal to 1, as if each name overwrote the one before."""
    chosen = None
    for flag, name in reversed(flags):
        chosen = F.when(flag == 1, name) if chosen is None else chosen.when(flag == 1, name)
    return chosen.otherwise(empty)
