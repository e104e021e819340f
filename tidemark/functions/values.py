"""Number, lookup and band expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text as a double; letter codes and other bad values become null."""
    return text.cast("string").try_cast("double")


def digits_to_number(text: Column) -> Column:
    """Drop everything but digits and points, then convert."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, null where the denominator is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def lookup(key: Column, values: Mapping) -> Column:
    """Literal dictionary lookup; an unmapped key gives null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.try_element_at(pairs, key)


def band_label(rank: Column, labels: Sequence[str]) -> Column:
    """Name of a zero-based integer rank; null outside the labels."""
    return F.when(
        (rank >= 0) & (rank < len(labels)),
        F.element_at(F.array(*[F.lit(x) for x in labels]), (rank + 1).cast("int")),
    )


def even_labels(groups: int) -> list[str]:
    """Percent ranges for equal groups, such as 0-20%, 20-40%."""
    return [f"{100 * i // groups}-{100 * (i + 1) // groups}%" for i in range(groups)]


def at_least_one(count: Column) -> Column:
    """1 when the count is one or more, otherwise 0 (also for null)."""
    return F.coalesce((count >= 1).cast("int"), F.lit(0))


def industry(code: Column) -> Column:
    """Industry as the code divided by ten, rounded down."""
    return F.floor(code / 10)


def share(part: Column, whole: Column) -> Column:
    return ratio(part, whole)
