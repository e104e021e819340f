"""Date and clock-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats found in the landed files.
FORMATS = {
    "iso_date": "yyyy-MM-dd",
    "news_clock": "ddMMMyyyy:HH:mm:ss.SSS",
    "us_date": "M/d/yyyy",
    "iso_clock": "yyyy-MM-dd HH:mm:ss",
    "compact_date": "yyyyMMdd",
}
MARKET_OPEN = "09:30:00"
MARKET_CLOSE = "16:30:00"


def parse_time(text: Column, style: str) -> Column:
    """Timestamp from text in one of the known styles; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(FORMATS[style]))


def parse_date(text: Column, style: str) -> Column:
    return F.to_date(parse_time(text, style))


def week_start_sunday(day: Column) -> Column:
    """First day of a Sunday-based week."""
    return F.date_sub(F.next_day(day, "Sun"), 7)


def week_end_monday(day: Column) -> Column:
    """The Monday that closes the week holding `day`; a Monday closes its own week."""
    return F.next_day(F.date_sub(day, 1), "Mon")


def month_start(day: Column) -> Column:
    return F.to_date(F.trunc(day, "MM"))


def month_end(day: Column) -> Column:
    return F.last_day(day)


def period_end(day: Column, freq: str) -> Column:
    return {"weekly": week_end_monday, "monthly": month_end}[freq](day)


def period_start(day: Column, freq: str) -> Column:
    return {"weekly": week_start_sunday, "monthly": month_start}[freq](day)


def market_session(moment: Column) -> Column:
    """Clock time against the trading day, both ends included in market hours.

    Compared to the sub-second, so 16:30:00.5 already counts as after the close.
    """
    clock = F.date_format(moment, "HH:mm:ss.SSSSSS")
    return (
        F.when(clock < MARKET_OPEN + ".000000", "pre_market_hours")
        .when(clock <= MARKET_CLOSE + ".000000", "market_hours")
        .when(clock.isNotNull(), "post_market_hours")
    )


def day_type(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "Weekend").when(day.isNotNull(), "Weekday")
