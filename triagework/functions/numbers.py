"""Rounding, clipping and the text form of an hour range."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagework.domain import NO_RANGE

RANGE_DASH = "–"


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to the even digit."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def log_hours(hours: Column) -> Column:
    return F.log1p(hours)


def unlog_hours(value: Column, low: float, high: float) -> Column:
    return clip(F.expm1(value), low, high)


def short_number(value: Column) -> Column:
    """Shortest text of a one-decimal number: no trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def range_text(low: Column, high: Column) -> Column:
    """``8–34.2 hours``, or ``Unavailable`` when there is no range."""
    text = F.concat(short_number(low), F.lit(RANGE_DASH), short_number(high), F.lit(" hours"))
    return F.coalesce(text, F.lit(NO_RANGE))


def parse_range(text: Column) -> tuple[Column, Column]:
    """Low and high hours of a range text; null where the text is not a range."""
    parts = F.split(F.regexp_replace(text, " hours", ""), RANGE_DASH)
    low, high = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    valid = low.isNotNull() & high.isNotNull()
    return F.when(valid, low), F.when(valid, high)
