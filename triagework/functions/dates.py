"""Calendar parts of the submission date."""

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Tried in this order after the ISO forms; where day and month could be either, the month comes first.
DATE_FORMATS = [
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "MMM d[,] yyyy[ H:mm[:ss]]",
    "MMMM d[,] yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
]


def parse_submission(text: Column) -> Column:
    """Timestamp of a date text, null where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Year, month, day, weekday (Monday = 0) and hour; 0 for an unknown date."""
    zero = F.lit(0)
    return {
        "Submission_Year": F.coalesce(F.year(ts), zero),
        "Submission_Month": F.coalesce(F.month(ts), zero),
        "Submission_Day": F.coalesce(F.dayofmonth(ts), zero),
        "Submission_DayOfWeek": F.coalesce(F.weekday(ts), zero),
        "Submission_Hour": F.coalesce(F.hour(ts), zero),
    }


def regression_parts(ts: Column) -> dict[str, Column]:
    """Hour, weekday and month with the regression job's defaults: noon, Monday, January."""
    return {
        "submission_hour": F.coalesce(F.hour(ts), F.lit(12)),
        "submission_dayofweek": F.coalesce(F.weekday(ts), F.lit(0)),
        "submission_month": F.coalesce(F.month(ts), F.lit(1)),
    }
