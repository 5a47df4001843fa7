"""Routing: department, queue, ticket id and queue numbers."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagework.domain import DEFAULT_DEPARTMENT, DEFAULT_QUEUE, DEPARTMENT_OF, QUEUE_OF
from triagework.operators.ranks import global_row_number


def department_of(category: Column) -> Column:
    """Department of a category; unknown and missing categories go to general support."""
    return F.coalesce(_lookup(DEPARTMENT_OF, category), F.lit(DEFAULT_DEPARTMENT))


def queue_of(department: Column) -> Column:
    return F.coalesce(_lookup(QUEUE_OF, department), F.lit(DEFAULT_QUEUE))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[key]


def key_hash(*keys: str) -> Column:
    """Hash of a ticket's key columns; keeps tickets apart where the short display id may repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def ticket_id(*keys: str) -> Column:
    """``TKT-`` and eight hex digits: from the keys when given, so a retried task repeats it, else random."""
    digits = key_hash(*keys) if keys else F.uuid()
    return F.concat(F.lit("TKT-"), F.upper(F.substring(digits, 1, 8)))


def with_queue_numbers(queued: DataFrame, department: str = "department_key") -> DataFrame:
    """Number each department's tickets in order of arrival.

    Days, arrival times and the first digits of the id cut a department's tickets into pieces that are sorted apart, also
    when one batch gave all of them the same arrival time.
    """
    levels = {
        "__day": F.to_date("Routed_At"),
        "__time": F.col("Routed_At"),
        "__digits": F.substring("Ticket_ID", 1, len("TKT-") + 3),
    }
    return global_row_number(
        queued.withColumns(levels), [department], list(levels), ["Ticket_ID", "ticket_md5"], "Queue_No"
    ).drop(*levels)
