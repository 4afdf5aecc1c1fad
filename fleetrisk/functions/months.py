"""Month identifiers ('yyyy-MMM') and month ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetrisk.functions.ids import _col, strip_ws

MONTH_FORMAT = "yyyy-MMM"


def month_id(ts) -> Column:
    """Timestamp/date -> month id, e.g. 2026-Feb."""
    return F.date_format(_col(ts), MONTH_FORMAT)


MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_id_of_date(date) -> Column:
    """``month_id`` of a date, put together from year and month; other than four-digit years go through the formatter."""
    d = _col(date)
    name = F.substring(F.lit("".join(MONTH_NAMES)), F.month(d) * 3 - 2, F.lit(3))
    return F.when(F.year(d).between(1000, 9999), F.concat(F.year(d).cast("string"), F.lit("-"), name)).otherwise(month_id(d))


def parse_month_id(c) -> Column:
    """Month id (any letter case) -> first-of-month date; invalid -> null."""
    return F.to_date(F.try_to_timestamp(F.initcap(strip_ws(c)), F.lit(MONTH_FORMAT)))


def month_range(start_id, end_id, max_months: int = 48) -> Column:
    """Inclusive month ids from start to end; start clamped to end; oldest ``max_months`` kept."""
    s = parse_month_id(start_id)
    e = parse_month_id(end_id)
    seq = F.sequence(F.least(s, e), e, F.expr("interval 1 month"))
    return F.transform(F.slice(seq, 1, max_months), lambda d: F.date_format(d, MONTH_FORMAT))


def month_span(start_id, end_id) -> Column:
    """Number of months in the clamped inclusive range (before the cap)."""
    s = parse_month_id(start_id)
    e = parse_month_id(end_id)
    return (F.floor(F.months_between(e, F.least(s, e))) + 1).cast("int")
