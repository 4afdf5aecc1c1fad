"""Display strings used by tables and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetrisk.functions.ids import _col


def join_list(c, sep: str = ", ", empty: str = "-") -> Column:
    """Array -> 'a, b, c'; empty or null -> ``empty``."""
    arr = _col(c)
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(arr, sep)).otherwise(F.lit(empty))


def window_text(start, end) -> Column:
    """'a to b', a single id, or '-' when neither is set."""
    s, e = _col(start), _col(end)
    s_set = F.coalesce(s, F.lit("")) != ""
    e_set = F.coalesce(e, F.lit("")) != ""
    return (F.when(~s_set & ~e_set, "-")
            .when((s == e) | ~e_set, s)
            .when(~s_set, e)
            .otherwise(F.concat(s, F.lit(" to "), e)))


def range_text(months) -> Column:
    """First..last of an ordered list: '-', 'a' or 'a to z'."""
    m = _col(months)
    n = F.coalesce(F.size(m), F.lit(0))
    return (F.when(n == 0, "-").when(n == 1, F.get(m, 0))
            .otherwise(F.concat(F.get(m, 0), F.lit(" to "), F.get(m, n - 1))))


def fixed(c, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", _col(c))


def md_escape(c) -> Column:
    """Markdown table cell: pipes escaped, newlines flattened (only texts that have some go through the pattern)."""
    text = F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    broken = text.contains("\n") | text.contains("\r")
    return F.when(broken, F.regexp_replace(text, r"[\r\n]+", " ")).otherwise(text)


def plural(n, singular: str, plural_form: str | None = None) -> Column:
    return F.when(_col(n) == 1, F.lit(singular)).otherwise(F.lit(plural_form or singular + "s"))
