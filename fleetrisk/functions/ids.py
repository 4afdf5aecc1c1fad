"""Identifier normalisation and predicates (column expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: identifier patterns
CVE_PATTERN = r"^CVE-[0-9]{4}-[0-9]{4,}$"
KB_LOOSE_PATTERN = r"(?i)(KB)?([0-9]{4,8})"
KB_STRICT_PATTERN = r"(?i)(KB[0-9]{4,8})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed values: the characters Java's \s matches (space, tab, newline, vertical tab, form feed, return)
WHITESPACE = " \t\n\u000b\f\r"


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace (plain ``trim`` removes spaces only); no regex per row."""
    return F.trim(_col(c).cast("string"), F.lit(WHITESPACE))


def normalise_id(c) -> Column:
    """Upper-case, stripped identifier; null stays null."""
    return F.upper(strip_ws(c))


def is_cve_id(c) -> Column:
    """Strict CVE predicate on the normalised value: CVE-yyyy-nnnn+ ; null -> false."""
    return F.coalesce(normalise_id(c).rlike(CVE_PATTERN), F.lit(False))


def loose_cve_id(c) -> Column:
    """Loose feed normaliser: keeps anything starting with CVE- (after strip/upper)."""
    v = normalise_id(c)
    return F.when(v.startswith("CVE-"), v)


def kb_id_loose(c) -> Column:
    """First 4-8 digit run, 'KB' optional, returned as KB<digits>; no digits -> null."""
    digits = F.regexp_extract(_col(c).cast("string"), KB_LOOSE_PATTERN, 2)
    return F.when(digits != "", F.concat(F.lit("KB"), digits))


def kb_id_strict(c, fallback=None) -> Column:
    """Literal KB + 4-8 digits, upper-cased; no match -> fallback (default null)."""
    hit = F.upper(F.regexp_extract(_col(c).cast("string"), KB_STRICT_PATTERN, 1))
    out = F.when(hit != "", hit)
    return F.coalesce(out, _col(fallback)) if fallback is not None else out


def month_list(c) -> Column:
    """Comma/whitespace separated month ids -> sorted distinct non-empty array."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"[,\s]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def safe_double(c, default: float = 0.0) -> Column:
    """Numeric coercion: unparsable, missing or NaN -> default."""
    v = _col(c).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(default)), F.lit(default))


def safe_string(c) -> Column:
    """Missing -> '', else stripped text."""
    return F.coalesce(strip_ws(c), F.lit(""))


def metric_is(c, expected: str) -> Column:
    """Case-insensitive equality of a cleaned metric value; never null."""
    return F.upper(safe_string(c)) == F.lit(expected.upper())


def update_type(supersedes) -> Column:
    """'Superseding' when the entry replaces anything, else 'Standalone'."""
    return F.when(F.coalesce(F.size(_col(supersedes)), F.lit(0)) > 0, "Superseding").otherwise("Standalone")


def normalise_id_array(c) -> Column:
    """Normalise every element, drop blanks, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(
        F.transform(_col(c), lambda x: normalise_id(x)),
        lambda x: x.isNotNull() & (x != ""))))
