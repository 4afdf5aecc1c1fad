"""CVSS vector parsing, exploitation flag and patch age (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetrisk.functions.ids import _col, safe_string

# fixed values: output column -> CVSS metric key
CVSS_KEYS = {
    "attack_vector": "AV",
    "attack_complexity": "AC",
    "privileges_required": "PR",
    "user_interaction": "UI",
    "scope": "S",
    "confidentiality_impact": "C",
    "integrity_impact": "I",
    "availability_impact": "A",
}
EXPLOITED_MARK = "Exploited:Yes"


def cvss_metric(vector, key: str) -> Column:
    """Value of the *last* '/'-separated part whose text before the first ':' is ``key``.

    Empty or null vector -> null. A part 'A:x:y' yields 'x:y'.
    """
    hits = F.regexp_extract_all(_col(vector), F.lit(rf"(?:^|/){key}:([^/]*)"), 1)
    return F.when(F.coalesce(F.length(_col(vector)), F.lit(0)) > 0, F.get(hits, F.size(hits) - 1))


def parse_cvss(vector) -> dict[str, Column]:
    """All eight metric columns of a CVSS vector."""
    return {name: cvss_metric(vector, key) for name, key in CVSS_KEYS.items()}


def exploited(c) -> Column:
    """Case-sensitive 'Exploited:Yes' substring test; missing -> false."""
    return F.coalesce(safe_string(c).contains(EXPLOITED_MARK), F.lit(False))


_ISO_CORE = (r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)\d*"
             r"(?:[+-]\d{2}:?\d{2})?$")


def parse_published(c) -> Column:
    """ISO date-time text -> wall-clock timestamp without zone (timestamp_ntz).

    Fraction digits beyond the sixth are cut. 'Z' is dropped and a numeric offset is discarded, not applied; anything
    else that is not ISO (e.g. '/Date(ms)/') -> null.
    """
    text = F.regexp_replace(_col(c).cast("string"), "Z", "")
    core = F.regexp_extract(text, _ISO_CORE, 1)
    return F.when(core != "", core.try_cast("timestamp_ntz"))


def patch_age_days(published, as_of) -> Column:
    """Whole days from publication to ``as_of``, floored (negative for future dates).

    Both ends are zone-less wall-clock values, so the session time zone (and its
    daylight-saving shifts) cannot move a day boundary.
    """
    ts = parse_published(published)
    as_of_col = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", ts, as_of_col)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")
