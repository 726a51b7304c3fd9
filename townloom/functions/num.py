"""Numeric, null-handling and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townloom.functions import vocab as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant_bool(c) -> Column:
    """Real booleans, 0/1 and true/t/yes/y strings; missing is false."""
    text = F.lower(F.trim(col(c).cast("string")))
    number = F.expr("try_cast(%s as double)" % c) if isinstance(c, str) else text.try_cast("double")
    truthy = text.isin("true", "t", "1", "yes", "y") | (F.abs(number) >= 1)
    return F.coalesce(truthy, F.lit(False))


def tolerant_bool_text(c) -> Column:
    """The string form of C12, where digits other than '1' do not count."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "t", "1", "yes", "y"),
                      F.lit(False))


def null_if_sentinel(c) -> Column:
    """ACS codes for 'not available' become NULL, as does NaN."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | v.cast("long").isin(V.ACS_NULL_SENTINELS), None).otherwise(v)


def safe_pct(part, whole, digits: int | None = None) -> Column:
    """100·part/whole, NULL when either is missing or whole is not positive."""
    p, w = col(part), col(whole)
    value = F.when(w > 0, 100.0 * p / w)
    return value if digits is None else F.round(value, digits)


def safe_ratio(num, den, default: float | None = 0.0) -> Column:
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def first_filled(*cols) -> Column:
    """C17: the first candidate that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cols])


def core_name(c) -> Column:
    """Join key of a district code without number prefix, state suffix and punctuation."""
    text = F.lower(col(c))
    text = F.regexp_replace(text, r"^\d+[_-]", "")
    text = F.regexp_replace(text, r"[_-][a-z]{2}$", "")
    return F.regexp_replace(text, r"[^a-z0-9]", "")


def contains_any(text: Column, words) -> Column:
    """Plain substring test for any of the words, as one regular expression."""
    pattern = "|".join("\\Q%s\\E" % w for w in words)
    return text.rlike(pattern)


def word_tokens(text: Column) -> Column:
    return F.split(text, "[^a-z0-9]+")


def log_size(c) -> Column:
    """log1p of a non-negative size; missing is 0."""
    return F.log1p(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def signed_log(c, eps: float = 1e-12) -> Column:
    v = F.coalesce(col(c).cast("double"), F.lit(0.0))
    return F.signum(v) * F.log10(F.abs(v) + F.lit(eps))


def inverse_log_size(c) -> Column:
    return F.expm1(F.least(F.greatest(col(c), F.lit(0.0)), F.lit(14.0)))


def inverse_signed_log(c) -> Column:
    v = col(c)
    return F.signum(v) * F.pow(F.lit(10.0), F.least(F.greatest(F.abs(v), F.lit(0.0)), F.lit(12.0)))


def levels(*candidates, height=None) -> Column:
    """First numeric floor count, else metres / 3.5 with at least one floor."""
    parsed = [F.round(col(c).try_cast("double")).cast("long") for c in candidates]
    if height is not None:
        metres = col(height).try_cast("double")
        parsed.append(F.greatest(F.lit(1), F.round(metres / 3.5)).cast("long"))
    return F.coalesce(*parsed)


def year_in_window(*candidates, low: int = 1700, high: int = 2100) -> Column:
    """First four-digit year strictly inside the window."""
    out = []
    for c in candidates:
        y = F.substring(col(c).cast("string"), 1, 4).try_cast("int")
        out.append(F.when((y > low) & (y < high), y))
    return F.coalesce(*out)


def height_from_levels(c) -> Column:
    return col(c) * 3.5


def gtfs_seconds(c) -> Column:
    """C13: 'HH:MM:SS' to seconds, hours may pass 24, anything else is NULL."""
    part = F.split(col(c), ":")
    piece = lambda i: F.trim(F.try_element_at(part, F.lit(i))).try_cast("long")
    return F.when(F.size(part) == 3, piece(1) * 3600 + piece(2) * 60 + piece(3))


def entropy_from(counts, total, eps: float = 0.0) -> Column:
    """One term of the Shannon sum; add the terms of a group to get the entropy."""
    p = counts / total
    return F.when(counts > 0, -p * F.log(p + F.lit(eps))).otherwise(F.lit(0.0))


def overlap_zone(ratio) -> Column:
    """C14: 70 % inside is interior, 10 % is boundary, the rest exterior."""
    r = col(ratio)
    return (F.when(r >= 0.70, "interior").when(r >= 0.10, "boundary").otherwise("exterior"))
