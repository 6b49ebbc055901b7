"""Column-level parsers (all JVM-side, ANSI-safe: every coercion is a try_*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode-aware strip (plain ``trim`` only removes spaces)."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    s = strip(c)
    return F.when(F.length(s) > 0, s)


def parse_date(c: Column | str) -> Column:
    """``%Y-%m-%d`` after strip; accepts 2025-1-5, rejects 25-1-5, 2025-02-30, times."""
    shaped = F.regexp_extract(strip(c), _DATE_SHAPE, 0)
    return F.to_date(F.try_to_timestamp(shaped, F.lit("y-M-d")))


def parse_int(c: Column | str) -> Column:
    """Strict integer: '12' and '+5' parse, '12.0' / '1e3' / 'nan' do not."""
    return strip(c).try_cast("int")


def parse_number(c: Column | str) -> Column:
    """Lenient numeric (pandas ``to_numeric`` style): '12.0' -> 12.0."""
    return strip(c).try_cast("double")


def parse_float(c: Column | str) -> Column:
    """Float parse; non-finite values (nan, inf) are treated as unreadable."""
    d = strip(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days ``later - earlier`` on DATE columns (pandas ``.dt.days``)."""
    return F.datediff(col_(later), col_(earlier))


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), r"(?U)\s+", " ")
