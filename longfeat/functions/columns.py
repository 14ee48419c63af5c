"""Column expressions that stay inside generated code. All are safe under ANSI mode."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: str | date | Column) -> Column:
    """A date column from a literal or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def truthy(col: Column) -> Column:
    """Boolean from a flag stored as boolean, number or text; other text is false, not an error."""
    text = F.lower(F.trim(col.cast("string")))
    return F.coalesce(text.isin("true", "t", "1"), F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0 (also where it is null)."""
    return F.when(condition, 1).otherwise(0)


def part_or(col: Column, default: int, zero_is_missing: bool = True) -> Column:
    """A date part with its default where it is null (and, if asked, where it is zero)."""
    return F.coalesce(F.nullif(col, F.lit(0)) if zero_is_missing else col, F.lit(default))


def birth_date(year: Column, month: Column, day: Column) -> Column:
    """Date from possibly missing parts: year 1, month 7, day 1 stand in; bad dates become null."""
    parts = [part_or(year, 1, zero_is_missing=False), part_or(month, 7), part_or(day, 1)]
    return F.concat_ws("-", *[p.cast("string") for p in parts]).try_cast("date")


def plausible(col: Column, earliest, latest) -> Column:
    """The date itself inside [earliest, latest], null outside."""
    return F.when(col.between(as_date(earliest), as_date(latest)), col)


def whole_years(start: Column, as_of) -> Column:
    """Completed years between two dates."""
    return F.floor(F.months_between(as_date(as_of), start, roundOff=False) / 12).cast("int")


def gated(value: Column, condition: Column, lo: float, hi: float) -> Column:
    """Null for a missing value; the value if the condition holds and lo <= value <= hi; otherwise 0."""
    inside = condition & value.between(float(lo), float(hi))
    return F.when(value.isNotNull(), F.when(inside, value).otherwise(F.lit(0.0)))


def positive(col: Column) -> Column:
    """The value where it is above zero, null elsewhere."""
    return F.when(col > 0, col)


def id_text(col: Column) -> Column:
    """An id as text, without the decimal tail a double-typed id would show."""
    return F.regexp_replace(col.cast("string"), r"\.\d*$", "")


def column_name(text: str, prefix: str = "") -> str:
    """Blanks and hyphens become underscores; commas and brackets vanish."""
    return prefix + re.sub(r"[,()]", "", re.sub(r"[ \-]", "_", text))


def any_of(col: Column, values: Iterable) -> Column:
    """``isin`` that is false (not null) for a null column and for an empty list."""
    values = list(values)
    return F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)
