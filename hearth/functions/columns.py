"""Column expressions shared by the jobs (all built-in, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_address(building_name: str | Column, unit_number: str | Column, room_number: str | Column) -> Column:
    """``building unit room`` joined by single spaces; null when any part is null."""
    return F.concat(col_(building_name), F.lit(" "), col_(unit_number), F.lit(" "), col_(room_number))


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: null over no rows, like the SQL it stands for."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def percent_text(part: str | Column, whole: str | Column) -> Column:
    """``part / whole`` as a percentage with one decimal, rounded half up, e.g. ``'66.7%'``.

    Computed in integers (tenths of a percent), so there is no double rounding; null when
    either side is null or ``whole`` is 0.
    """
    p, n = col_(part).cast("bigint"), col_(whole).cast("bigint")
    tenths = _idiv(p * 2000 + n, n * 2)
    txt = F.concat(_idiv(tenths, F.lit(10)).cast("string"), F.lit("."),
                   (tenths % 10).cast("string"), F.lit("%"))
    return F.when(n.isNull() | (n == 0) | p.isNull(), F.lit(None).cast("string")).otherwise(txt)


def _idiv(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative longs (``a - a % b`` is a multiple of ``b``)."""
    return ((a - a % b) / b).cast("bigint")


def value_rank(c: str | Column, values: Sequence[str]) -> Column:
    """Position of ``c`` in ``values`` (1-based); 0 for a value not listed or null.

    This is the order MySQL's ``FIELD(col, v1, v2, ...)`` sorts by, and for an ENUM
    domain it is the declaration order.
    """
    arr = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.array_position(arr, col_(c)), F.lit(0)).cast("bigint")


def or_default(c: str | Column, text: str) -> Column:
    """Display text: ``text`` where the value is null or empty."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(text))


def due_date_of(period: str | Column) -> Column:
    """The 25th of a ``YYYY-MM`` period; null for a malformed period."""
    return F.try_to_date(F.concat(col_(period), F.lit("-25")), "yyyy-M-dd")


def period_of(ts: str | Column) -> Column:
    """``YYYY-MM`` of a date or timestamp."""
    return F.date_format(col_(ts), "yyyy-MM")


# How the pages of the application show dates and times (Chinese locale).
DISPLAY_DATE, DISPLAY_TIME = "yyyy/M/d", "yyyy/M/d HH:mm:ss"


def display_date(ts: str | Column, empty: str | None = None) -> Column:
    """A date as it is displayed, ``2026/7/1``; ``empty`` where there is none."""
    return F.coalesce(F.date_format(col_(ts), DISPLAY_DATE), F.lit(empty).cast("string"))


def display_time(ts: str | Column, empty: str | None = None) -> Column:
    """A time as it is displayed, ``2026/7/1 09:05:00``; ``empty`` where there is none."""
    return F.coalesce(F.date_format(col_(ts), DISPLAY_TIME), F.lit(empty).cast("string"))
