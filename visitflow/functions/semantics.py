"""Column helpers for the rules in which the study's semantics differ from plain Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_known(condition: Column, yes, no) -> Column:
    """Two-way choice that is NULL when the condition is NULL (``otherwise`` would answer ``no``)."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, as_col(yes)).when(~condition, as_col(no))


def is_in(value: Column, members: Iterable) -> Column:
    """Membership that is false, not NULL, for a NULL value."""
    return F.coalesce(value.isin(list(members)), F.lit(False))


def null_if_in(value: Column, sentinels: Sequence) -> Column:
    """Sentinel codes to NULL, everything else unchanged."""
    if len(sentinels) == 1:
        return F.nullif(value, F.lit(sentinels[0]))
    return F.when(~is_in(value, sentinels), value)


def code_label(value: Column, groups: Mapping[object, Sequence], default=None) -> Column:
    """Code sets to labels; codes outside every set, and NULL, give ``default``."""
    out = None
    for label, codes in groups.items():
        out = (F if out is None else out).when(value.isin(list(codes)), F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def weeks_up(days: Column) -> Column:
    """Whole weeks, rounded up; the same day is week 0."""
    return F.ceil(days / F.lit(7)).cast("int")


def relative_week(day: Column, start: Column) -> Column:
    """1-based week counted from ``start``."""
    return weeks_up(F.datediff(day, start) + F.lit(1))


def calendar_week(day: Column) -> Column:
    """Seven-day blocks from 1 January, 1..53 (not ISO weeks)."""
    return F.ceil(F.dayofyear(day) / F.lit(7)).cast("int")


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands whose first band also holds its lower edge; outside or NULL gives NULL."""
    out = F.when(value < F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        inside = value.isNotNull() if upper == float("inf") else value <= F.lit(upper)
        out = out.when(inside, F.lit(label))
    return out


def level_rank(value: Column, levels: Sequence[str]) -> Column:
    """1-based position in the level list, for sorting in level order; NULL for other values."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.nullif(position, F.lit(0)).cast("int")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; NULL when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share_rounded(part: Column, whole: Column, digits: int) -> Column:
    """Share rounded half to even."""
    return F.bround(share(part, whole), digits)


def percent_text(part: Column, whole: Column, digits: int) -> Column:
    """``12.3%`` with the last digit rounded half to even; ``-`` when the whole is 0."""
    percent = F.bround(share(part * F.lit(100), whole), digits)
    return F.when(percent.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f%%", percent))


def percent_with_n(part: Column, whole: Column, digits: int) -> Column:
    """``12.3% (45)``."""
    return F.concat(percent_text(part, whole, digits), F.lit(" ("), part.cast("string"), F.lit(")"))
