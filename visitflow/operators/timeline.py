"""Weekly timelines: counts and running totals on a fixed week spine.

Events are counted by entity and week first, so what is shuffled grows with the weeks that occur. The spine is an array of
at most one count per week, filled from these, so a missing week is 0 without a grid join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.operators.tabulate import n_events


def _weeks(df: DataFrame, ids: Sequence[str], week: str, n_weeks: int, running: bool) -> DataFrame:
    """``ids`` and the array ``__weeks``; an entity without an event in ``1..n_weeks`` has zeros only.

    A running total includes what lies before week 1.
    """
    counts = df.groupBy(*ids, F.col(week).alias("__week")).agg(n_events(df).alias("__count"))
    entry = F.when(F.col("__week") <= n_weeks, F.struct(F.col("__week").alias("w"), F.col("__count").alias("c")))
    found = counts.groupBy(*ids).agg(F.collect_list(entry).alias("__found"))
    fits = "e.w <= i" if running else "e.w = i"
    total = f"aggregate(filter(__found, e -> {fits}), 0L, (s, e) -> s + e.c)"
    return found.select(*ids, F.expr(f"transform(sequence(1, {n_weeks}), i -> {total})").alias("__weeks"))


def week_grid(
    df: DataFrame, ids: Sequence[str], week: str, n_weeks: int, value: str = "n", running: bool = False
) -> DataFrame:
    """Long ``ids x week`` counts (or running totals) with every week of ``1..n_weeks``."""
    exploded = _weeks(df, ids, week, n_weeks, running).select(*ids, F.posexplode("__weeks").alias("__at", value))
    return exploded.select(*ids, (F.col("__at") + F.lit(1)).alias(week), value)


def week_matrix(df: DataFrame, ids: Sequence[str], week: str, n_weeks: int, running: bool = False) -> DataFrame:
    """Wide form: one column ``w1..wN`` per week."""
    weekly = _weeks(df, ids, week, n_weeks, running)
    return weekly.select(*ids, *[F.col("__weeks")[i].alias(f"w{i + 1}") for i in range(n_weeks)])


def gather_weeks(matrix: DataFrame, ids: Sequence[str], week: str, value: str, n_weeks: int) -> DataFrame:
    """Wide weeks back to long rows."""
    names = [f"w{i}" for i in range(1, n_weeks + 1)]
    long = matrix.unpivot(list(ids), names, "__name", value)
    return long.select(*ids, F.substring("__name", 2, 9).cast("int").alias(week), value)
