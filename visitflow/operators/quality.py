"""Data-quality counts and small-cell protection."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL_CELL = 10


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and NULLs per column: one aggregation of the whole table, then one row per column."""
    names = list(columns or df.columns)
    counts = df.agg(*_null_counts(names))
    return counts.unpivot(["n_rows"], names, "column_name", "n_null").select("column_name", "n_rows", "n_null")


def _null_counts(names: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.isnull(F.col(c))).alias(c) for c in names]]


@dataclass(frozen=True)
class ObservedProfile:
    """The NULL profile of a frame, counted while some other job reads it: no pass of its own."""

    observation: Observation
    names: tuple[str, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        """As ``null_profile``; waits for the job. A row per column, so its size is that of the schema."""
        found = self.observation.get
        rows = [(name, found["n_rows"], found[name]) for name in self.names]
        return spark.createDataFrame(rows, "column_name string, n_rows bigint, n_null bigint")


def observe_nulls(df: DataFrame) -> tuple[DataFrame, ObservedProfile]:
    """``df`` with its NULL profile to come. A stage that is run again after a lost executor counts again: for a profile
    that has to be exact then, use ``null_profile``."""
    profile = ObservedProfile(Observation(f"nulls_{uuid.uuid4().hex}"), tuple(df.columns))
    return df.observe(profile.observation, *_null_counts(profile.names)), profile


def distinct_with_null(column: str) -> Column:
    """Number of distinct values, NULL counting as one."""
    return F.count_distinct(F.col(column)) + F.coalesce(F.max(F.isnull(F.col(column)).cast("bigint")), F.lit(0))


def attrition(
    df: DataFrame, steps: Mapping[str, Column], entity: str, copies: str | None = None, merged_at: str | None = None
) -> DataFrame:
    """Rows and entities left after each step, the steps being conditions that narrow down one after the other.

    A row counts for a step if it passes this and all earlier ones. With ``copies`` a row stands for that many copies
    until the step ``merged_at``, from which on it counts once. Rows are counted per entity before anything is
    shuffled, so all steps together cost one pass and one aggregation by entity.
    """
    passing, weight, counted = F.lit(True), F.col(copies) if copies else F.lit(1), []
    for name, condition in steps.items():
        passing = passing & F.coalesce(condition, F.lit(False))
        weight = F.lit(1) if name == merged_at else weight
        counted.append(F.sum(F.when(passing, weight).otherwise(0)))
    per_entity = df.groupBy(entity).agg(*[n.alias(f"__s{i}") for i, n in enumerate(counted)])
    totals = per_entity.agg(*[
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(name).alias("stage"),
            F.coalesce(F.sum(f"__s{i}"), F.lit(0)).alias("n_rows"),
            F.count_if(F.col(f"__s{i}") > 0).alias("n_entities"),
        ).alias(f"__t{i}")
        for i, name in enumerate(steps)
    ])
    return totals.select(F.inline(F.array(*totals.columns)))


def suppress_small_cells(table: DataFrame, counts: Sequence[str], floor: int = SMALL_CELL) -> DataFrame:
    """Raise counts between 1 and ``floor - 1`` to ``floor`` before release; 0 stays 0."""
    return table.withColumns({
        c: F.when((F.col(c) > 0) & (F.col(c) < floor), F.lit(floor).cast("bigint")).otherwise(F.col(c)) for c in counts
    })


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row in a dimension; empty when the dimension is sound."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
