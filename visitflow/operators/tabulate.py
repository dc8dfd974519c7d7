"""Contingency tables, shares, summaries and completion.

Every table is one pre-aggregated pass over the events; what follows (shares, margins, rounding, zero rows) works on
the counts, whose size depends on the number of categories only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.functions.semantics import percent_text, percent_with_n, share, share_rounded
from visitflow.operators.quality import SMALL_CELL, suppress_small_cells
from visitflow.params import NA_TEXT

NA_COLUMN, OTHER_COLUMN = "na_", "other"
TOTAL = "Sum"
WEIGHT = "__n"


def slug(level: object) -> str:
    """Column name of a category level."""
    return str(level).strip().lower().replace(" ", "_")


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Events counted by all category columns that a set of tables uses.

    The tables below accept cells in place of events, so one pass over the events serves all of them.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(WEIGHT))


def protected_cells(df: DataFrame, columns: Sequence[str], floor: int = SMALL_CELL) -> DataFrame:
    """Cells of one table with every count from 1 to ``floor - 1`` raised to ``floor``.

    Margins, shares and printed cells of a table that is made from these cells are computed from the raised counts, so
    they agree with each other and no smaller count follows from them by subtraction or division.
    """
    counted = df.groupBy(*columns).agg(n_events(df).alias(WEIGHT))
    return suppress_small_cells(counted, [WEIGHT], floor)


def n_events(df: DataFrame) -> Column:
    return F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))


def n_events_if(df: DataFrame, condition: Column) -> Column:
    if WEIGHT in df.columns:
        return F.coalesce(F.sum(F.when(condition, F.col(WEIGHT))), F.lit(0).cast("bigint"))
    return F.count_if(condition)


def mean_over_events(df: DataFrame, column: str) -> Column:
    """Mean of the known values."""
    if WEIGHT in df.columns:
        return share(F.sum(F.col(column) * F.col(WEIGHT)), n_events_if(df, F.col(column).isNotNull()))
    return F.avg(column)


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(n_events(df).alias(name))


def slugs(levels: Sequence) -> list[str]:
    names = [slug(v) for v in levels]
    if len({*names, NA_COLUMN}) <= len(names):
        raise ValueError(f"levels share a column name: {', '.join(names)}")
    return names


def listed(column: str, levels: Sequence, value: Column) -> Column:
    """The aggregate ``value``; an error if ``column`` holds a known level that is not in the list."""
    unlisted = F.count_if(~F.col(column).isin(list(levels)))
    message = F.concat(F.lit(f"{column} has levels that are not listed, rows: "), unlisted.cast("string"))
    return F.when(unlisted > 0, F.raise_error(message)).otherwise(value)


def level_counts(
    df: DataFrame, column: str, levels: Sequence, with_na: bool = False, other: bool = False
) -> dict[str, Column]:
    """One count per level as aggregate columns: a pivot in a single aggregation, absent cells 0.

    A known value that is not in ``levels`` is an error, so that no row leaves the table or its shares unseen; with
    ``other`` it is counted in the column of that name instead.
    """
    names, counts = slugs(levels), {}
    if other and OTHER_COLUMN in names:
        raise ValueError(f"a level has the column name {OTHER_COLUMN}")
    for i, (name, level) in enumerate(zip(names, levels, strict=True)):
        count = n_events_if(df, F.col(column) == F.lit(level))
        # One test for the whole table is enough.
        counts[name] = listed(column, levels, count) if i == 0 and not other else count
    if with_na:
        counts[NA_COLUMN] = n_events_if(df, F.col(column).isNull())
    if other:
        counts[OTHER_COLUMN] = n_events_if(df, ~F.col(column).isin(list(levels)))
    return counts


def tabulate(
    df: DataFrame,
    row: str,
    column: str,
    levels: Sequence,
    row_levels: Sequence | None = None,
    with_na: bool = True,
    other: bool = False,
) -> DataFrame:
    """Two-way counts, one column per level, 0 for empty cells; NULL rows and (``with_na``) columns are kept.

    With ``row_levels`` a level without events still gets its row of zeros. Values that are not listed are an error, or
    counted together with ``other``.
    """
    counts = level_counts(df, column, levels, with_na, other)
    table = df.groupBy(row).agg(*[c.alias(name) for name, c in counts.items()])
    if row_levels is None:
        return table
    zeros = df.sparkSession.createDataFrame(
        [(level, *[0] * len(counts)) for level in row_levels], table.schema
    )
    return table.unionByName(zeros).groupBy(row).agg(*[F.sum(name).alias(name) for name in counts])


def one_way(df: DataFrame, column: str) -> DataFrame:
    """Counts with the share of all rows and the share of rows with a known value (NULL on the NULL row)."""
    counts, known = count_by(df, [column]), F.col(column).isNotNull()
    return counts.select(
        column,
        "n",
        share(F.col("n"), _total(counts)).alias("percent"),
        F.when(known, share(F.col("n"), _total(counts.where(known)))).alias("valid_percent"),
    )


def _total(counts: DataFrame) -> Column:
    """The sum of all counts, as a scalar subquery: each task adds up its counts, and the shuffle of the counts is reused."""
    return counts.agg(F.sum("n")).scalar()


def row_total(levels: Sequence) -> Column:
    total = F.lit(0).cast("bigint")
    for level in levels:
        total = total + F.col(slug(level))
    return total


def row_shares(table: DataFrame, row: str, levels: Sequence) -> DataFrame:
    """Counts to shares of the row total."""
    whole = row_total(levels)
    return table.select(row, *[share(F.col(slug(v)), whole).alias(slug(v)) for v in levels])


def row_percent_text(
    table: DataFrame, row: str, levels: Sequence, digits: int, with_counts: bool = True
) -> DataFrame:
    """Counts to formatted row percentages, ``12.3% (45)`` or ``12.3%``, next to the counts (``n_`` columns)."""
    text, whole = (percent_with_n if with_counts else percent_text), row_total(levels)
    return table.select(
        row,
        *[text(F.col(slug(v)), whole, digits).alias(slug(v)) for v in levels],
        *[F.col(slug(v)).alias(f"n_{slug(v)}") for v in levels],
    )


def ratio_table(
    df: DataFrame, row: str, column: str, levels: Sequence, numerator: str, denominator: str, name: str
) -> DataFrame:
    """Two-way counts with the ratio of two columns, raw and to one decimal; NULL where the denominator is 0."""
    ratio = share(F.col(slug(numerator)), F.col(slug(denominator)))
    return tabulate(df, row, column, levels).withColumns({name: ratio, f"{name}_1dp": F.bround(ratio, 1)})


def crosstab_margins(df: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Two-way counts with row and column totals; rows with a NULL category are left out."""
    known = count_by(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()), [row, column])
    cube = known.cube(row, column).agg(F.sum("n").alias("n"), F.grouping_id().alias("__g"))
    # Totals are told by their flag: a category may have the total's name.
    row_total, column_total = F.col("__g").bitwiseAND(2) > 0, F.col("__g").bitwiseAND(1) > 0
    wanted = [*[(slug(v), ~column_total & (F.col(column) == F.lit(v))) for v in levels], (slug(TOTAL), column_total)]
    wide = cube.groupBy(row, row_total.alias("__total")).agg(*[
        F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias(name) for name, fits in wanted
    ])
    return wide.withColumn(row, F.when(F.col("__total"), TOTAL).otherwise(F.col(row))).drop("__total")


def crosstab_share(df: DataFrame, row: str, column: str, digits: int) -> DataFrame:
    """Long two-way counts with their share of the grand total; rows with a NULL category are left out."""
    known = count_by(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()), [row, column])
    whole = _total(known)
    return known.select(
        row, column, "n", share(F.col("n"), whole).alias("prop"),
        share_rounded(F.col("n"), whole, digits).alias(f"prop_{digits}dp"),
    )


def share_within(df: DataFrame, outer: Sequence[str], inner: Sequence[str], digits: int = 2) -> DataFrame:
    """Counts by ``outer`` and ``inner`` keys with the share inside each outer group."""
    whole = F.sum("n").over(Window.partitionBy(*outer))
    return count_by(df, [*outer, *inner]).select(
        *outer, *inner, "n", share(F.col("n"), whole).alias("prop"),
        share_rounded(F.col("n"), whole, digits).alias(f"prop_{digits}dp"),
    )


def spread(table: DataFrame, ids: Sequence[str], key: str, value: str, levels: Sequence) -> DataFrame:
    """Long to wide with a fixed level list; absent cells are NULL, a level that is not listed is an error.

    Without ids the result is one row.
    """
    cells = [
        listed(key, levels, F.first(F.when(F.col(key) == F.lit(v), F.col(value)), ignorenulls=True)).alias(name)
        for name, v in zip(slugs(levels), levels, strict=True)
    ]
    return table.groupBy(*ids).agg(*cells)


def spread_counts(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence) -> DataFrame:
    """Counts by id and level, wide, straight from the events; absent cells are NULL."""
    counts = level_counts(df, key, levels)
    return df.groupBy(*ids).agg(*[F.nullif(c, F.lit(0)).alias(name) for name, c in counts.items()])


def complete(tally: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Add every missing combination of the key values that occur (NULL included), with count 0.

    One aggregation finds the distinct values of every key, a small frame each; the frames are joined on a column that is
    true in all of them. Spark measures them at run time: it broadcasts what is below its threshold and splits what is not.
    """
    occurring = tally.where(F.col(count) > 0)
    values = occurring.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("__set"), (F.count(F.lit(1)) > 0).alias("__there"))
    every, grid = (1 << len(keys)) - 1, None
    for i, k in enumerate(keys):
        own = values.where(F.col("__set") == every - (1 << (len(keys) - 1 - i))).select(k, F.col("__there").alias(f"__there_{i}"))
        grid = own if grid is None else grid.join(own, F.col("__there_0") == F.col(f"__there_{i}"))
    zeros = grid.select(*keys, F.lit(0).cast("bigint").alias(count))
    return zeros.unionByName(occurring.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def tally_complete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return complete(count_by(df, keys), keys)


def transition_matrix(
    df: DataFrame, groups: Sequence[str], source: str, target: str, measure: str = "prop", digits: int = 2
) -> DataFrame:
    """Long transition matrix per group: counts, and for ``measure='prop'`` the share of each source row.

    ``group_name`` joins the group values with ``_`` and names the matrix.
    """
    named = F.concat_ws("_", *[F.coalesce(F.col(g), F.lit(NA_TEXT)) for g in groups]).alias("group_name")
    if measure == "count":
        return count_by(df, [*groups, source, target], "total").select(*groups, named, source, target, "total")
    return share_within(df, [*groups, source], [target], digits).select(
        *groups, named, source, target, "n", "prop", f"prop_{digits}dp"
    )


def spread_shares(long: DataFrame, ids: Sequence[str], key: str, levels: Sequence[str], digits: int = 2) -> DataFrame:
    """One row per id: the share of every level, raw and rounded."""
    return long.groupBy(*ids).agg(*[
        listed(key, levels, F.max(F.when(F.col(key) == F.lit(v), F.col(f"prop{suffix}")))).alias(f"{name}{suffix}")
        for suffix in ("", f"_{digits}dp") for name, v in zip(slugs(levels), levels, strict=True)
    ])


def transition_matrix_wide(long: DataFrame, groups: Sequence[str], source: str, target: str, value: str,
                           levels: Sequence[str]) -> DataFrame:
    """One row per group and source level, one column per target level."""
    return spread(long, [*groups, "group_name", source], target, value, levels)


def summary_table(
    df: DataFrame, variables: Sequence[str], stratum: str, strata: Sequence[str], with_missing: bool = False,
    floor: int | None = None,
) -> DataFrame:
    """Counts and percentages of every level of every variable per stratum, in one pass; NULL is a level.

    A level that occurs in one stratum is listed with 0 in the others. ``text`` is the printed cell, ``45 (12.3)``.
    ``with_missing`` adds the flag ``missing``, which tells NULL from a level of the same name. With ``floor`` counts from 1
    to below it are raised to it before percentages are taken.
    """
    pairs = ", ".join(f"'{v}', CAST({v} AS string)" for v in variables)
    carried = [stratum, WEIGHT] if WEIGHT in df.columns else [stratum]
    counts = (
        df.selectExpr(*carried, f"stack({len(variables)}, {pairs}) AS (variable, level)")
        .groupBy("variable", "level")
        .agg(*[n_events_if(df, F.col(stratum) == s).alias(s) for s in strata])
    )
    if floor:
        counts = suppress_small_cells(counts, list(strata), floor)
    long = counts.unpivot(["variable", "level"], list(strata), stratum, "n")
    whole = F.sum("n").over(Window.partitionBy("variable", stratum))
    percent = share(F.col("n") * F.lit(100), whole)
    shown = F.format_string("%d (%.1f)", F.col("n"), F.bround("percent", 1))
    named = long.withColumn("percent", percent).withColumn("text", shown).withColumn("missing", F.col("level").isNull())
    named = named.withColumn("level", F.coalesce("level", F.lit(NA_TEXT)))
    return named if with_missing else named.drop("missing")


def summary_detail(summary: DataFrame, stratum: str) -> DataFrame:
    """Per stratum and variable: rows, missing rows, and the running percentage over the ordered levels.

    ``summary`` comes from ``summary_table`` with the flag ``missing``.
    """
    group = Window.partitionBy("variable", stratum)
    missing = F.col("missing")
    running = group.orderBy(
        missing, F.col("level").try_cast("int").asc_nulls_last(), "level"
    ).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(group)
    absent = F.coalesce(F.sum(F.when(missing, F.col("n"))).over(group), F.lit(0))
    return summary.select(
        stratum, "variable", "level",
        whole.alias("n"),
        absent.alias("miss"),
        share(absent * F.lit(100), whole).alias("p_miss"),
        F.col("n").alias("freq"),
        "percent",
        share(F.sum("n").over(running) * F.lit(100), whole).alias("cum_percent"),
    )


def summary_continuous(df: DataFrame, variables: Sequence[str], stratum: str) -> DataFrame:
    """Number of known values, mean and standard deviation of numeric variables per stratum."""
    wide = df.groupBy(stratum).agg(*[
        F.struct(
            F.lit(v).alias("variable"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")
        ).alias(f"__{v}")
        for v in variables
    ])
    rows = wide.select(stratum, F.explode(F.array(*[f"__{v}" for v in variables])).alias("__row"))
    return rows.select(stratum, "__row.variable", "__row.n", "__row.mean", "__row.sd")
