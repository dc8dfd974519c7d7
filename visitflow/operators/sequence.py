"""Ordered per-entity operators: previous and next event, index event, group size, fill.

All of them take a unique tiebreak and put undated events last, so results do not depend on input order. Events of one
day that share a tiebreak, or lack it, follow one another in some order, the same for all results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.operators.lanes import KEY, LANE, LANE_COLUMNS, TIE, Lanes

_EVERYTHING = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


class _Laned:
    """Events in their lanes, with the windows and the per-lane summary that the operators share."""

    def __init__(self, df: DataFrame, lanes: Lanes, by: Sequence[str]):
        if lanes.key not in by:
            raise ValueError(f"'by' must contain the lane key {lanes.key!r}")
        self.lanes, self.others, self.kept = lanes, [c for c in by if c != lanes.key], df.columns
        self.events = lanes.assign(df)
        # Further columns of ``by`` stay out of the partitioning, so that the joins on the lane columns share it.
        explicit = self.others and not lanes.placed
        self.spread = self.events.repartition(*LANE_COLUMNS) if explicit else self.events
        keys = ", ".join([*LANE_COLUMNS, *self.others])
        self.lane = f"PARTITION BY {keys}"
        place = f"{lanes.date} ASC NULLS LAST, {lanes.tiebreak} ASC NULLS LAST"
        self.ordered = f"{self.lane} ORDER BY {place}" + (f", {TIE}" if TIE in self.events.columns else "")
        self.place = lanes.place if TIE in self.events.columns else "true"
        self.entity = f"PARTITION BY {', '.join([KEY, f'{LANE} & 1', *self.others])}"
        self.across = f"{self.entity} ORDER BY {LANE}"

    def join_edges(self, local: Mapping[str, str], parts: Mapping[str, str], edges: Mapping[str, str]) -> DataFrame:
        """Window expressions inside the lanes, with what a heavy entity needs from its other lanes joined on.

        ``parts`` summarises the lanes of heavy entities, a row per calendar day plus one per share of ``limit`` rows
        of a day, and ``edges`` are windows over those rows.
        """
        here = self.spread.selectExpr("*", *[f"{text} AS {name}" for name, text in local.items()])
        summary = (
            self.lanes.only_hot(self.events)
            .groupBy(*LANE_COLUMNS, *self.others)
            .agg(*[F.expr(f"{text} AS {name}") for name, text in parts.items()])
        )
        moved = summary.selectExpr(
            f"{KEY} AS __edge_key", f"{LANE} AS __edge_lane",
            *[f"{name} AS __edge_by{i}" for i, name in enumerate(self.others)],
            *[f"{text} AS {name}" for name, text in edges.items()],
        )
        # Null-safe, but not as a join key: the keys have to be exactly the columns the events are partitioned by.
        same = [f"{KEY} = __edge_key AND {LANE} = __edge_lane"]
        same += [
            f"coalesce({name} = __edge_by{i}, {name} IS NULL AND __edge_by{i} IS NULL)"
            for i, name in enumerate(self.others)
        ]
        return here.join(moved, F.expr(" AND ".join(same)), "left")


def _fields(sources: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{new}', {source}" for new, source in sources.items()) + ")"


def with_neighbours(
    df: DataFrame,
    lanes: Lanes,
    by: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    earliest: Mapping[str, str] | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add values of neighbouring events of the same entity.

    ``previous`` / ``following`` map a new column to the column read from the event before / after. ``earliest`` maps a
    new struct column ``(undated, date, untied, tiebreak)`` to the SQL condition whose first event it identifies; every row of
    the entity gets it. ``size`` names a column with the number of events of the entity. One shuffle, one sort.
    """
    work = _Laned(df, lanes, by)
    local, parts, edges, final = {}, {}, {}, {}
    if previous:
        local["__at_start"] = f"row_number() OVER ({work.ordered}) = 1"
        parts["__tail"] = f"max_by({_fields(previous)}, {work.place})"
        edges["__before"] = f"lag(__tail) OVER ({work.across})"
        for new, source in previous.items():
            local[f"__lag_{new}"] = f"lag({source}) OVER ({work.ordered})"
            final[new] = f"if(__at_start, __before.{new}, __lag_{new})"
    if following:
        local["__at_end"] = f"lead(1) OVER ({work.ordered}) IS NULL"
        parts["__head"] = f"min_by({_fields(following)}, {work.place})"
        edges["__after"] = f"lead(__head) OVER ({work.across})"
        for new, source in following.items():
            local[f"__lead_{new}"] = f"lead({source}) OVER ({work.ordered})"
            final[new] = f"if(__at_end, __after.{new}, __lead_{new})"
    position = _fields({
        "undated": f"{lanes.date} IS NULL", "date": lanes.date, "untied": f"{lanes.tiebreak} IS NULL",
        "tiebreak": lanes.tiebreak,
    })
    for name, condition in (earliest or {}).items():
        first = f"min(CASE WHEN {condition} THEN {position} END)"
        local[f"__own_{name}"] = f"{first} OVER ({work.lane})"
        parts[f"__first_{name}"] = first
        edges[f"__all_{name}"] = f"min(__first_{name}) OVER ({work.entity})"
        final[name] = f"coalesce(__all_{name}, __own_{name})"
    if size:
        local["__own_size"] = f"count(*) OVER ({work.lane})"
        parts["__lane_size"] = "count(*)"
        edges["__all_size"] = f"sum(__lane_size) OVER ({work.entity})"
        final[size] = "coalesce(__all_size, __own_size)"
    joined = work.join_edges(local, parts, edges)
    return joined.selectExpr(*work.kept, *[f"{text} AS `{name}`" for name, text in final.items()])


def fill_up_down(df: DataFrame, lanes: Lanes, by: Sequence[str], column: str) -> DataFrame:
    """Fill NULLs of ``column`` within the entity from the next known value, else from the last known one."""
    work = _Laned(df, lanes, by)
    at = f"CASE WHEN {column} IS NOT NULL THEN {work.place} END"
    joined = work.join_edges(
        local={
            "__next": f"first_value({column}) IGNORE NULLS OVER "
                      f"({work.ordered} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
            "__last": f"last_value({column}) IGNORE NULLS OVER ({work.ordered} {_EVERYTHING})",
        },
        parts={"__head": f"min_by({column}, {at})", "__tail": f"max_by({column}, {at})"},
        edges={
            "__later": f"first_value(__head) IGNORE NULLS OVER "
                       f"({work.across} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
            "__final": f"last_value(__tail) IGNORE NULLS OVER ({work.across} {_EVERYTHING})",
        },
    )
    filled = f"coalesce(__next, __later, __final, __last) AS {column}"
    return joined.selectExpr(*[filled if c == column else c for c in work.kept])


def is_event(found: Column, date: str, tiebreak: str) -> Column:
    """True on the row that an ``earliest`` column points to."""
    return found["date"].eqNullSafe(F.col(date)) & found["tiebreak"].eqNullSafe(F.col(tiebreak))


def top_1_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group. Spark keeps one row per group and task before the shuffle, so a huge group costs nothing."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
