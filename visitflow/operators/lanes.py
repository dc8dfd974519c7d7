"""Distribution of events that stays balanced when one entity holds a large part of all rows.

Ordered operators (previous and next event, index event, fill) partition by entity. An entity above ``limit`` rows
is cut into *lanes* that follow its time order: one lane per day, and several per day where a day alone is above the
limit. All other entities are one lane each. Rows are shuffled once by ``(__key, __lane)``; dimension joins and
windows both use that partitioning, and what has to cross a lane edge travels through a small per-lane summary.

Events of a heavy day are ordered by tiebreak (NULL last) and then by a hash of their row, so a day of missing or equal
tiebreaks is cut, too; only rows that are the same in every column stay together.

Sizes: ``hot`` and ``hot_days`` hold one row per group of more than ``limit`` rows, so at most ``rows / limit`` each;
that is what makes broadcasting them safe. ``find_lanes`` raises the limit to a share of all rows, so they have at most
``MOST_LANES`` rows however large the table is, and finds out once whether there is a heavy entity at all: without one,
plans have no branch for them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.sources.tables import write_table

DEFAULT_LIMIT = 1_000_000
MOST_LANES = 1 << 15
KEY, LANE, TIE = "__key", "__lane", "__tie"
LANE_COLUMNS = (KEY, LANE)

# A heavy day is cut finer than its size asks for, so that uneven tiebreaks still give lanes below the limit.
_CUTS_PER_LIMIT = 16
_SAMPLES_PER_LIMIT = 128
# Of an entity at the limit this many rows are expected in the sample that looks for candidates.
_SIGHTINGS = 1024
_CUT_BITS = 21
_WHOLE_ENTITY = -(1 << 62)
_NO_LANE = _WHOLE_ENTITY + 2
_UNDATED = 1 << 30


@dataclass(frozen=True)
class Lanes:
    """Heavy entities and heavy entity-days of one event table.

    Built from a table, it also serves every subset of it: an entity light in the whole is light in any part.
    ``placed`` says that the events come from a table bucketed by the lane columns, ``none`` that no entity is heavy.
    """

    key: str
    date: str
    tiebreak: str
    hot: DataFrame
    hot_days: DataFrame
    placed: bool = False
    none: bool = False

    def plain_key(self, df: DataFrame) -> str:
        """SQL text of the key with a blank for NULL."""
        blank = "''" if isinstance(df.schema[self.key].dataType, T.StringType) else "0"
        return f"coalesce({self.key}, {blank})"

    def with_hot_flag(self, df: DataFrame) -> DataFrame:
        if self.none:
            return df.withColumn("__hot", F.lit(False))
        hot = self.hot.selectExpr(f"{self.key} AS __hot_key", "true AS __hot")
        return df.join(F.broadcast(hot), F.expr(f"{self.key} <=> __hot_key"), "left")

    def only_hot(self, df: DataFrame) -> DataFrame:
        if self.none:
            return df.where(F.lit(False))
        hot = self.hot.selectExpr(f"{self.key} AS __hot_key")
        return df.join(F.broadcast(hot), F.expr(f"{self.key} <=> __hot_key"), "left_semi")

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the lane columns; a frame that already has them is returned as it is."""
        if LANE in df.columns:
            return df
        if self.none:
            return df.selectExpr(
                "*", f"{self.plain_key(df)} AS {KEY}", f"{_WHOLE_ENTITY}L + {_void(self.key)} AS {LANE}")
        days = self.hot_days.selectExpr(f"{self.key} AS __day_key", f"{self.date} AS __day", "__cuts")
        marked = self.with_hot_flag(df).join(
            F.broadcast(days), F.expr(f"{self.key} <=> __day_key AND {self.date} <=> __day"), "left"
        ).withColumn(TIE, F.expr(f"if(__cuts IS NULL, 0L, {_row_hash(df)})"))
        day = f"CAST(coalesce(unix_date({self.date}), {_UNDATED}) AS bigint)"
        # Number of cuts up to the event's place, by halving steps.
        steps = ", ".join(str(1 << i) for i in reversed(range(_CUT_BITS)))
        block = f"aggregate(array({steps}), 0, (n, s) -> if(get(__cuts, n + s - 1) <= {self.place}, n + s, n))"
        return marked.selectExpr(
            *df.columns,
            f"{self.plain_key(df)} AS {KEY}",
            f"CASE WHEN __cuts IS NOT NULL THEN shiftleft({day}, 32) + shiftleft(CAST({block} AS bigint), 1)"
            f" WHEN __hot THEN shiftleft({day}, 32) ELSE {_WHOLE_ENTITY}L END + {_void(self.key)} AS {LANE}",
            TIE,
        )

    @property
    def place(self) -> str:
        """Place of an event in its day: those without a tiebreak come last."""
        return f"named_struct('untied', {self.tiebreak} IS NULL, 'tiebreak', {self.tiebreak}, 'row', {TIE})"


def _row_hash(df: DataFrame) -> str:
    return f"xxhash64({', '.join(f'`{c}`' for c in df.columns)})"


def _void(key: str) -> str:
    """Lowest bit of a lane: whether the key is NULL."""
    return f"CAST({key} IS NULL AS bigint)"


def _counted(events: DataFrame, key: str, limit: int) -> DataFrame:
    return events.groupBy(key).agg(F.expr("count(*) AS __n")).where(f"__n > {limit}").select(key)


def _hot_days(lanes: Lanes, events: DataFrame, limit: int) -> DataFrame:
    """Days of heavy entities above the limit, with cuts at quantiles of the places of their events.

    The places come from rows whose hash falls in a share of ``_SAMPLES_PER_LIMIT / limit``, a bounded number per lane.
    """
    step = max(1, min(limit, _SAMPLES_PER_LIMIT) // _CUTS_PER_LIMIT)
    # Inside the aggregate: as a column, an expression of all columns would cost the optimizer its time.
    row = _row_hash(events)
    taken = f"CASE WHEN pmod({row}, {limit}) < {_SAMPLES_PER_LIMIT} THEN {lanes.place.replace(TIE, row)} END"
    days = lanes.only_hot(events).groupBy(lanes.key, lanes.date).agg(
        F.expr("count(*) AS __n"), F.expr(f"array_sort(collect_list({taken})) AS __seen"))
    return days.where(f"__n > {limit}").selectExpr(
        lanes.key, lanes.date, f"filter(__seen, (c, i) -> i % {step} = {step - 1}) AS __cuts")


def plan_lanes(
    events: DataFrame,
    key: str = "patid",
    date: str = "apptdate",
    tiebreak: str = "attendkey",
    limit: int = DEFAULT_LIMIT,
) -> Lanes:
    """Find the heavy entities of ``events``, lazily: one narrow, pre-aggregated pass over the key column.

    ``date`` must be a DATE column; ``tiebreak`` may have any type with an order. A heavy day is cut at quantiles of its
    places, taken from rows whose hash falls in a share of ``_SAMPLES_PER_LIMIT / limit``.
    """
    lanes = Lanes(key, date, tiebreak, hot := _counted(events, key, limit), hot)
    return replace(lanes, hot_days=_hot_days(lanes, events, limit))


def find_lanes(
    events: DataFrame,
    folder: str,
    key: str = "patid",
    date: str = "apptdate",
    tiebreak: str = "attendkey",
    limit: int = DEFAULT_LIMIT,
) -> Lanes:
    """Find the heavy entities of ``events`` now, and write the small tables of ``plan_lanes`` to ``folder`` if there are any.

    A sample, in which an entity at the limit is expected ``_SIGHTINGS`` times, is counted by entity; its entities with
    half of that are counted exactly. So hardly anything is shuffled, and a table without heavy entities is read once,
    the key column alone. A limit below ``rows / MOST_LANES`` is raised to it. An entity that the sample missed would
    only be less well spread; no result depends on the lanes.
    """
    share = min(1.0, _SIGHTINGS / limit)
    seen = events.select(key)
    counts = (seen.sample(share, seed=1) if share < 1 else seen).groupBy(key).agg(F.expr("count(*) AS __n"))
    rows = counts.agg(F.sum("__n").alias("n"), F.max("__n").alias("most")).first()
    limit = max(limit, int((rows.n or 0) / share) // MOST_LANES)
    least = limit * share if share == 1 else limit * share / 2
    if (rows.most or 0) <= least:
        return Lanes(key, date, tiebreak, events.select(key).limit(0), events.select(key, date).limit(0), none=True)
    candidates = counts.where(f"__n > {least}").select(F.col(key).alias("__candidate"))
    some = events.join(F.broadcast(candidates), F.expr(f"{key} <=> __candidate"), "left_semi")
    hot = write_table(_counted(some, key, limit), f"{folder}/hot")
    lanes = Lanes(key, date, tiebreak, hot, hot)
    lanes = replace(lanes, hot_days=write_table(_hot_days(lanes, events, limit), f"{folder}/hot_days"))
    return replace(lanes, none=hot.isEmpty())


def without_lanes(df: DataFrame) -> DataFrame:
    return df.drop(*LANE_COLUMNS, TIE)


def _single(dim: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """One payload per key; a dimension with several rows for a key is an error, not a silent fan-out."""
    fields = ", ".join(["'__found', true", *[f"'{c}', {c}" for c in columns]])
    first = f"first(named_struct({fields}))"
    if columns:
        first = f"CASE WHEN count(*) = 1 THEN {first} ELSE raise_error('dimension has more than one row for a key') END"
    return dim.groupBy(*keys).agg(F.expr(f"{first} AS {name}"))


def attach(df: DataFrame, dim: DataFrame, lanes: Lanes, columns: list[str], how: str = "left") -> DataFrame:
    """Join a per-entity dimension of any size to events; keys match null-safe.

    ``how`` is ``left``, ``inner`` or ``semi``. Light entities meet the dimension in a join on the lane columns, which
    the windows that follow reuse. The dimension rows of heavy entities, one for each, are broadcast instead, so the
    events of a heavy entity stay spread over their lanes. ``dim`` must have one row per key, except for ``semi``.
    """
    key = lanes.key
    laned = lanes.assign(df)
    columns = [] if how == "semi" else columns
    keyed = lanes.with_hot_flag(dim).selectExpr(
        f"{lanes.plain_key(dim)} AS __dim_key",
        f"if(__hot, {_NO_LANE}L, {_WHOLE_ENTITY}L) + {_void(key)} AS __dim_lane",
        *columns,
    )
    light = _single(keyed, ["__dim_key", "__dim_lane"], columns, "__light")
    heavy = _single(lanes.only_hot(dim).withColumnRenamed(key, "__heavy_key"), ["__heavy_key"], columns, "__heavy")
    joined = laned.join(light, F.expr(f"{KEY} = __dim_key AND {LANE} = __dim_lane"), "left").join(
        F.broadcast(heavy), F.expr(f"{key} <=> __heavy_key"), "left"
    )
    if how != "left":
        joined = joined.where("__light IS NOT NULL OR __heavy IS NOT NULL")
    kept = laned.columns if LANE in df.columns else df.columns
    return joined.selectExpr(*kept, *[f"coalesce(__light, __heavy).{c} AS {c}" for c in columns])
