"""Recoding, filters, population and lookup joins, de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow import params as P
from visitflow.functions.semantics import code_label, is_in, null_if_in
from visitflow.operators.lanes import Lanes, attach


def resolve(df: DataFrame, names: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """The columns of ``df`` with these names, whatever their letter case; only ``optional`` ones may be absent."""
    present = {c.lower(): c for c in df.columns}
    absent = [n for n in names if n.lower() not in present and n not in optional]
    if absent:
        raise ValueError(f"columns are absent: {', '.join(absent)}")
    return [present[n.lower()] for n in names if n.lower() in present]


def recode_sentinels(
    df: DataFrame,
    numeric: Mapping[str, Sequence] = P.NUMERIC_SENTINELS,
    text_to_int: Mapping[str, Sequence] = P.TEXT_SENTINELS,
    zero_ages: str | None = "apptage",
) -> DataFrame:
    """Missing-value codes to NULL, text codes to integers, infant age codes to 0; absent columns are skipped, letter case is ignored."""
    present = {c.lower(): c for c in df.columns}
    changes: dict[str, Column] = {
        present[c.lower()]: null_if_in(F.col(c), codes) for c, codes in numeric.items() if c.lower() in present
    }
    changes |= {
        present[c.lower()]: null_if_in(F.col(c), codes).try_cast("int")
        for c, codes in text_to_int.items() if c.lower() in present
    }
    if zero_ages and zero_ages.lower() in present:
        age = F.col(zero_ages)
        changes[present[zero_ages.lower()]] = F.when(age.isin(list(P.INFANT_AGE_CODES)), 0).otherwise(age)
    return df.withColumns(changes)


def code_categories(df: DataFrame) -> DataFrame:
    """Add appointment type, attendance and discharge categories."""
    return df.withColumns({
        "firstatt_agg": code_label(
            F.col("firstatt"), {P.NEW: P.NEW_CODES, P.FOLLOW_UP: P.FOLLOW_UP_CODES}
        ),
        "attended_agg": code_label(
            F.col("attended"), {P.ATTENDED: P.ATTENDED_CODES, P.CANCELLED: P.CANCELLED_CODES}, default=P.MISSED
        ),
        "discharged": code_label(F.col("outcome"), {1: P.DISCHARGED_CODES, 0: P.CONTINUING_CODES}),
    })


def filter_required(df: DataFrame, fields: Sequence[str] = P.REQUIRED_FIELDS) -> DataFrame:
    """One NULL test per field, so that each can reach the scan by itself."""
    for field in fields:
        df = df.where(F.col(field).isNotNull())
    return df


def from_study_start(df: DataFrame, params: P.StudyParams, include_start: bool | None = None) -> DataFrame:
    include = params.include_start if include_start is None else include_start
    start = F.lit(params.study_start)
    return df.where(F.col("apptdate") >= start if include else F.col("apptdate") > start)


def in_window(df: DataFrame, start, end, date: str = "apptdate") -> DataFrame:
    """Closed date window."""
    return df.where(F.col(date).between(F.lit(start), F.lit(end)))


def of_specialty(df: DataFrame, params: P.StudyParams) -> DataFrame:
    return df.where((F.col("tretspef") == params.specialty) & F.col("diabetes_type").isin(list(params.types)))


def attended_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("attended").isin(list(P.ATTENDED_CODES)))


# Bits that tell all values of a type, NULL included, apart.
_FIXED_BITS = {
    T.BooleanType: 2, T.ByteType: 9, T.ShortType: 17, T.IntegerType: 33, T.DateType: 33, T.LongType: 65,
}
_DECIMAL_BITS = 126


def _as_long(column: Column, kind: T.DataType) -> Column:
    return F.unix_date(column).cast("long") if isinstance(kind, T.DateType) else column.cast("long")


def _packed_order(df: DataFrame, columns: Sequence[str]) -> Column | None:
    """One decimal that orders rows like the columns one after the other: of the first one NULL comes last, of the others
    first. None if a column is not of fixed width or the decimal would be too long."""
    kinds = [df.schema[c].dataType for c in columns]
    sizes = [_FIXED_BITS.get(type(kind)) for kind in kinds]
    if None in sizes or sum(sizes) > _DECIMAL_BITS:
        return None
    order = None
    for name, kind, bits in zip(columns, kinds, sizes, strict=True):
        half = 1 << (bits - 2)
        code = _as_long(F.col(name), kind).cast("decimal(20,0)") + F.lit(Decimal(half + 1)).cast("decimal(20,0)")
        code = F.coalesce(code, F.lit(Decimal(2 * half + 1 if order is None else 0)))
        order = code if order is None else order * F.lit(Decimal(1 << bits)) + code
        order = order.cast("decimal(38,0)")
    return order


def dedupe_keep_first(
    df: DataFrame, keys: Sequence[str] = P.DEDUPE_KEYS, tiebreak: str = "attendkey",
    optional: Sequence[str] = P.OPTIONAL_KEYS, copies: str | None = None,
) -> DataFrame:
    """One whole row per key combination (NULL equals NULL): the one with the lowest tiebreak, NULL last.

    Rows that tie are ordered by their other columns, so the result is one of the rows and always the same. An
    aggregation: copies are merged before the shuffle however many there are. It is a hash aggregation where a row's place
    has a fixed width: the tiebreak alone, if there are no other columns, or the tiebreak and other columns of numbers and
    dates that fit one decimal. Other columns of text need a sort of the groups instead. A key that is absent is an error,
    unless it is ``optional``. ``copies`` names a column for the number of rows that were merged.
    """
    keys = resolve(df, keys, optional)
    rest = [c for c in df.columns if c not in keys and c != tiebreak]
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    shown = [*df.columns, *([copies] if copies else [])]
    if not rest:
        return df.groupBy(*keys).agg(F.min(tiebreak).alias(tiebreak), *counted).select(*shown)
    packed = _packed_order(df, [tiebreak, *rest])
    if packed is not None:
        placed = df.withColumn("__place", packed).groupBy(*keys)
        return placed.agg(*[F.min_by(c, "__place").alias(c) for c in [tiebreak, *rest]], *counted).select(*shown)
    place = F.struct(F.col(tiebreak).isNull().alias("untied"), F.col(tiebreak).alias("tiebreak"), *rest)
    first = df.groupBy(*keys).agg(F.min(place).alias("__first"), *counted)
    whole = {tiebreak: F.col("__first.tiebreak").alias(tiebreak), **{c: F.col(f"__first.{c}") for c in rest}}
    return first.select(*[whole.get(c, F.col(c)) for c in shown])


def in_population(df: DataFrame, patients: DataFrame, lanes: Lanes) -> DataFrame:
    return attach(df, patients, lanes, [], how="semi")


def before_death(df: DataFrame) -> DataFrame:
    """Keep events strictly before the censor date, and all events where there is none."""
    return df.where((F.col("apptdate") < F.col("ons_dod")) | F.col("ons_dod").isNull())


def join_lookup(df: DataFrame, lookup: DataFrame, key: str = "tretspef", name: str = "tretspef_name") -> DataFrame:
    """Left join of a code name. Repeated lookup codes are reduced to one name, so rows never multiply.

    Spark measures the distinct codes at run time and broadcasts them below its threshold.
    """
    names = lookup.groupBy(F.col(key).alias("__code")).agg(F.min(name).alias(name))
    return df.join(names, F.col(key).eqNullSafe(F.col("__code")), "left").drop("__code")


def person_table(patients: DataFrame, patient_types: DataFrame) -> DataFrame:
    """Study population with death date and diabetes type: one dimension instead of three joins to the events."""
    kinds = patient_types.select(F.col("patid").alias("__patid"), "diabetes_type")
    return patients.join(kinds, F.col("patid").eqNullSafe(F.col("__patid")), "left").select(
        "patid", "ons_dod", "diabetes_type"
    )


def merge_copies(appointments: DataFrame, copies: str | None = None) -> DataFrame:
    """Raw appointments, recoded, each once. Fields that are dropped and tell no copies apart are never read."""
    unused = [c for c in resolve(appointments, P.DROPPED_FIELDS, P.DROPPED_FIELDS) if c.lower() not in P.DEDUPE_KEYS]
    return dedupe_keep_first(recode_sentinels(appointments.drop(*unused)), copies=copies)


def clean_merged(
    events: DataFrame, patients: DataFrame, patient_types: DataFrame, lookup: DataFrame | None, lanes: Lanes
) -> DataFrame:
    """The cleaned appointments of ``merge_copies``, lane columns included."""
    people = person_table(patients, patient_types)
    complete = filter_required(events).drop(*P.DROPPED_FIELDS)
    alive = before_death(attach(lanes.assign(complete), people, lanes, ["ons_dod", "diabetes_type"], how="inner"))
    return alive if lookup is None else join_lookup(alive, lookup)


def clean_appointments(
    appointments: DataFrame,
    patients: DataFrame,
    patient_types: DataFrame,
    lookup: DataFrame | None,
    lanes: Lanes,
) -> DataFrame:
    """Raw to cleaned appointments, lane columns included; without a lookup no specialty name is added.

    The removal of copies comes first: it depends on event columns only, so the result is the same as after the
    population join, and the join then carries fewer rows. The required fields are keys, so their test reaches the scan.
    """
    return clean_merged(merge_copies(appointments), patients, patient_types, lookup, lanes)


def missed(df: DataFrame) -> DataFrame:
    return df.where(is_in(F.col("attended_agg"), (P.CANCELLED, P.MISSED)))
