"""Result tables, each a function of the dataset it is read from.

``period`` is the cleaned and coded specialty data from the study start on, ``events`` a study dataset or clinic
cohort, ``checked`` data with calendar columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.operators import tabulate as T
from visitflow.operators.cleaning import attended_only, missed
from visitflow.operators.timeline import week_grid

TYPE, KIND, STATUS = "diabetes_type", "firstatt_agg", "attended_agg"
LAST, NEXT, WEEK = "appt_int_last_binned", "appt_int_next_binned", "sim_week"
MATRIX_GROUPS = (KIND, TYPE)


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col(KIND) == kind)


# --- Descriptives ------------------------------------------------------------------------------------


def backfill_audit(derived: DataFrame, other: bool = False) -> DataFrame:
    """Discharge flag by type of the next event, before and after the backfill, counted in one pass.

    With ``other`` codes beyond the known ones have a column of their own; otherwise they are an error.
    """
    counted = derived.select(
        "lead_firstatt",
        F.explode(F.array(
            F.struct(F.lit("before").alias("stage"), F.col("discharged_coded").alias("discharged")),
            F.struct(F.lit("after").alias("stage"), F.col("discharged").alias("discharged")),
        )).alias("flag"),
    )
    counts = T.level_counts(counted, "lead_firstatt", (1, 2, 3, 4, 5), with_na=True, other=other)
    return counted.groupBy("flag.stage", "flag.discharged").agg(*[
        n.alias(name if name == T.NA_COLUMN else f"next_{name}") for name, n in counts.items()
    ])


def attendance_share_by_status(period: DataFrame, params: P.StudyParams) -> DataFrame:
    """Shares of the grand total, one row per attendance and one column per type."""
    return T.spread(T.crosstab_share(period, STATUS, TYPE, 3), [STATUS], TYPE, "prop_3dp", params.types)


def kinds_by_type(period: DataFrame) -> DataFrame:
    return T.tabulate(period, TYPE, KIND, P.TYPE_LEVELS)


def follow_up_ratio(period: DataFrame) -> DataFrame:
    return T.ratio_table(period, TYPE, KIND, P.TYPE_LEVELS, P.FOLLOW_UP, P.NEW, "new_fu_ratio")


def attendance_percent_by_type(period: DataFrame) -> DataFrame:
    table = T.tabulate(period, TYPE, STATUS, P.ATTENDANCE_LEVELS, with_na=False)
    return T.row_percent_text(table, TYPE, P.ATTENDANCE_LEVELS, 0, with_counts=False)


def attendance_percent_by_kind(period: DataFrame, diabetes_type: str) -> DataFrame:
    """Both kinds are listed even without events; events of unknown kind form a row of their own."""
    one_type = period.where(F.col(TYPE) == diabetes_type)
    table = T.tabulate(one_type, KIND, STATUS, P.ATTENDANCE_LEVELS, row_levels=P.TYPE_LEVELS, with_na=False)
    return T.row_percent_text(table, KIND, P.ATTENDANCE_LEVELS, 0)


def events_per_patient(period: DataFrame) -> DataFrame:
    per_patient = T.count_by(attended_only(period), ["patid", TYPE])
    return per_patient.groupBy(TYPE).agg(F.sum("n").alias("sum"), F.avg("n").alias("mean"))


def follow_ups_per_patient(period: DataFrame) -> DataFrame:
    """The mean is over patients with at least one follow-up."""
    per_patient = T.count_by(of_kind(attended_only(period), P.FOLLOW_UP), ["patid", TYPE, KIND])
    return per_patient.groupBy(TYPE, KIND).agg(F.sum("n").alias("sum"), F.avg("n").alias("mean"))


# --- Inputs of the weekly model ----------------------------------------------------------------------


def weekly_new(cohort: DataFrame, params: P.StudyParams) -> DataFrame:
    return T.tabulate(of_kind(cohort, P.NEW), WEEK, TYPE, params.types, with_na=False)


def weekly_existing_index(indexed: DataFrame, params: P.StudyParams) -> DataFrame:
    """First events in the window that are follow-ups, per week."""
    first = of_kind(indexed.where(F.col("flag_first_appt_sim") == 1), P.FOLLOW_UP)
    return T.tabulate(first, WEEK, TYPE, params.types, with_na=False)


def last_interval_distribution(events: DataFrame) -> DataFrame:
    table = T.tabulate(of_kind(events, P.FOLLOW_UP), TYPE, LAST, P.LAST_LEVELS, with_na=False)
    return T.row_percent_text(table, TYPE, P.LAST_LEVELS, 1)


def attendance_by_last_counts(events: DataFrame) -> DataFrame:
    return T.spread_counts(of_kind(events, P.FOLLOW_UP), [STATUS], LAST, P.LAST_LEVELS)


def attendance_by_last_shares(events: DataFrame) -> DataFrame:
    shares = T.share_within(of_kind(events, P.FOLLOW_UP), [LAST], [STATUS])
    return T.spread_shares(shares, [LAST], STATUS, P.ATTENDANCE_LEVELS)


def new_attendance_percent(events: DataFrame) -> DataFrame:
    table = T.tabulate(of_kind(events, P.NEW), TYPE, STATUS, P.ATTENDANCE_LEVELS, with_na=False)
    return T.row_percent_text(table, TYPE, P.ATTENDANCE_LEVELS, 1)


def _new_and_attended(events: DataFrame) -> DataFrame:
    return of_kind(events, P.NEW).where(F.col(STATUS) == P.ATTENDED)


def new_next_counts(events: DataFrame) -> DataFrame:
    """One row."""
    return T.spread_counts(_new_and_attended(events), [], NEXT, P.NEXT_LEVELS)


def new_next_shares(events: DataFrame) -> DataFrame:
    shares = T.share_within(_new_and_attended(events), [TYPE], [NEXT])
    return T.spread_shares(shares, [TYPE], NEXT, P.NEXT_LEVELS)


def transition_shares(cohort: DataFrame) -> DataFrame:
    return T.transition_matrix(cohort, MATRIX_GROUPS, LAST, NEXT)


def transition_counts(cohort: DataFrame) -> DataFrame:
    return T.transition_matrix(cohort, MATRIX_GROUPS, LAST, NEXT, measure="count")


def transition_wide(cohort: DataFrame, measure: str = "prop") -> DataFrame:
    """Matrices as rows of last-interval levels and columns of next-interval levels; absent cells NULL."""
    long = transition_counts(cohort) if measure == "count" else transition_shares(cohort)
    value = "total" if measure == "count" else "prop_2dp"
    return T.transition_matrix_wide(long, MATRIX_GROUPS, LAST, NEXT, value, P.NEXT_LEVELS)


def cumulative_by_week(cohort: DataFrame, params: P.StudyParams) -> DataFrame:
    """Running total of events per week and type.

    Adding up the running totals of all patients gives the running total of all events, so no patient timeline is
    needed: one aggregation by type.
    """
    return week_grid(cohort, [TYPE], WEEK, params.sim_weeks, "cum_wk_appt", running=True)


def count_by_week(cohort: DataFrame) -> DataFrame:
    return T.count_by(cohort, [WEEK, TYPE, KIND], "cum_wk_appt")


def missed_gap_means(with_gap: DataFrame) -> DataFrame:
    """Mean weeks to the next event (known ones only) next to the number of all missed events."""
    return missed(with_gap).groupBy(TYPE, STATUS, KIND).agg(
        T.mean_over_events(with_gap, "cancel_dna_interval").alias("mean"), T.n_events(with_gap).alias("n")
    )


# --- Weekly checks -----------------------------------------------------------------------------------


def weekly(checked: DataFrame, *codes: str) -> DataFrame:
    """Weekly counts by type and codes, with every combination of occurring values."""
    return T.tally_complete(checked, ["year", "week", TYPE, *codes])
