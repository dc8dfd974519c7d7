"""End-to-end run: stage the datasets, count the cells, write every result table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.functions.semantics import calendar_week
from visitflow.operators import cleaning as C
from visitflow.operators import quality as Q
from visitflow.operators import tabulate as T
from visitflow.operators.lanes import DEFAULT_LIMIT, LANE_COLUMNS, Lanes, find_lanes, without_lanes
from visitflow.operators.timeline import week_grid, week_matrix
from visitflow.plans import datasets as D
from visitflow.plans import tables as R
from visitflow.session import checkpoint_folder
from visitflow.sources.tables import bucket_count, write_bucketed, write_result_csv, write_table

PERIOD_CELLS = ("diabetes_type", "firstatt_agg", "attended", "attended_agg")
STUDY_CELLS = ("diabetes_type", "firstatt_agg", "attended_agg", R.LAST, R.NEXT, "cancel_dna_interval")
COHORT_CELLS = (*STUDY_CELLS, "sim_week", "flag_first_appt_sim")
CHECK_CELLS = ("apptdate", "year", "week", "diabetes_type", "firstatt_agg")
# Whole numbers of the result tables that are no counts of rows.
NO_COUNTS = ("patid", "year", "week", "step", "firstatt_agg", "outcome", "outcome2", "discharged", "flag_first_appt_sim", R.WEEK)


@dataclass(frozen=True)
class Sources:
    appointments: DataFrame
    patients: DataFrame
    patient_types: DataFrame
    lookup: DataFrame


@dataclass(frozen=True)
class Staged:
    """Datasets on storage. Each is read from its table, so a lost executor never means recomputing from raw data."""

    lanes: Lanes
    merged: DataFrame
    raw_profile: Q.ObservedProfile
    cleaned: DataFrame
    derived: DataFrame
    study: DataFrame
    cohort: DataFrame
    timeline: DataFrame
    running: DataFrame


def stage(
    sources: Sources, params: P.StudyParams, folder: str, lane_rows: int = DEFAULT_LIMIT, prefix: str | None = None,
    buckets: int | None = None,
) -> Staged:
    """Write cleaned, derived, study and cohort data, lane columns included, and the patients' timelines, in that order.

    The timelines are the weekly counts (long) and the running totals (a column per week). Without ``prefix`` the tables
    get a name of their own, so that two runs never share one.
    Cleaned and study data are bucketed by lane (tables ``<prefix>_cleaned`` and ``<prefix>_study``): the sequence
    steps that read them need no shuffle. The raw table is read once for all that follows: its copies are merged and
    counted, its NULLs are observed on the way; the merged table sets the number of buckets, unless it is given.
    """
    prefix = prefix or f"visitflow_{uuid.uuid4().hex}"
    lanes = find_lanes(sources.appointments, f"{folder}/lanes", limit=lane_rows)
    raw, profile = Q.observe_nulls(sources.appointments)
    merged = write_table(C.merge_copies(raw, copies="__copies"), f"{folder}/merged")
    buckets = buckets or bucket_count(merged.count())
    cleaned = write_bucketed(
        C.clean_merged(merged.drop("__copies"), sources.patients, sources.patient_types, sources.lookup, lanes),
        f"{prefix}_cleaned", f"{folder}/cleaned", LANE_COLUMNS, buckets,
    )
    lanes = replace(lanes, placed=True)
    derived = write_table(D.derive_sequence(cleaned, params, lanes), f"{folder}/derived")
    study = write_bucketed(
        D.study_dataset(cleaned, params, lanes, missed_gap=True),
        f"{prefix}_study", f"{folder}/study", LANE_COLUMNS, buckets,
    )
    in_window = D.clinic_cohort(study, params, lanes).drop("cancel_dna_next_apptdate", "cancel_dna_interval")
    cohort = write_table(D.cohort_sequence(in_window, lanes), f"{folder}/cohort")
    ids = ["patid", R.TYPE]
    timeline = write_table(week_grid(cohort, ids, R.WEEK, params.sim_weeks, "app_count"), f"{folder}/timeline")
    running = write_table(week_matrix(cohort, ids, R.WEEK, params.sim_weeks, running=True), f"{folder}/running_totals")
    return Staged(lanes, merged, profile, cleaned, derived, study, cohort, timeline, running)


def count_cells(
    data: Staged, params: P.StudyParams, folder: str, small_cell: int | None = None
) -> dict[str, DataFrame]:
    """One pass per dataset; all count tables read these few rows instead of the events."""
    period = C.from_study_start(C.of_specialty(data.derived, params), params, include_start=True)
    checked = D.check_dataset(data.cleaned, params)
    window = C.in_window(checked, params.check_start, params.check_end)
    dates = replace(params, sim_start=params.check_start, sim_end=params.check_end)
    check_cohort = D.clinic_cohort(data.study, dates, data.lanes).withColumns(
        {"year": F.year("apptdate"), "week": calendar_week(F.col("apptdate"))}
    )
    wanted: dict[str, tuple[DataFrame, Sequence[str]]] = {
        "period": (period, PERIOD_CELLS),
        "study": (data.study, STUDY_CELLS),
        "cohort": (data.cohort, COHORT_CELLS),
        "checked": (checked, (*CHECK_CELLS, "outcome")),
        "imputed": (D.impute_outcome_type(window, params, data.lanes), (*CHECK_CELLS, "outcome2")),
        "check_cohort": (check_cohort, (*CHECK_CELLS, "outcome")),
    }
    counted = {
        name: write_table(T.cells(df, columns), f"{folder}/cells/{name}") for name, (df, columns) in wanted.items()
    }
    strata = period.withColumn("stratum", F.col(R.TYPE))
    summary = T.summary_table(
        strata, [*_summary_fields(data), R.TYPE], "stratum", params.types, with_missing=True, floor=small_cell)
    return counted | {"summary_specialty": write_table(summary, f"{folder}/cells/summary_specialty")}


def _summary_fields(data: Staged) -> list[str]:
    return [f for f in P.SUMMARY_FIELDS if f in data.derived.columns]


def result_tables(
    sources: Sources, data: Staged, counted: dict[str, DataFrame], params: P.StudyParams, small_cell: int | None = None
) -> dict[str, DataFrame]:
    """Every result table by name. With ``small_cell`` tables with margins, shares or printed cells are made from protected cells."""

    def at(events: DataFrame, *columns: str) -> DataFrame:
        return T.protected_cells(events, columns, small_cell) if small_cell else events

    period, study, cohort = counted["period"], counted["study"], counted["cohort"]
    period_rows = C.from_study_start(C.of_specialty(data.derived, params), params, include_start=True)
    all_rows = C.from_study_start(
        data.derived.where(F.col("diabetes_type").isin(list(params.types))), params, include_start=True
    )
    tables = {
        "type_by_kind": R.kinds_by_type(at(period, R.TYPE, R.KIND)),
        "attended_type_by_kind": R.kinds_by_type(at(C.attended_only(period), R.TYPE, R.KIND)),
        "attendance_margins": T.crosstab_margins(at(period, R.TYPE, R.STATUS), R.TYPE, R.STATUS, P.ATTENDANCE_LEVELS),
        "attendance_margins_by_status": T.crosstab_margins(at(period, R.TYPE, R.STATUS), R.STATUS, R.TYPE, params.types),
        "attendance_share": T.crosstab_share(at(period, R.TYPE, R.STATUS), R.TYPE, R.STATUS, 3),
        "attendance_share_by_status": R.attendance_share_by_status(at(period, R.TYPE, R.STATUS), params),
        "follow_up_ratio": R.follow_up_ratio(at(period, R.TYPE, R.KIND)),
        "follow_up_ratio_attended": R.follow_up_ratio(at(C.attended_only(period), R.TYPE, R.KIND)),
        "attendance_percent": R.attendance_percent_by_type(at(period, R.TYPE, R.STATUS)),
        **{f"attendance_percent_{t}": R.attendance_percent_by_kind(at(period, R.TYPE, R.KIND, R.STATUS), t) for t in params.types},
        "events_per_patient": R.events_per_patient(period_rows),
        "follow_ups_per_patient": R.follow_ups_per_patient(period_rows),
        "summary_all": T.summary_table(all_rows, _summary_fields(data), R.TYPE, params.types, floor=small_cell),
        "summary_specialty": counted["summary_specialty"].drop("missing"),
        "summary_detail": T.summary_detail(counted["summary_specialty"], "stratum"),
        "backfill_audit": R.backfill_audit(data.derived, other=True),
        "null_profile": Q.null_profile(without_lanes(data.derived)),
        "raw_null_profile": data.raw_profile.table(data.merged.sparkSession),
        "attrition": D.merged_attrition(data.merged, sources.patients, sources.patient_types, params, data.lanes),
        "weekly_new": R.weekly_new(cohort, params),
        "weekly_existing_index": R.weekly_existing_index(cohort, params),
        "cumulative_by_week": R.cumulative_by_week(cohort, params),
        "count_by_week": R.count_by_week(cohort),
    }
    for end, events in (("clinic", cohort), ("study", study)):
        tables |= {
            f"last_interval_{end}": R.last_interval_distribution(at(events, R.KIND, R.TYPE, R.LAST)),
            f"attendance_by_last_count_{end}": R.attendance_by_last_counts(at(events, R.KIND, R.STATUS, R.LAST)),
            f"attendance_by_last_share_{end}": R.attendance_by_last_shares(at(events, R.KIND, R.STATUS, R.LAST)),
            f"new_attendance_{end}": R.new_attendance_percent(at(events, R.KIND, R.TYPE, R.STATUS)),
            f"new_next_count_{end}": R.new_next_counts(at(events, R.KIND, R.STATUS, R.NEXT)),
            f"new_next_share_{end}": R.new_next_shares(at(events, R.KIND, R.STATUS, R.TYPE, R.NEXT)),
            f"missed_gap_{end}": R.missed_gap_means(events),
        }
    checked = counted["checked"]
    cuts = {
        "all_years": (checked.where(F.col("apptdate") >= F.lit(params.calendar_start)), "outcome"),
        "study_period": (C.in_window(checked, params.check_start, params.check_end), "outcome"),
        "imputed": (counted["imputed"], "outcome2"),
        "check_cohort": (counted["check_cohort"], "outcome"),
    }
    for cut, (events, outcome) in cuts.items():
        tables |= {
            f"weekly_{cut}_kind": R.weekly(events, "firstatt_agg"),
            f"weekly_{cut}_outcome": R.weekly(events, outcome),
            f"weekly_{cut}_kind_outcome": R.weekly(events, "firstatt_agg", outcome),
        }
    return tables


def protected(table: DataFrame, floor: int | None) -> DataFrame:
    """``table`` with its small counts raised to ``floor``; unchanged without one."""
    counts = [f.name for f in table.schema if f.dataType.typeName() == "long" and f.name not in NO_COUNTS]
    return Q.suppress_small_cells(table, counts, floor) if floor and counts else table


def run(
    sources: Sources, params: P.StudyParams, folder: str | None = None, lane_rows: int = DEFAULT_LIMIT,
    prefix: str | None = None, small_cell: int | None = None, buckets: int | None = None,
) -> dict[str, str]:
    """Stage everything and write the result tables as CSV; returns the folder of each table.

    With ``small_cell`` counts from 1 to below it are written as ``small_cell``; margins, shares, percentages and printed cells
    are computed from the raised counts of their table. Means are of the events as they are.
    The transition matrices get one subfolder per group. Without ``folder`` the one in ``spark.checkpoint.dir`` is used; it
    is an error if neither is named.
    """
    spark = sources.appointments.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/visitflow"
    data = stage(sources, params, f"{folder}/data", lane_rows, prefix, buckets)
    counted = count_cells(data, params, f"{folder}/data", small_cell)
    written = {}
    for name, table in result_tables(sources, data, counted, params, small_cell).items():
        written[name] = f"{folder}/results/{name}"
        write_result_csv(protected(table, small_cell), written[name])
    for measure in ("prop", "count"):
        name = f"transition_{measure}"
        written[name] = f"{folder}/results/{name}"
        cells = counted["cohort"]
        if small_cell:
            cells = T.protected_cells(cells, [*R.MATRIX_GROUPS, R.LAST, R.NEXT], small_cell)
        wide = R.transition_wide(cells, measure)
        write_result_csv(protected(wide, small_cell), written[name], ["group_name"])
    return written
