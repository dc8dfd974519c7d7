"""Datasets: sequence variables, study dataset, clinic cohort, imputed outcome and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.functions.semantics import band, calendar_week, days_between, if_known, is_in, relative_week, weeks_up
from visitflow.operators import cleaning as C
from visitflow.operators import quality as Q
from visitflow.operators.lanes import Lanes, attach
from visitflow.operators.sequence import is_event, with_neighbours

BY_SPECIALTY = ("patid", "tretspef")
BY_PATIENT = ("patid",)


def cohort_attrition(
    appointments: DataFrame, patients: DataFrame, patient_types: DataFrame, params: P.StudyParams, lanes: Lanes
) -> DataFrame:
    """Appointments and patients left after each step from the raw table to the clinic cohort.

    Every step depends on de-duplication keys and patient data only, so copies are merged first and counted as rows
    until the step that removes them.
    """
    recoded = C.recode_sentinels(appointments)
    keys = C.resolve(recoded, P.DEDUPE_KEYS, P.OPTIONAL_KEYS)
    merged = C.dedupe_keep_first(recoded.select(*keys, lanes.tiebreak), copies="__copies")
    return merged_attrition(merged, patients, patient_types, params, lanes)


def merged_attrition(
    merged: DataFrame, patients: DataFrame, patient_types: DataFrame, params: P.StudyParams, lanes: Lanes
) -> DataFrame:
    """The attrition from appointments that are merged already, with the number of rows of each in ``__copies``."""
    started = F.col("apptdate") >= F.lit(params.study_start) if params.include_start \
        else F.col("apptdate") > F.lit(params.study_start)
    people = C.person_table(patients, patient_types).withColumn("__member", F.lit(True))
    events = attach(merged, people, lanes, ["ons_dod", "diabetes_type", "__member"])
    present = [F.col(f).isNotNull() for f in P.REQUIRED_FIELDS]
    return Q.attrition(events, {
        "loaded": F.lit(True),
        "population": F.col("__member"),
        "without_copies": F.lit(True),
        "required_fields": present[0] & present[1] & present[2],
        "before_death": (F.col("apptdate") < F.col("ons_dod")) | F.col("ons_dod").isNull(),
        "specialty": F.col("tretspef") == params.specialty,
        "type": F.col("diabetes_type").isin(list(params.types)),
        "study": started,
        "clinic": F.col("apptdate").between(F.lit(params.sim_start), F.lit(params.sim_end)),
    }, "patid", copies="__copies", merged_at="without_copies")


def _neighbour_dates() -> dict[str, Column]:
    """A new referral has no previous event and a discharge no next one; unknown codes leave both unknown."""
    return {
        "last_appt_date": F.when(F.col("firstatt_agg") != P.NEW, F.col("__previous_date")),
        "next_appt_date": F.when(F.col("outcome") != 1, F.col("__next_date")),
    }


def with_gaps(df: DataFrame) -> DataFrame:
    """Days and rounded-up weeks to the previous and the next event."""
    return df.withColumns({
        "last_appt_int_days": days_between(F.col("last_appt_date"), F.col("apptdate")),
        "next_appt_int_days": days_between(F.col("apptdate"), F.col("next_appt_date")),
    }).withColumns({
        "last_appt_int_weeks": weeks_up(F.col("last_appt_int_days")),
        "next_appt_int_weeks": weeks_up(F.col("next_appt_int_days")),
    })


def backfill_discharged() -> Column:
    """Discharge flag, filled from the type of the next event where the outcome is unknown."""
    unknown = F.col("outcome").isNull()
    return (
        F.when(unknown & is_in(F.col("lead_firstatt"), P.NEW_CODES), 1)
        .when(unknown & is_in(F.col("lead_firstatt"), P.FOLLOW_UP_CODES), 0)
        .otherwise(F.col("discharged"))
    )


def derive_sequence(cleaned: DataFrame, params: P.StudyParams, lanes: Lanes) -> DataFrame:
    """Sequence variables over the full history, per patient and specialty."""
    out = with_neighbours(
        C.code_categories(cleaned), lanes, BY_SPECIALTY,
        previous={"__previous_date": "apptdate"},
        following={"__next_date": "apptdate", "lead_firstatt": "firstatt"},
        earliest={"__index": f"apptdate >= DATE '{params.study_start}'"},
    )
    index = F.col("__index")
    out = with_gaps(out.withColumns(_neighbour_dates())).withColumns({
        "index_appt_study": index["date"],
        "flag_index_study": F.when(is_event(index, "apptdate", "attendkey"), 1),
        "discharged_coded": F.col("discharged"),
        "discharged": backfill_discharged(),
    })
    return out.drop("__previous_date", "__next_date", "__index")


def last_band() -> Column:
    weeks = band(F.col("last_appt_int_weeks"), P.BAND_EDGES, P.BAND_LABELS)
    return F.coalesce(if_known(F.col("firstatt_agg") == P.NEW, P.NEW_REFERRAL, weeks), F.lit(P.UNKNOWN))


def next_band() -> Column:
    weeks = band(F.col("next_appt_int_weeks"), P.BAND_EDGES, P.BAND_LABELS)
    discharged = weeks.isNull() & (F.col("outcome") == 1)
    return F.coalesce(if_known(discharged, P.DISCHARGED, weeks), F.lit(P.UNKNOWN))


def _missed_gap() -> dict[str, Column]:
    """For cancelled and missed events: next event of the patient, discharge or not, and the weeks until then."""
    after = F.when(is_in(F.col("attended_agg"), (P.CANCELLED, P.MISSED)), F.col("__next_date"))
    return {
        "cancel_dna_next_apptdate": after, "cancel_dna_interval": weeks_up(days_between(F.col("apptdate"), after)),
    }


def study_dataset(
    cleaned: DataFrame, params: P.StudyParams, lanes: Lanes, missed_gap: bool = False
) -> DataFrame:
    """Study events of one specialty, with sequence variables computed inside the study period only.

    ``missed_gap`` adds the gap from a missed to the next event, from the same pass over the events.
    """
    events = C.code_categories(C.from_study_start(C.of_specialty(cleaned, params), params))
    out = with_neighbours(
        events, lanes, BY_PATIENT,
        previous={"__previous_date": "apptdate"}, following={"__next_date": "apptdate"},
    )
    out = with_gaps(out.withColumns(_neighbour_dates() | (_missed_gap() if missed_gap else {})))
    return out.withColumns({"appt_int_last_binned": last_band(), "appt_int_next_binned": next_band()}).drop(
        "__previous_date", "__next_date"
    )


def clinic_cohort(
    study: DataFrame, params: P.StudyParams, lanes: Lanes, exclude_discharged_patients: bool = False
) -> DataFrame:
    """Study events inside the simulation window, with the relative week.

    A discharge before the window removes only that event, which the window removes anyway; with
    ``exclude_discharged_patients`` it removes the patient.
    """
    start = F.lit(params.sim_start)
    if exclude_discharged_patients:
        ended = f"outcome = 1 AND apptdate < DATE '{params.sim_start}'"
        study = with_neighbours(study, lanes, BY_PATIENT, earliest={"__ended": ended})
        study = study.where(F.col("__ended").isNull()).drop("__ended")
    return C.in_window(study, params.sim_start, params.sim_end).withColumn(
        "sim_week", relative_week(F.col("apptdate"), start)
    )


def cohort_sequence(cohort: DataFrame, lanes: Lanes) -> DataFrame:
    """Sequence variables inside the cohort, in one pass.

    First event of each patient (flag, date, 1-based days since it) and the gap from a missed to the next event.
    """
    out = with_neighbours(
        cohort, lanes, BY_PATIENT, following={"__next_date": "apptdate"}, earliest={"__first": "true"}
    )
    first = F.col("__first")
    return out.withColumns({
        "flag_first_appt_sim": is_event(first, "apptdate", "attendkey").cast("int"),
        "date_first_appt_sim": first["date"],
        "time_since_first_d1": days_between(first["date"], F.col("apptdate")) + F.lit(1),
        **_missed_gap(),
    }).drop("__first", "__next_date")


def with_calendar(df: DataFrame) -> DataFrame:
    """Calendar year, January-based week and numeric appointment type."""
    kind = F.when(F.col("firstatt").isin(list(P.NEW_CODES)), 1).when(
        F.col("firstatt").isin(list(P.FOLLOW_UP_CODES)), 2
    )
    return df.withColumns({
        "year": F.year("apptdate"), "week": calendar_week(F.col("apptdate")), "firstatt_agg": kind,
    })


def check_dataset(cleaned: DataFrame, params: P.StudyParams) -> DataFrame:
    """All events of the specialty, prepared for the weekly checks."""
    return with_calendar(C.of_specialty(cleaned, params))


def impute_outcome_type(events: DataFrame, params: P.StudyParams, lanes: Lanes, chained: bool = False) -> DataFrame:
    """Imputed outcome (``outcome2``) and type (``firstatt_agg``) of events with calendar columns.

    By default the outcome changes only through a long gap to the next event, and a later event whose gap to the
    previous one is unknown loses its type. ``chained`` also uses the type of the next event for an unknown outcome,
    and keeps the coded type unless the event is the first or follows a long gap.
    """
    out = with_neighbours(
        events, lanes, BY_SPECIALTY,
        previous={"__previous_date": "apptdate"},
        following={"__next_date": "apptdate", "lead_firstatt": "firstatt"},
    ).withColumns({
        "last_appt_date": F.when(F.col("firstatt_agg") != 1, F.col("__previous_date")),
        "next_appt_date": F.when(F.col("outcome") != 1, F.col("__next_date")),
    })
    out = with_gaps(out)
    long_before = F.col("last_appt_int_weeks") > params.gap_threshold_weeks
    long_after = F.col("next_appt_int_weeks") > params.gap_threshold_weeks
    is_first = F.col("__previous_date").isNull()
    if chained:
        by_next = F.col("outcome").isNull() & is_in(F.col("lead_firstatt"), P.NEW_CODES)
        outcome = F.when(by_next | long_after, 1).otherwise(F.col("outcome"))
        kind = F.when(long_before | is_first, 1).otherwise(F.col("firstatt_agg"))
    else:
        outcome = F.when(long_after, 1).otherwise(F.col("outcome"))
        kind = if_known(long_before | is_first, 1, F.col("firstatt_agg"))
    return out.withColumns({"outcome2": outcome, "firstatt_agg": kind}).drop("__previous_date", "__next_date")
