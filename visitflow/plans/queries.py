"""Named queries over a folder of test tables: every operator, dataset and result table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.functions import semantics as S
from visitflow.operators import cleaning as C
from visitflow.operators import quality as Q
from visitflow.operators import sequence as E
from visitflow.operators import tabulate as T
from visitflow.operators import timeline as L
from visitflow.operators.lanes import DEFAULT_LIMIT, Lanes, attach, find_lanes, plan_lanes, without_lanes
from visitflow.plans import datasets as D
from visitflow.plans import tables as R
from visitflow.session import shared_folder
from visitflow.sources import fixtures as X

STUDY = X.STUDY
ID = ["patid", "attendkey", "apptdate"]
#: Rows above which a patient is cut into lanes in ``derive_sequence_in_lanes``, so low that the test tables have such patients.
LOW_LANE_LIMIT = 60


#: Lane plans found in this process, by application, folder and limit. They hold for later data too: results don't depend on them.
_FOUND: dict[tuple[str, str, int], Lanes] = {}


class Inputs:
    """Lazily built datasets of one test-table folder. Building one starts no Spark job, but for the lane plan of a folder,
    which is found once per application."""

    def __init__(self, spark: SparkSession, sf_dir: str, lane_limit: int = DEFAULT_LIMIT):
        self.spark, self.sf_dir, self.lane_limit = spark, sf_dir, lane_limit

    @cached_property
    def raw(self):
        return X.appointments(self.spark, self.sf_dir)

    @cached_property
    def patients(self):
        return X.patients(self.spark, self.sf_dir)

    @cached_property
    def patient_types(self):
        return X.patient_types(self.spark, self.sf_dir)

    @cached_property
    def lookup(self):
        return X.specialties(self.spark, self.sf_dir)

    @cached_property
    def lanes(self):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.lane_limit)
        if key not in _FOUND:
            folder = f"{shared_folder(self.spark)}/lanes-{uuid.uuid4().hex}"
            _FOUND[key] = find_lanes(self.raw, folder, limit=self.lane_limit)
        return _FOUND[key]

    @cached_property
    def cleaned(self):
        return C.clean_appointments(self.raw, self.patients, self.patient_types, None, self.lanes)

    @cached_property
    def cleaned_named(self):
        return C.clean_appointments(self.raw, self.patients, self.patient_types, self.lookup, self.lanes)

    @cached_property
    def coded(self):
        return C.code_categories(self.cleaned)

    @cached_property
    def period(self):
        return C.from_study_start(C.of_specialty(self.coded, STUDY), STUDY, include_start=True)

    @cached_property
    def derived(self):
        return D.derive_sequence(self.cleaned, STUDY, self.lanes)

    @cached_property
    def study(self):
        return D.study_dataset(self.cleaned, STUDY, self.lanes)

    @cached_property
    def cohort(self):
        return D.clinic_cohort(self.study, STUDY, self.lanes)

    @cached_property
    def indexed(self):
        return D.cohort_sequence(self.cohort, self.lanes)

    @cached_property
    def study_with_gap(self):
        return D.study_dataset(self.cleaned, STUDY, self.lanes, missed_gap=True)

    @cached_property
    def checked(self):
        return D.check_dataset(self.cleaned, STUDY)

    @cached_property
    def checked_window(self):
        return C.in_window(self.checked, STUDY.check_start, STUDY.check_end)

    @cached_property
    def imputed(self):
        return D.impute_outcome_type(self.checked_window, STUDY, self.lanes)

    @cached_property
    def checked_cohort(self):
        """The clinic cohort of the check period: its window replaces the simulation window."""
        dates = P.StudyParams(**{**STUDY.__dict__, "sim_start": STUDY.check_start, "sim_end": STUDY.check_end})
        cohort = D.clinic_cohort(self.study, dates, self.lanes)
        return cohort.withColumns({"year": F.year("apptdate"), "week": S.calendar_week(F.col("apptdate"))})

    @cached_property
    def described(self):
        """Derived data of both types from the study start on, with specialty and region names."""
        derived = D.derive_sequence(self.cleaned_named, STUDY, self.lanes)
        regions = X.patient_regions(self.spark, self.sf_dir)
        named = attach(derived, regions, self.lanes, ["ethnos"])
        return C.from_study_start(
            named.where(F.col("diabetes_type").isin(list(STUDY.types))), STUDY, include_start=True
        )


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(name: str):
    def register(build):
        _QUERIES[name] = build
        return build

    return register


# --- Projection, recoding, filters -------------------------------------------------------------------


@query("project_rename_drop")
def _(i):
    shown = i.raw.select(*ID, "tretspef", "reqdate").withColumn("wait_days", F.datediff("apptdate", "reqdate"))
    return shown.withColumnRenamed("tretspef", "specialty").drop("reqdate")


@query("recode_sentinels")
def _(i):
    recoded = C.recode_sentinels(i.raw)
    return recoded.select("patid", "attendkey", *P.NUMERIC_SENTINELS, "firstatt", "apptage")


@query("code_categories")
def _(i):
    coded = C.code_categories(C.recode_sentinels(i.raw))
    return coded.select("attendkey", "firstatt", "attended", "outcome", "firstatt_agg", "attended_agg", "discharged")


@query("filter_required")
def _(i):
    return C.filter_required(C.recode_sentinels(i.raw)).select("attendkey", *P.REQUIRED_FIELDS)


@query("filter_study_start")
def _(i):
    start = F.lit(STUDY.study_start)
    kept = C.from_study_start(i.raw, STUDY, include_start=True)
    return kept.select(*ID, (F.col("apptdate") > start).cast("int").alias("after_start"))


@query("filter_window_closed")
def _(i):
    return C.in_window(i.raw, STUDY.sim_start, STUDY.sim_end).select(*ID)


@query("filter_specialty_type")
def _(i):
    typed = attach(i.raw, i.patient_types, i.lanes, ["diabetes_type"])
    return C.of_specialty(typed, STUDY).select(*ID, "tretspef", "diabetes_type")


@query("filter_attendance")
def _(i):
    coded = C.code_categories(C.recode_sentinels(i.raw))
    return coded.where(F.col("attended_agg") == P.ATTENDED).select(*ID, "attended", "attended_agg").unionByName(
        C.missed(coded).select(*ID, "attended", "attended_agg")
    )


@query("calendar_week")
def _(i):
    return i.raw.select(
        "attendkey", "apptdate", F.year("apptdate").alias("year"), S.calendar_week(F.col("apptdate")).alias("week")
    )


@query("relative_week")
def _(i):
    window = C.in_window(i.raw, STUDY.sim_start, STUDY.sim_end)
    week = S.relative_week(F.col("apptdate"), F.lit(STUDY.sim_start))
    return window.select("attendkey", "apptdate", week.alias("sim_week"))


@query("interval_bins")
def _(i):
    weeks = S.weeks_up(S.days_between(F.col("reqdate"), F.col("apptdate")))
    return i.raw.select("attendkey", weeks.alias("weeks")).withColumn(
        "bin", S.band(F.col("weeks"), P.BAND_EDGES, P.BAND_LABELS)
    )


# --- Joins and de-duplication ------------------------------------------------------------------------


@query("semi_join_population")
def _(i):
    return C.in_population(i.raw, i.patients, i.lanes).select(*ID)


@query("left_join_lookup")
def _(i):
    return C.join_lookup(i.raw, i.lookup).select("attendkey", "tretspef", "tretspef_name")


@query("left_join_attribute")
def _(i):
    return attach(i.raw, i.patient_types, i.lanes, ["diabetes_type"]).select("attendkey", "patid", "diabetes_type")


@query("censor_after_date")
def _(i):
    return C.before_death(attach(i.raw, i.patients, i.lanes, ["ons_dod"])).select(*ID, "ons_dod")


def _with_copies(i: Inputs) -> DataFrame:
    copies = i.raw.where("patid % 50 = 0").withColumn("attendkey", F.col("attendkey") + F.lit(1000000000000000))
    return i.raw.unionByName(copies)


@query("dedupe_keep_first")
def _(i):
    return C.dedupe_keep_first(_with_copies(i).drop("apptage")).select(*ID, "tretspef")


@query("top1_per_group")
def _(i):
    kept = E.top_1_per_group(i.raw, ["patid", "apptdate", "tretspef"], [F.col("attendkey").asc_nulls_last()])
    return kept.select(*ID, "tretspef")


@query("distinct_patients")
def _(i):
    return i.coded.agg(Q.distinct_with_null("patid").alias("n_patients"))


@query("clean_appointments")
def _(i):
    return without_lanes(i.cleaned_named)


# --- Sequence ----------------------------------------------------------------------------------------


@query("last_event_date")
def _(i):
    return i.derived.select(*ID, "tretspef", "firstatt_agg", "last_appt_date")


@query("next_event_date")
def _(i):
    return i.derived.select(*ID, "tretspef", "outcome", "next_appt_date")


@query("gap_to_previous")
def _(i):
    return i.derived.select("attendkey", "last_appt_int_days", "last_appt_int_weeks")


@query("gap_to_next")
def _(i):
    return i.derived.select("attendkey", "next_appt_int_days", "next_appt_int_weeks")


@query("lead_event_type")
def _(i):
    return i.derived.select(*ID, "tretspef", "lead_firstatt")


@query("index_event_flag")
def _(i):
    on_row = F.when(F.col("flag_index_study") == 1, F.col("index_appt_study"))
    return i.derived.select(*ID, "tretspef", "flag_index_study", on_row.alias("index_appt_study"))


@query("index_date_broadcast")
def _(i):
    return i.derived.select(*ID, "tretspef", "index_appt_study")


@query("fill_up_down")
def _(i):
    sparse = i.coded.withColumn("outcome_filled", F.col("outcome"))
    filled = E.fill_up_down(sparse, i.lanes, D.BY_SPECIALTY, "outcome_filled")
    return filled.select(*ID, "tretspef", "outcome", "outcome_filled")


@query("neighbours_of_other_events")
def _(i):
    """The same operator on another table of dated events per entity, with its own column names."""
    events = X.table(i.spark, i.sf_dir, "events").withColumn("day", F.to_date("ts"))
    lanes = plan_lanes(events, key="user_id", date="day", tiebreak="event_id")
    out = E.with_neighbours(
        events, lanes, ["user_id"], previous={"previous_type": "event_type", "previous_day": "day"},
        following={"next_type": "event_type"}, size="n_events",
    )
    gap = S.days_between(F.col("previous_day"), F.col("day")).alias("days_since_previous")
    return out.select("event_id", "user_id", "day", "previous_type", "next_type", gap, "n_events")


@query("group_size")
def _(i):
    sized = E.with_neighbours(i.period, i.lanes, ["patid", "diabetes_type"], size="count")
    return sized.select(*ID, "diabetes_type", "count")


@query("backfill_discharged")
def _(i):
    return i.derived.select("attendkey", "outcome", "lead_firstatt", "discharged")


@query("backfill_audit")
def _(i):
    return R.backfill_audit(i.derived)


@query("derive_sequence")
def _(i):
    return without_lanes(i.derived)


@query("derive_sequence_in_lanes")
def _(i):
    return without_lanes(Inputs(i.spark, i.sf_dir, LOW_LANE_LIMIT).derived)


@query("study_dataset")
def _(i):
    return without_lanes(i.study)


@query("bin_last_interval")
def _(i):
    rank = S.level_rank(F.col(R.LAST), P.LAST_LEVELS)
    return i.study.select("attendkey", "firstatt_agg", "last_appt_int_weeks", R.LAST, rank.alias("level_rank"))


@query("bin_next_interval")
def _(i):
    rank = S.level_rank(F.col(R.NEXT), P.NEXT_LEVELS)
    return i.study.select("attendkey", "outcome", "next_appt_int_weeks", R.NEXT, rank.alias("level_rank"))


@query("clinic_cohort")
def _(i):
    return without_lanes(i.cohort)


@query("clinic_cohort_without_discharged")
def _(i):
    strict = D.clinic_cohort(i.study, STUDY, i.lanes, exclude_discharged_patients=True)
    return strict.select(*ID, "sim_week")


@query("clinic_cohort_indexed")
def _(i):
    return without_lanes(i.indexed).drop("cancel_dna_next_apptdate", "cancel_dna_interval")


@query("first_in_window_flag")
def _(i):
    return i.indexed.select(*ID, "flag_first_appt_sim")


@query("days_since_first")
def _(i):
    return i.indexed.select(*ID, "date_first_appt_sim", "time_since_first_d1")


@query("missed_to_next_gap")
def _(i):
    return i.study_with_gap.select(*ID, "attended_agg", "cancel_dna_next_apptdate", "cancel_dna_interval")


@query("impute_outcome_type")
def _(i):
    return i.imputed.select(*ID, "firstatt", "outcome", "firstatt_agg", "outcome2")


@query("impute_outcome_type_full_history")
def _(i):
    """All years, so that gaps over the threshold occur."""
    return D.impute_outcome_type(i.checked, STUDY, i.lanes).select(*ID, "firstatt_agg", "outcome2")


@query("impute_outcome_type_chained")
def _(i):
    return D.impute_outcome_type(i.checked, STUDY, i.lanes, chained=True).select(*ID, "firstatt_agg", "outcome2")


# --- Tables: generic operators -----------------------------------------------------------------------


@query("group_count")
def _(i):
    rank = S.level_rank(F.col("attended_agg"), P.ATTENDANCE_LEVELS)
    return T.count_by(i.coded, ["attended_agg", "firstatt_agg"]).withColumn("level_rank", rank).orderBy(
        "level_rank", F.col("firstatt_agg").asc_nulls_last()
    )


@query("share_within_group")
def _(i):
    return T.share_within(i.coded, ["diabetes_type"], ["attended_agg"])


@query("spread_counts")
def _(i):
    counts = T.count_by(i.coded, ["tretspef", "firstatt_agg"])
    wide = T.spread(counts, ["tretspef"], "firstatt_agg", "n", P.TYPE_LEVELS)
    return wide.fillna(0, [T.slug(v) for v in P.TYPE_LEVELS])


@query("tabulate_one_way")
def _(i):
    return T.one_way(i.coded, "discharged")


@query("tabulate_two_way")
def _(i):
    return T.tabulate(i.coded, "firstatt_agg", "discharged", (0, 1)).withColumnsRenamed(
        {"0": "continuing", "1": "discharged"}
    )


@query("crosstab_row_pct")
def _(i):
    table = T.tabulate(i.period, "diabetes_type", "attended_agg", P.ATTENDANCE_LEVELS, with_na=False)
    return T.row_shares(table, "diabetes_type", P.ATTENDANCE_LEVELS)


@query("crosstab_pct_with_n")
def _(i):
    table = T.tabulate(i.coded, "tretspef", "attended_agg", P.ATTENDANCE_LEVELS, with_na=False)
    return T.row_percent_text(table, "tretspef", P.ATTENDANCE_LEVELS, 1)


@query("crosstab_margins")
def _(i):
    return T.crosstab_margins(i.period, "diabetes_type", "attended_agg", P.ATTENDANCE_LEVELS)


@query("crosstab_margins_transposed")
def _(i):
    return T.crosstab_margins(i.period, "attended_agg", "diabetes_type", STUDY.types)


@query("crosstab_prop")
def _(i):
    return T.crosstab_share(i.period, "diabetes_type", "attended_agg", 3)


@query("crosstab_prop_transposed")
def _(i):
    return R.attendance_share_by_status(i.period, STUDY)


@query("complete_combinations")
def _(i):
    return T.tally_complete(i.checked, ["year", "diabetes_type", "firstatt_agg", "outcome"])


@query("null_profile")
def _(i):
    raw = Q.null_profile(i.raw).withColumn("dataset", F.lit("raw"))
    shown = [c for c in without_lanes(i.derived).columns if c != "discharged_coded"]
    derived = Q.null_profile(i.derived, shown).withColumn("dataset", F.lit("derived"))
    return raw.unionByName(derived)


@query("cohort_attrition")
def _(i):
    return D.cohort_attrition(i.raw, i.patients, i.patient_types, STUDY, i.lanes)


@query("suppress_small_cells")
def _(i):
    return Q.suppress_small_cells(R.weekly_existing_index(i.indexed, STUDY), list(STUDY.types))


def _protected(i: Inputs) -> DataFrame:
    return T.protected_cells(i.cohort, [R.LAST, R.NEXT])


@query("protected_margins")
def _(i):
    return T.crosstab_margins(_protected(i), R.LAST, R.NEXT, P.NEXT_LEVELS)


@query("protected_shares")
def _(i):
    return T.share_within(_protected(i), [R.LAST], [R.NEXT])


@query("protected_percent")
def _(i):
    table = T.tabulate(_protected(i), R.LAST, R.NEXT, P.NEXT_LEVELS, with_na=False)
    return T.row_percent_text(table, R.LAST, P.NEXT_LEVELS, 1)


@query("patient_week_grid")
def _(i):
    return L.week_grid(i.cohort, ["patid", "diabetes_type"], "sim_week", STUDY.sim_weeks, "app_count")


@query("cumulative_timeline")
def _(i):
    return L.week_grid(
        i.cohort, ["patid", "diabetes_type"], "sim_week", STUDY.sim_weeks, "cumulative_appt_count", running=True
    )


@query("unpivot_weeks")
def _(i):
    wide = L.week_matrix(i.cohort, ["patid", "diabetes_type"], "sim_week", STUDY.sim_weeks, running=True)
    return L.gather_weeks(wide, ["patid", "diabetes_type"], "sim_week", "cumulative_appt_count", STUDY.sim_weeks)


# --- Tables: results ---------------------------------------------------------------------------------

_PERIOD_TABLES = {
    "tab_type_by_newfu": R.kinds_by_type,
    "tab_attended_type_by_newfu": lambda d: R.kinds_by_type(C.attended_only(d)),
    "new_fu_ratio": R.follow_up_ratio,
    "new_fu_ratio_attended": lambda d: R.follow_up_ratio(C.attended_only(d)),
    "attendance_pct_by_type": R.attendance_percent_by_type,
    "attendance_pct_type1": lambda d: R.attendance_percent_by_kind(d, "type1"),
    "attendance_pct_type2": lambda d: R.attendance_percent_by_kind(d, "type2"),
    "mean_appts_per_patient": R.events_per_patient,
    "mean_followups_per_patient": R.follow_ups_per_patient,
}
_COHORT_TABLES = {
    "weekly_new": lambda d: R.weekly_new(d, STUDY),
    "transition_matrix_prop": R.transition_shares,
    "transition_matrix_count": R.transition_counts,
    "transition_matrix_prop_wide": R.transition_wide,
    "transition_matrix_count_wide": lambda d: R.transition_wide(d, "count"),
    "cumulative_by_week": lambda d: R.cumulative_by_week(d, STUDY),
    "count_by_week_type": R.count_by_week,
}
_PAIRED_TABLES = {
    "last_interval_dist": R.last_interval_distribution,
    "attend_by_last_count": R.attendance_by_last_counts,
    "attend_by_last_prop": R.attendance_by_last_shares,
    "new_attend_pct": R.new_attendance_percent,
    "new_next_count": R.new_next_counts,
    "new_next_prop": R.new_next_shares,
}
_WEEKLY_CUTS = {
    "weekly": lambda i: i.checked.where(F.col("apptdate") >= F.lit(STUDY.calendar_start)),
    "study_weekly": lambda i: i.checked_window,
    "imputed_weekly": lambda i: i.imputed,
    "cohort_weekly": lambda i: i.checked_cohort,
}


def _add_tables() -> None:
    for name, table in _PERIOD_TABLES.items():
        _QUERIES[name] = lambda i, t=table: t(i.period)
    for name, table in _COHORT_TABLES.items():
        _QUERIES[name] = lambda i, t=table: t(i.cohort)
    for name, table in _PAIRED_TABLES.items():
        _QUERIES[f"{name}_cl"] = lambda i, t=table: t(i.cohort)
        _QUERIES[f"{name}_st"] = lambda i, t=table: t(i.study)
    for cut, data in _WEEKLY_CUTS.items():
        outcome = "outcome2" if cut == "imputed_weekly" else "outcome"
        _QUERIES[f"{cut}_firstatt"] = lambda i, d=data: R.weekly(d(i), "firstatt_agg")
        _QUERIES[f"{cut}_outcome"] = lambda i, d=data, o=outcome: R.weekly(d(i), o)
        _QUERIES[f"{cut}_firstatt_outcome"] = lambda i, d=data, o=outcome: R.weekly(d(i), "firstatt_agg", o)


_add_tables()


@query("weekly_existing_index")
def _(i):
    return R.weekly_existing_index(i.indexed, STUDY)


@query("missed_gap_mean_cl")
def _(i):
    return R.missed_gap_means(i.indexed)


@query("missed_gap_mean_st")
def _(i):
    return R.missed_gap_means(i.study_with_gap)


@query("table_one_all")
def _(i):
    return T.summary_table(i.described, P.SUMMARY_FIELDS, "diabetes_type", STUDY.types)


def _specialty_summary(i: Inputs, with_missing: bool = False) -> DataFrame:
    one = i.described.where(F.col("tretspef") == STUDY.specialty).withColumn("stratum", F.col("diabetes_type"))
    return T.summary_table(one, [*P.SUMMARY_FIELDS, "diabetes_type"], "stratum", STUDY.types, with_missing)


@query("table_one_specialty")
def _(i):
    return _specialty_summary(i)


@query("table_one_detail")
def _(i):
    return T.summary_detail(_specialty_summary(i, with_missing=True), "stratum")


@query("table_one_continuous")
def _(i):
    return T.summary_continuous(
        i.described, ["last_appt_int_days", "next_appt_int_weeks", "hes_yr"], "diabetes_type"
    ).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, b=build: b(Inputs(spark, sf_dir))) for name, build in _QUERIES.items()}
