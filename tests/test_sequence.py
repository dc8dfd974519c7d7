import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.operators import sequence as E
from visitflow.operators.cleaning import code_categories
from visitflow.operators.lanes import KEY, LANE, TIE, find_lanes, plan_lanes
from visitflow.plans import datasets as D

EVENTS = "patid bigint, attendkey bigint, apptdate date, tretspef string, firstatt int, outcome int, attended int, " \
         "diabetes_type string"
STUDY = P.StudyParams(study_start=date(2016, 12, 1))


def events(spark, *rows, patient=1):
    """Rows of (month-day 2017 or date, type code, outcome)."""
    full = []
    for i, (day, kind, outcome) in enumerate(rows, 1):
        when = day if isinstance(day, date) or day is None else date(2017, *map(int, day.split("-")))
        full.append((patient, i, when, "307", kind, outcome, 5, "type1"))
    return spark.createDataFrame(full, EVENTS)


def study(df, limit=1000):
    return D.study_dataset(df, STUDY, plan_lanes(df, limit=limit)).orderBy("attendkey").collect()


def column(rows, name):
    return [r[name] for r in rows]


@pytest.mark.parametrize("limit", [1000, 1])
def test_new_then_follow_ups_then_discharge(spark, limit):
    rows = study(events(spark, ("01-01", 1, 2), ("01-08", 2, 2), ("01-20", 2, 1)), limit)
    assert column(rows, "last_appt_int_weeks") == [None, 1, 2]
    assert column(rows, "next_appt_int_weeks") == [1, 2, None]
    assert column(rows, "appt_int_last_binned") == ["New referral", "1 week", "1 month"]
    assert column(rows, "appt_int_next_binned") == ["1 week", "1 month", "Discharged"]


@pytest.mark.parametrize("limit", [1000, 1])
def test_unknown_outcome_has_no_next_event(spark, limit):
    rows = study(events(spark, ("01-01", 2, None), ("02-01", 2, 2)), limit)
    assert column(rows, "next_appt_date") == [None, None]
    assert column(rows, "appt_int_next_binned") == ["Unknown", "Unknown"]
    assert column(rows, "appt_int_last_binned") == ["Unknown", "1 month"]


def test_unknown_type_has_no_previous_event(spark):
    rows = study(events(spark, ("01-01", 5, 2), ("01-15", 5, 2)))
    assert column(rows, "last_appt_date") == [None, None]
    assert column(rows, "appt_int_last_binned") == ["Unknown", "Unknown"]


@pytest.mark.parametrize("limit", [1000, 1])
def test_same_day_events_follow_the_tiebreak(spark, limit):
    rows = study(events(spark, ("01-01", 2, 2), ("01-01", 2, 2)), limit)
    assert column(rows, "last_appt_int_weeks") == [None, 0]
    assert column(rows, "appt_int_last_binned") == ["Unknown", "1 week"]


def test_discharge_backfill(spark):
    def flag(*rows):
        df = events(spark, *rows)
        return column(D.derive_sequence(df, STUDY, plan_lanes(df)).orderBy("attendkey").collect(), "discharged")[0]

    assert flag(("01-01", 2, None), ("02-01", 1, 2)) == 1
    assert flag(("01-01", 2, None), ("02-01", 2, 2)) == 0
    assert flag(("01-01", 2, None)) is None
    assert flag(("01-01", 2, 2), ("02-01", 1, 2)) == 0


def _imputed(df, **options):
    lanes = plan_lanes(df)
    out = D.impute_outcome_type(D.with_calendar(df), P.StudyParams(), lanes, **options)
    return out.orderBy("attendkey").collect()


def test_imputed_type(spark):
    start = date(2010, 1, 1)
    days = [start, start + timedelta(7), start + timedelta(77), start + timedelta(77 + 735), start + timedelta(900)]
    df = events(spark, *zip(days, [2, 1, 2, 2, 5], [2, 2, 2, 2, None]))
    assert column(_imputed(df), "firstatt_agg") == [1, None, 2, 1, None]
    assert column(_imputed(df), "outcome2") == [2, 2, 1, 2, None]
    assert column(_imputed(df, chained=True), "firstatt_agg") == [1, 1, 2, 1, None]


def test_chained_imputation_uses_the_next_type(spark):
    df = events(spark, ("01-01", 2, None), ("02-01", 1, 2))
    assert column(_imputed(df), "outcome2") == [None, 2]
    assert column(_imputed(df, chained=True), "outcome2") == [1, 2]


def test_clinic_cohort_and_earlier_discharge(spark):
    dates = P.StudyParams(study_start=date(2016, 1, 1), sim_start=date(2017, 2, 1), sim_end=date(2018, 1, 31))
    df = events(spark, ("01-01", 2, 1), ("03-01", 2, 2))
    for limit in (1000, 1):
        lanes = plan_lanes(df, limit=limit)
        cohort = D.clinic_cohort(D.study_dataset(df, dates, lanes), dates, lanes)
        assert column(cohort.collect(), "sim_week") == [5]
        strict = D.clinic_cohort(D.study_dataset(df, dates, lanes), dates, lanes, exclude_discharged_patients=True)
        assert strict.count() == 0


def test_window_index(spark):
    df = events(spark, ("03-01", 2, 2), ("03-01", 2, 2), ("03-10", 2, 2))
    for limit in (1000, 1):
        lanes = plan_lanes(df, limit=limit)
        rows = D.cohort_sequence(code_categories(df), lanes).orderBy("attendkey").collect()
        assert column(rows, "flag_first_appt_sim") == [1, 0, 0]
        assert column(rows, "time_since_first_d1") == [1, 1, 10]


def test_missed_events_look_past_a_discharge(spark):
    df = events(spark, ("01-01", 2, 1), ("01-09", 2, 1)).withColumn(
        "attended", F.when(F.col("attendkey") == 1, 3).otherwise(5))
    for limit in (1000, 1):
        lanes = plan_lanes(df, limit=limit)
        rows = D.study_dataset(df, STUDY, lanes, missed_gap=True).orderBy("attendkey").collect()
        assert column(rows, "cancel_dna_interval") == [2, None]
        assert column(rows, "next_appt_date") == [None, None]


# --- Heavy entities ----------------------------------------------------------------------------------


def skewed(spark, seed=7):
    """A third of all rows belongs to patient 0, much of it to one day; also no patient and no date."""
    rng = random.Random(seed)
    rows = []
    for key in range(1200):
        heavy = key % 3 == 0
        patient = 0 if heavy else (None if key % 10 == 1 else rng.randrange(1, 60))
        day = date(2017, 5, 5) if heavy and rng.random() < 0.5 else date(2017, 1, 1) + timedelta(rng.randrange(300))
        rows.append((
            patient, key * 1000003 % 7919, None if rng.random() < 0.03 else day,
            rng.choice(["307", "300"]), rng.choice([1, 2, 2, 4, 5]), rng.choice([1, 2, 3, None]),
            rng.choice([5, 6, 2, 3]), "type1",
        ))
    return spark.createDataFrame(rows, EVENTS).repartition(4)


def both_ways(spark, build):
    df = skewed(spark)
    plain = build(df, plan_lanes(df, limit=10**6))
    lanes = plan_lanes(df, limit=20)
    assert lanes.hot.count() >= 2 and lanes.hot_days.count() >= 1
    cut = build(df, lanes)
    assert plain.columns == cut.columns
    a, b = (sorted(map(repr, x.collect())) for x in (plain, cut))
    assert len(a) == 1200 and a == b


@pytest.mark.parametrize("by", [["patid"], ["patid", "tretspef"]])
def test_heavy_entities_give_the_same_neighbours(spark, by):
    both_ways(spark, lambda df, lanes: E.with_neighbours(
        df, lanes, by,
        previous={"p": "apptdate", "p_kind": "outcome"}, following={"n": "apptdate", "n_kind": "outcome"},
        earliest={"first": "true", "discharge": "outcome = 1"}, size="size",
    ))


def test_heavy_entities_give_the_same_fill(spark):
    both_ways(spark, lambda df, lanes: E.fill_up_down(df, lanes, ["patid", "tretspef"], "outcome"))


def test_neighbours_match_a_plain_loop(spark):
    df = skewed(spark)
    rows = [r.asDict() for r in df.collect()]
    rows.sort(key=lambda r: (repr(r["patid"]), r["apptdate"] is None, r["apptdate"] or date.min, r["attendkey"]))
    expected = {}
    for before, row, after in zip([None, *rows], rows, [*rows[1:], None]):
        expected[row["attendkey"]] = tuple(
            other["attendkey"] if other and other["patid"] == row["patid"] else None for other in (before, after)
        )
    got = E.with_neighbours(
        df, plan_lanes(df, limit=20), ["patid"], previous={"p": "attendkey"}, following={"n": "attendkey"}
    )
    assert {r.attendkey: (r.p, r.n) for r in got.collect()} == expected


def test_lanes_spread_a_heavy_entity(spark):
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("patid"), F.col("id").alias("attendkey"),
        F.expr("date_add(DATE '2017-01-01', CAST(id % 7 AS INT))").alias("apptdate"),
    )
    spread = plan_lanes(df, limit=500).assign(df).repartition(16, KEY, LANE)
    largest = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2 * n / 16


def test_order_of_the_input_does_not_matter(spark):
    df = skewed(spark)
    build = lambda x: E.with_neighbours(
        x, plan_lanes(x), ["patid", "tretspef"], previous={"p": "attendkey"}, following={"n": "outcome"}
    )
    assert sorted(map(repr, build(df).collect())) == sorted(map(repr, build(df.repartition(7, "outcome")).collect()))


def test_fill_goes_up_then_down(spark):
    df = events(spark, ("01-01", 1, None), ("01-02", 1, 2), ("01-03", 1, None), ("01-04", 1, 3), ("01-05", 1, None))
    for limit in (1000, 1):
        filled = E.fill_up_down(df, plan_lanes(df, limit=limit), ["patid"], "outcome").orderBy("attendkey")
        assert column(filled.collect(), "outcome") == [2, 2, 3, 3, 3]


@pytest.mark.parametrize("kind", ["null", "text", "outlier"])
def test_any_tiebreak_gives_the_same_at_any_limit(spark, kind):
    keys = {"null": "nullif(id, 30)", "text": "concat('k', lpad(id, 5, '0'))", "outlier": "if(id = 59, 1000000000000000, id)"}
    events = spark.range(60).selectExpr(
        "1L AS patid", "date_add(DATE '2020-01-01', CAST(id / 30 AS int)) AS apptdate", f"{keys[kind]} AS attendkey", "id")
    found = []
    for limit in (3, 10**6):
        lanes = plan_lanes(events, limit=limit)
        near = E.with_neighbours(events, lanes, ["patid"], previous={"before": "id"}, following={"after": "id"}, size="n")
        found.append(sorted(map(str, near.select("id", "before", "after", "n").collect())))
        if limit == 3:
            assert lanes.assign(events).groupBy(LANE).count().agg({"count": "max"}).first()[0] <= 3
    assert found[0] == found[1]


@pytest.mark.parametrize("kind", ["null", "equal", "mixed"])
def test_one_day_without_useful_tiebreaks_is_cut(spark, kind):
    """No lane, and no task, is above twice the limit, and each event has the neighbours it has in one order of the day."""
    limit, n = 200, 6000
    key = {"null": "CAST(NULL AS bigint)", "equal": "5L", "mixed": "nullif(id % 3, 0)"}[kind]
    day = spark.range(n).selectExpr("1L AS patid", "DATE '2020-01-01' AS apptdate", f"{key} AS attendkey", "id")
    lanes = plan_lanes(day, limit=limit)
    laned = lanes.assign(day)
    assert laned.groupBy(LANE).count().agg({"count": "max"}).first()[0] <= 2 * limit
    near = E.with_neighbours(day, lanes, ["patid"], previous={"before": "id"}, following={"after": "id"}, size="n")
    rows = {r.id: (r.before, r.after, r.n) for r in near.collect()}
    order = [r.id for r in sorted(
        laned.select("id", "attendkey", TIE).collect(), key=lambda r: (r.attendkey is None, r.attendkey or 0, r[TIE]))]
    for before, own, after in zip([None, *order], order, [*order[1:], None]):
        assert rows[own] == (before, after, n)


def test_tasks_of_a_heavy_day_stay_small(spark):
    n = 64_000
    day = spark.range(n).selectExpr("1L AS patid", "DATE '2020-01-01' AS apptdate", "CAST(NULL AS bigint) AS attendkey", "id")
    spread = plan_lanes(day, limit=500).assign(day).repartition(16, KEY, LANE)
    largest = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2 * n / 16


def test_found_lanes_equal_planned_lanes(spark, tmp_path):
    df = skewed(spark)
    planned, found = plan_lanes(df, limit=20), find_lanes(df, str(tmp_path / "low"), limit=20)
    assert not found.none
    for part in ("hot", "hot_days"):
        assert sorted(map(repr, getattr(planned, part).collect())) == sorted(map(repr, getattr(found, part).collect()))
    build = lambda lanes: E.with_neighbours(df, lanes, ["patid"], previous={"p": "attendkey"}, size="n")
    assert sorted(map(repr, build(found).collect())) == sorted(map(repr, build(planned).collect()))


def test_without_heavy_entities_plans_have_no_branch_for_them(spark, tmp_path):
    df = skewed(spark)
    found = find_lanes(df, str(tmp_path / "high"), limit=10**6)
    assert found.none and not (tmp_path / "high").exists()
    near = E.with_neighbours(df, found, ["patid"], previous={"p": "attendkey"}, size="n")
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    plain = E.with_neighbours(df, plan_lanes(df), ["patid"], previous={"p": "attendkey"}, size="n")
    assert sorted(map(repr, near.collect())) == sorted(map(repr, plain.collect()))
    assert find_lanes(df.limit(0), str(tmp_path / "empty")).none
