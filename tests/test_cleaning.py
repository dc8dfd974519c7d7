from datetime import date

import pytest
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.operators import cleaning as C
from visitflow.operators.lanes import attach, plan_lanes
from visitflow.operators.sequence import top_1_per_group
from visitflow.sources.fixtures import APPOINTMENT_RULES

EVENTS = "patid bigint, attendkey bigint, apptdate date"


def small(spark, *rows):
    return spark.createDataFrame(rows, EVENTS)


def test_recode(spark):
    df = spark.createDataFrame(
        [("X", 9, 7003, 99), ("9", 5, 34, 9), ("3", None, 7001, 2), ("abc", 2, None, None)],
        "firstatt string, attended int, apptage int, stafftyp int",
    )
    assert [tuple(r) for r in C.recode_sentinels(df).collect()] == [
        (None, None, 0, None), (None, 5, 34, None), (3, None, 0, 2), (None, 2, None, None)]


@pytest.mark.parametrize("limit", [1000, 1])
def test_death_date_is_strict(spark, limit):
    day = date(2017, 5, 5)
    df = small(spark, (1, 1, day), (1, 2, date(2017, 5, 4)), (2, 3, day), (1, 4, None), (2, 5, None), (3, 6, day))
    deaths = spark.createDataFrame([(1, day), (2, None)], "patid bigint, ons_dod date")
    kept = C.before_death(attach(df, deaths, plan_lanes(df, limit=limit), ["ons_dod"]))
    assert sorted(r.attendkey for r in kept.collect()) == [2, 3, 5, 6]


@pytest.mark.parametrize("limit", [1000, 1])
@pytest.mark.parametrize("how,expected", [("left", [1, 2, 3, 4]), ("inner", [1, 2, 3]), ("semi", [1, 2, 3])])
def test_attach_matches_missing_keys(spark, limit, how, expected):
    day = date(2017, 1, 1)
    df = small(spark, (None, 1, day), (None, 2, day), (1, 3, day), (0, 4, day))
    dim = spark.createDataFrame([(None, "none"), (1, "one")], "patid bigint, kind string")
    got = attach(df, dim, plan_lanes(df, limit=limit), ["kind"], how)
    assert sorted(r.attendkey for r in got.collect()) == expected
    if how != "semi":
        assert {r.attendkey: r.kind for r in got.collect()}[1] == "none"


@pytest.mark.parametrize("limit", [1000, 1])
def test_repeated_dimension_key_is_an_error(spark, limit):
    df = small(spark, (1, 1, date(2017, 1, 1)), (1, 2, date(2017, 1, 1)))
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "patid bigint, kind string")
    with pytest.raises(Exception, match="more than one row"):
        attach(df, dim, plan_lanes(df, limit=limit), ["kind"]).collect()
    assert attach(df, dim, plan_lanes(df, limit=limit), [], "semi").count() == 2


def test_dedupe_keeps_the_lowest_tiebreak_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, 5, None, "b"), (1, 3, None, "a"), (1, 4, 7, "c")], "patid int, attendkey int, outcome int, note string"
    )
    once = C.dedupe_keep_first(df, ["patid", "outcome"])
    assert sorted((r.attendkey, r.note) for r in once.collect()) == [(3, "a"), (4, "c")]
    assert C.dedupe_keep_first(once, ["patid", "outcome"]).count() == 2


def test_lookup_with_repeated_codes_adds_no_rows(spark):
    df = spark.createDataFrame([("307",), ("999",), (None,)], "tretspef string")
    lookup = spark.createDataFrame(
        [("307", "B"), ("307", "A"), (None, "none")], "tretspef string, tretspef_name string"
    )
    got = {(r.tretspef, r.tretspef_name) for r in C.join_lookup(df, lookup).collect()}
    assert got == {("307", "A"), ("999", None), (None, "none")}


def test_lookup_has_no_broadcast_of_its_own(spark):
    df = spark.createDataFrame([("307",), ("999",)], "tretspef string")
    lookup = spark.createDataFrame([("307", "A"), ("999", "B")], "tretspef string, tretspef_name string")
    joined = C.join_lookup(df, lookup)
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()  # Spark chooses by measured size
    assert {r.tretspef_name for r in joined.collect()} == {"A", "B"}


def test_copies_are_merged_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 1).alias("patid"), F.col("id").alias("attendkey"),
        F.when(F.col("id") < 0, 1).alias("outcome"), (F.col("id") * 2).alias("other"),
    )
    kept = C.dedupe_keep_first(df, ["patid", "outcome"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("functions=[min(") < plan.index("Exchange") < plan.index("functions=[partial_min(")
    assert [(r.attendkey, r.other) for r in kept.collect()] == [(0, 0)]


def test_top_1_keeps_one_row_per_group_and_task_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    kept = top_1_per_group(df, ["k"], [F.col("id").desc()])
    assert kept._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted(r.id for r in kept.collect()) == [997, 998, 999]


def test_required_field_test_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "2", 3)], "tretspef string, firstatt string, attended int").write.parquet(path)
    plan = C.filter_required(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tretspef), IsNotNull(firstatt), IsNotNull(attended)]" in plan


def test_copies_with_tied_and_null_tiebreaks(spark):
    rows = spark.createDataFrame(
        [(1, 7, None, "b"), (1, 7, "a", None), (1, 7, "a", "c"), (2, None, "a", "x"), (2, None, "b", "y"), (3, None, "z", "z"),
         (3, 5, "k", "k")], "k int, attendkey int, u string, v string")
    found = {r.k: (r.attendkey, r.u, r.v) for r in C.dedupe_keep_first(rows, ["k"]).collect()}
    assert found == {1: (7, None, "b"), 2: (None, "a", "x"), 3: (5, "k", "k")}


def test_keys_in_any_letter_case(spark):
    rows = spark.createDataFrame([(1, 1, 2010, 9), (1, 2, 2011, 9)], "patid int, attendkey int, HES_yr int, Attended int")
    assert C.dedupe_keep_first(rows, ["patid", "hes_yr"]).count() == 2
    assert {r.Attended for r in C.recode_sentinels(rows).collect()} == {None}
    with pytest.raises(ValueError, match="absent"):
        C.dedupe_keep_first(rows, ["patid", "priority"])


def test_numbers_and_dates_beside_the_keys_need_no_sort(spark):
    rows = [
        (1, 7, 5, date(2020, 1, 2)), (1, 7, 5, date(2020, 1, 1)), (1, 7, None, date(2030, 1, 1)), (2, None, 1, None),
        (2, None, -1, date(1900, 1, 1)), (2, None, -1, None), (3, None, 9, None), (3, -(1 << 31), 8, None), (3, (1 << 31) - 1, 0, None),
        (None, 0, 0, None), (None, -1, 2147483647, date(2020, 1, 1)), (None, -1, -2147483648, None), (None, -1, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, attendkey int, u int, d date").repartition(5)
    kept = C.dedupe_keep_first(df, ["k"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    first = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or 0, r[3] is not None, r[3] or date.min)
    wanted = {k: min((r for r in rows if r[0] == k), key=first) for k in {r[0] for r in rows}}
    assert {r.k: tuple(r) for r in kept.collect()} == wanted


def test_keys_and_tiebreak_alone_need_no_sort(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (1, 1), (2, None), (2, None)], "k int, attendkey bigint")
    kept = C.dedupe_keep_first(df, ["k"])
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (2, None)]


def test_all_keys_are_in_the_mapping():
    assert set(P.DEDUPE_KEYS) <= set(APPOINTMENT_RULES)
