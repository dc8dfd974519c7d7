import pytest
from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.operators import quality as Q
from visitflow.operators import tabulate as T
from visitflow.operators import timeline as L
from visitflow.plans import tables as R

ROWS = [
    (1, "type1", "New", "Attended", 1), (1, "type1", "Follow up", "Cancelled", 2),
    (2, "type1", "Follow up", "Attended", 2), (3, "type2", None, "Attended", 53),
    (3, "type2", "Follow up", "Did Not Attend", 3), (None, "type2", "Follow up", "Attended", 3),
]


@pytest.fixture()
def events(spark):
    return spark.createDataFrame(
        ROWS, "patid int, diabetes_type string, firstatt_agg string, attended_agg string, sim_week int"
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tabulate_keeps_missing_and_margins_drop_it(events):
    assert rows(T.tabulate(events, "diabetes_type", "firstatt_agg", P.TYPE_LEVELS)) == [
        ("type1", 1, 2, 0), ("type2", 0, 2, 1)]
    assert rows(T.crosstab_margins(events, "diabetes_type", "firstatt_agg", P.TYPE_LEVELS)) == [
        ("Sum", 1, 4, 5), ("type1", 1, 2, 3), ("type2", 0, 2, 2)]


def test_tabulate_lists_levels_without_events(events):
    new = events.where("firstatt_agg = 'New'")
    table = T.tabulate(new, "firstatt_agg", "attended_agg", P.ATTENDANCE_LEVELS, P.TYPE_LEVELS, with_na=False)
    assert rows(table) == [("Follow up", 0, 0, 0), ("New", 1, 0, 0)]
    text = rows(T.row_percent_text(table, "firstatt_agg", P.ATTENDANCE_LEVELS, 0))
    assert text[0][:4] == ("Follow up", "- (0)", "- (0)", "- (0)")


def test_ratio_without_new_events_is_null(events):
    got = {r.diabetes_type: (r.new_fu_ratio, r.new_fu_ratio_1dp) for r in R.follow_up_ratio(events).collect()}
    assert got == {"type1": (2.0, 2.0), "type2": (None, None)}


def test_complete_adds_observed_combinations_and_keeps_the_sum(spark):
    tally = spark.createDataFrame(
        [(2016, 1, "t1", 1, 4), (2017, 2, "t1", None, 5), (2017, 1, "t1", 1, 6)],
        "year int, week int, type string, outcome int, n bigint",
    )
    full = T.complete(tally, ["year", "week", "type", "outcome"]).collect()
    assert len(full) == 8 and sum(r.n for r in full) == 15
    assert {r.outcome for r in full} == {1, None}
    assert T.complete(tally.limit(0), ["year", "week"]).count() == 0


def test_complete_reads_its_tally_once(events):
    full = T.tally_complete(events, ["diabetes_type", "firstatt_agg", "sim_week"])
    full.collect()
    assert "ReusedExchange" in full._jdf.queryExecution().executedPlan().toString()


def test_one_way_shares(events):
    got = {r.firstatt_agg: (r.n, r.percent, r.valid_percent) for r in T.one_way(events, "firstatt_agg").collect()}
    assert got == {"New": (1, 1 / 6, 1 / 5), "Follow up": (4, 4 / 6, 4 / 5), None: (1, 1 / 6, None)}


def test_shares_sum_to_one(events):
    per_type = T.share_within(events, ["diabetes_type"], ["attended_agg"]).groupBy("diabetes_type").agg(F.sum("prop"))
    assert [r[1] for r in per_type.collect()] == [pytest.approx(1.0)] * 2


def test_spread_leaves_absent_cells_null(events):
    wide = T.spread_counts(events, ["diabetes_type"], "firstatt_agg", P.TYPE_LEVELS)
    assert rows(wide) == [("type1", 1, 2), ("type2", None, 2)]


def test_summary_lists_missing_and_absent_levels(events):
    table = T.summary_table(events, ["firstatt_agg", "sim_week"], "diabetes_type", ("type1", "type2"), with_missing=True)
    got = {(r.variable, r.level, r.diabetes_type): r.n for r in table.collect()}
    assert got[("firstatt_agg", "NA", "type2")] == 1 and got[("firstatt_agg", "NA", "type1")] == 0
    assert got[("sim_week", "53", "type1")] == 0
    detail = T.summary_detail(table, "diabetes_type").where("variable = 'sim_week' AND diabetes_type = 'type2'")
    assert [r.cum_percent for r in detail.orderBy("cum_percent").collect()][-1] == 100.0


def test_distinct_counts_missing_as_one(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "patid int")
    assert df.agg(Q.distinct_with_null("patid")).first()[0] == 2
    assert df.where("patid = 1").agg(Q.distinct_with_null("patid")).first()[0] == 1


def test_attrition_counts_rows_and_entities(events):
    steps = {
        "all": F.lit(True), "known": F.col("firstatt_agg").isNotNull(), "seen": F.col("attended_agg") == "Attended",
    }
    assert rows(Q.attrition(events, steps, "patid")) == [(1, "all", 6, 4), (2, "known", 5, 4), (3, "seen", 3, 3)]
    twice = events.withColumn("copies", F.lit(2))
    assert rows(Q.attrition(twice, steps, "patid", "copies", "known")) == [
        (1, "all", 12, 4), (2, "known", 5, 4), (3, "seen", 3, 3)]


def test_null_profile(events):
    got = {r.column_name: r.n_null for r in Q.null_profile(events).collect()}
    assert got == {"patid": 1, "diabetes_type": 0, "firstatt_agg": 1, "attended_agg": 0, "sim_week": 0}


def test_small_cells_are_raised(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (10,), (11,)], "n bigint").coalesce(1)
    assert [r.n for r in Q.suppress_small_cells(df, ["n"]).collect()] == [0, 10, 10, 10, 11]


def test_week_grid_forms_agree(events):
    ids = ["patid", "diabetes_type"]
    grid = L.week_grid(events, ids, "sim_week", 53)
    assert grid.count() == 4 * 53 and grid.agg(F.sum("n")).first()[0] == 6
    long = L.week_grid(events, ids, "sim_week", 53, "c", running=True)
    wide = L.gather_weeks(L.week_matrix(events, ids, "sim_week", 53, running=True), ids, "sim_week", "c", 53)
    assert rows(long) == rows(wide)


def test_running_totals_of_patients_add_up_to_the_weekly_total(events):
    params = P.StudyParams()
    by_patient = L.week_grid(events, ["patid", "diabetes_type"], "sim_week", 53, "c", running=True)
    summed = by_patient.groupBy("diabetes_type", "sim_week").agg(F.sum("c").alias("cum_wk_appt"))
    direct = R.cumulative_by_week(events, params).select(*summed.columns)
    assert rows(summed) == rows(direct)
    assert {r.cum_wk_appt for r in direct.where("sim_week = 53").collect()} == {3}


def test_tables_read_cells_like_events(events):
    counted = T.cells(events, ["diabetes_type", "firstatt_agg", "attended_agg", "sim_week"])
    for table in (
        R.kinds_by_type, R.follow_up_ratio, R.attendance_percent_by_type, R.new_attendance_percent, R.count_by_week,
        lambda d: R.attendance_percent_by_kind(d, "type1"), lambda d: R.weekly_new(d, P.StudyParams()),
        lambda d: R.cumulative_by_week(d, P.StudyParams()), lambda d: T.one_way(d, "firstatt_agg"),
        lambda d: T.summary_table(d, ["firstatt_agg"], "diabetes_type", ("type1", "type2")),
        lambda d: T.crosstab_share(d, "diabetes_type", "attended_agg", 3),
    ):
        assert rows(table(counted)) == rows(table(events))
    gaps = events.withColumn("gap", F.when(F.col("sim_week") < 50, F.col("sim_week")))
    by_cell = T.cells(gaps, ["diabetes_type", "gap"])
    assert rows(gaps.groupBy("diabetes_type").agg(T.mean_over_events(gaps, "gap"))) == rows(
        by_cell.groupBy("diabetes_type").agg(T.mean_over_events(by_cell, "gap")))


def test_total_and_missing_names_as_values(spark):
    rows = spark.createDataFrame([("Sum", "p"), ("y", "p"), ("y", "q")], "a string, b string")
    table = sorted(tuple(r) for r in T.crosstab_margins(rows, "a", "b", ["p", "q"]).collect())
    assert table == [("Sum", 1, 0, 1), ("Sum", 2, 1, 3), ("y", 1, 1, 2)]
    rows = spark.createDataFrame([("NA", "s"), (None, "s"), ("x", "s")], "v string, g string")
    summary = T.summary_table(rows, ["v"], "g", ["s"], with_missing=True)
    assert sorted((r.level, r.missing, r.n) for r in summary.collect()) == [("NA", False, 1), ("NA", True, 1), ("x", False, 1)]
    assert {(r.miss, r.n) for r in T.summary_detail(summary, "g").collect()} == {(1, 3)}


def test_levels_that_are_not_listed_are_an_error(spark):
    df = spark.createDataFrame([("a", "p"), ("a", None), ("b", "zz")], "k string, v string")
    assert [tuple(r) for r in T.tabulate(df.where("k = 'a'"), "k", "v", ["p"]).collect()] == [("a", 1, 1)]
    with pytest.raises(Exception, match="not listed"):
        T.tabulate(df, "k", "v", ["p"]).collect()


def test_levels_with_one_column_name_are_an_error(spark):
    with pytest.raises(ValueError, match="column name"):
        T.tabulate(spark.createDataFrame([("a", "1 week")], "k string, v string"), "k", "v", ["1 week", "1_week"])


def test_nothing_small_follows_from_a_protected_table(spark):
    """All margins, shares and printed cells come from the raised counts, so they say no more than these do."""
    counts = {("a", "x"): 3, ("a", "y"): 40, ("b", "x"): 12, ("b", "y"): 9, ("c", "x"): 1, (None, "y"): 2}
    df = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "r string, c string")
    safe = T.protected_cells(df, ["r", "c"])
    raised = {k: max(n, 10) for k, n in counts.items()}
    assert {(r.r, r.c): r[T.WEIGHT] for r in safe.collect()} == raised
    assert rows(T.crosstab_margins(safe, "r", "c", ["x", "y"])) == [
        ("Sum", 32, 50, 82), ("a", 10, 40, 50), ("b", 12, 10, 22), ("c", 10, 0, 10)]
    table = T.row_percent_text(T.tabulate(safe, "r", "c", ["x", "y"], with_na=False), "r", ["x", "y"], 1)
    assert [r for r in rows(table) if r[0] == "c"] == [("c", "100.0% (10)", "0.0% (0)", 10, 0)]
    assert {(r.r, r.c): r.prop for r in T.share_within(safe, ["r"], ["c"]).collect()}["a", "x"] == 0.2
    summary = T.summary_table(df.withColumn("s", F.lit("all")), ["r", "c"], "s", ["all"], floor=10).collect()
    assert {(r.variable, r.level): r.n for r in summary}["r", "c"] == 10 and all(r.n == 0 or r.n >= 10 for r in summary)


def test_unlisted_values_are_errors_or_counted_apart(spark):
    df = spark.createDataFrame([("a", 1), ("a", 8), ("b", 9), ("b", None), ("b", 2)], "r string, c int")
    with pytest.raises(Exception, match="not listed"):
        T.tabulate(df, "r", "c", [1, 2]).collect()
    assert rows(T.tabulate(df, "r", "c", [1, 2], other=True)) == [("a", 1, 0, 0, 1), ("b", 0, 1, 1, 1)]
    flags = spark.createDataFrame([(8, 1, 1), (2, None, 0)], "lead_firstatt int, discharged_coded int, discharged int")
    found = {(r.stage, r.discharged): (r.next_2, r.next_other) for r in R.backfill_audit(flags, other=True).collect()}
    assert found == {("before", 1): (0, 1), ("before", None): (1, 0), ("after", 1): (0, 1), ("after", 0): (1, 0)}
