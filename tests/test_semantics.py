from datetime import date

from pyspark.sql import functions as F

from visitflow import params as P
from visitflow.functions import semantics as S


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_unknown_condition_gives_null(spark):
    rows = [(1,), (2,), (None,)]
    assert values(spark, rows, "a int", S.if_known(F.col("a") == 1, "yes", "no")) == ["yes", "no", None]


def test_membership_is_never_null(spark):
    assert values(spark, [(1,), (None,)], "a int", ~S.is_in(F.col("a"), [1])) == [False, True]


def test_sentinels(spark):
    rows = [(9,), (99,), (3,), (None,)]
    assert values(spark, rows, "a int", S.null_if_in(F.col("a"), (9, 99))) == [None, None, 3, None]
    assert values(spark, rows, "a int", S.null_if_in(F.col("a"), (9,))) == [None, 99, 3, None]


def test_attendance_of_unknown_codes_is_missed(spark):
    label = S.code_label(
        F.col("a"), {P.ATTENDED: P.ATTENDED_CODES, P.CANCELLED: P.CANCELLED_CODES}, default=P.MISSED
    )
    assert values(spark, [(None,), (0,), (3,), (7,)], "a int", label) == [P.MISSED] * 4
    assert values(spark, [(5,), (6,), (2,), (4,)], "a int", label) == [P.ATTENDED] * 2 + [P.CANCELLED] * 2


def test_band_edges(spark):
    weeks = [0, 1, 2, 6, 7, 17, 18, 30, 31, 41, 42, -1, None]
    got = values(spark, [(w,) for w in weeks], "a int", S.band(F.col("a"), P.BAND_EDGES, P.BAND_LABELS))
    assert got == ["1 week"] * 2 + ["1 month"] * 2 + ["3 months"] * 2 + ["6 months"] * 2 + ["9 months"] * 2 + [
        "12 months", None, None]


def test_calendar_week_starts_on_new_years_day(spark):
    days = [date(2017, 1, 1), date(2017, 1, 7), date(2017, 1, 8), date(2016, 12, 31)]
    assert values(spark, [(d,) for d in days], "d date", S.calendar_week(F.col("d"))) == [1, 1, 2, 53]


def test_relative_week(spark):
    start = date(2016, 12, 1)
    days = [start, date(2016, 12, 7), date(2016, 12, 8), date(2017, 11, 30)]
    assert values(spark, [(d,) for d in days], "d date", S.relative_week(F.col("d"), F.lit(start))) == [1, 1, 2, 53]
    assert P.StudyParams().sim_weeks == 53


def test_weeks_round_up(spark):
    assert values(spark, [(0,), (1,), (7,), (8,)], "a int", S.weeks_up(F.col("a"))) == [0, 1, 1, 2]


def test_rounding_is_half_even(spark):
    rows = [(1, 8), (3, 8), (23, 40), (1, 3), (1, 0)]
    assert values(spark, rows, "a int, b int", S.share_rounded(F.col("a"), F.col("b"), 2)) == [
        0.12, 0.38, 0.58, 0.33, None]


def test_percent_text(spark):
    rows = [(1, 8), (1, 800), (1, 0)]
    assert values(spark, rows, "a int, b int", S.percent_with_n(F.col("a"), F.col("b"), 1)) == [
        "12.5% (1)", "0.1% (1)", "- (1)"]
    assert values(spark, rows, "a int, b int", S.percent_text(F.col("a"), F.col("b"), 0)) == ["12%", "0%", "-"]


def test_level_rank(spark):
    assert values(spark, [("b",), ("a",), ("z",), (None,)], "a string", S.level_rank(F.col("a"), ["b", "a"])) == [
        1, 2, None, None]
