import glob
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from visitflow.operators.lanes import plan_lanes
from visitflow.operators.quality import null_profile
from visitflow.operators.timeline import gather_weeks, week_grid
from visitflow.plans import datasets as D
from visitflow.plans import jobs
from visitflow.plans.queries import all_queries
from visitflow.sources import fixtures as X
from visitflow.sources import tables as S


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    sources = jobs.Sources(
        X.appointments(spark, sf_dir), X.patients(spark, sf_dir), X.patient_types(spark, sf_dir),
        X.specialties(spark, sf_dir),
    )
    return jobs.run(sources, X.STUDY, str(tmp_path_factory.mktemp("run")), lane_rows=5, prefix="visitflow")


def read(spark, path, schema):
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA")


PAIRS = {
    "weekly_new": "weekly_new", "weekly_existing_index": "weekly_existing_index", "count_by_week": "count_by_week_type",
    "cumulative_by_week": "cumulative_by_week", "type_by_kind": "tab_type_by_newfu",
    "last_interval_clinic": "last_interval_dist_cl", "new_next_count_study": "new_next_count_st",
    "missed_gap_clinic": "missed_gap_mean_cl", "missed_gap_study": "missed_gap_mean_st",
    "weekly_all_years_kind": "weekly_firstatt", "weekly_imputed_kind_outcome": "imputed_weekly_firstatt_outcome",
    "weekly_check_cohort_outcome": "cohort_weekly_outcome", "events_per_patient": "mean_appts_per_patient",
    "attendance_percent_type1": "attendance_pct_type1", "backfill_audit": "backfill_audit",
    "attendance_share_by_status": "crosstab_prop_transposed", "attrition": "cohort_attrition",
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_job_tables_equal_the_queries(spark, sf_dir, written, name):
    """The job reads staged tables and cells, with nearly every patient treated as heavy."""
    expected = all_queries()[PAIRS[name]](spark, sf_dir)
    got = read(spark, written[name], expected.schema).select(*expected.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


@pytest.mark.parametrize("limit", [5, 10**6])
def test_steps_on_staged_tables_do_not_shuffle_events(spark, written, limit):
    """What is shuffled are summary rows of heavy patients only, also for windows on more than the patient."""
    cleaned = spark.table("visitflow_cleaned")
    lanes = replace(plan_lanes(cleaned, limit=5), placed=True)
    if limit > 5:
        lanes = replace(lanes, hot=lanes.hot.limit(0), hot_days=lanes.hot_days.limit(0))
    for step in (D.study_dataset, D.derive_sequence):
        df = step(cleaned, X.STUDY, lanes)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = final.splitlines()
        events = [n for n, x in enumerate(lines) if "Exchange hashpartitioning(__key" in x]
        assert len(events) == (1 if limit == 5 else 0), final
        assert all("Aggregate(key" in next(x for x in lines[n + 1:] if "Project" not in x) for n in events), final
        assert "REPARTITION" not in final


def test_raw_profile_is_observed_while_copies_are_merged(spark, sf_dir, written):
    expected = null_profile(X.appointments(spark, sf_dir))
    got = read(spark, written["raw_null_profile"], expected.schema).select(*expected.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


@pytest.mark.parametrize("buckets", [2, 64])
def test_any_number_of_buckets_gives_the_same_and_raw_is_read_for_staging_only(spark, sf_dir, written, tmp_path, buckets):
    sources = jobs.Sources(
        X.appointments(spark, sf_dir), X.patients(spark, sf_dir), X.patient_types(spark, sf_dir), X.specialties(spark, sf_dir))
    data = jobs.stage(sources, X.STUDY, str(tmp_path), prefix=f"visitflow_{buckets}", buckets=buckets)
    assert len(glob.glob(str(tmp_path / "cleaned" / "part-*"))) <= buckets
    counted = jobs.count_cells(data, X.STUDY, str(tmp_path))
    tables = jobs.result_tables(replace(sources, appointments=None), data, counted, X.STUDY)
    for name in ("attrition", "raw_null_profile", "weekly_new", "missed_gap_study", "last_interval_clinic"):
        got = tables[name]
        want = read(spark, written[name], got.schema).select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    safe = jobs.result_tables(replace(sources, appointments=None), data, counted, X.STUDY, small_cell=200)["attendance_margins"]
    for row in safe.collect():
        cells = [row[c] for c in safe.columns if c not in ("diabetes_type", "sum")]
        assert sum(cells) == row["sum"] and all(n == 0 or n >= 200 for n in cells)


def test_buckets_and_files_follow_the_rows(spark, tmp_path):
    assert [S.bucket_count(n, 100) for n in (0, 1, 100, 101, 200, 201, 100_000, 10**12)] == [1, 1, 1, 2, 2, 4, 1024, S.MOST_BUCKETS]
    path = str(tmp_path / "t")
    table = S.write_bucketed(spark.range(1000), "bucketed_small_files", path, ["id"], buckets=2, rows_per_file=100)
    sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{path}/part-*")]
    assert sum(sizes) == table.count() == 1000 and max(sizes) <= 100
    plan = table.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("line", ["308", "308,Name,more"])
def test_malformed_lookup_lines_are_errors(spark, tmp_path, line):
    path = tmp_path / "lookup.csv"
    path.write_text(f"tretspef,tretspef_name\n307,Diabetic Medicine\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_code_lookup(spark, str(path)).collect()


def test_timelines_are_staged_as_parquet(spark, sf_dir, written):
    data = written["weekly_new"].rsplit("/results/", 1)[0] + "/data"
    for folder, name in (("timeline", "patient_week_grid"), ("running_totals", "cumulative_timeline")):
        expected = all_queries()[name](spark, sf_dir)
        got = spark.read.parquet(f"{data}/{folder}")
        if folder == "running_totals":
            got = gather_weeks(got, ["patid", "diabetes_type"], "sim_week", "cumulative_appt_count", X.STUDY.sim_weeks)
        got = got.select(*expected.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_small_counts_are_raised_on_request_and_keys_are_not(spark):
    table = spark.createDataFrame([(3, 2, 0.5, 0), (4, 12, 0.1, 1)], "week bigint, n bigint, share double, new bigint")
    assert [tuple(r) for r in jobs.protected(table, 10).collect()] == [(3, 10, 0.5, 0), (4, 12, 0.1, 10)]
    assert jobs.protected(table, None) is table


def test_one_folder_per_matrix(spark, written):
    groups = {path.rsplit("=", 1)[1] for path in glob.glob(f"{written['transition_prop']}/group_name=*")}
    assert {"New_type1", "New_type2"} <= groups and any("Follow" in g for g in groups)


def test_csv_writes_na_and_returns_its_input(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, 2)], "k string, n int").coalesce(1)
    assert S.write_result_csv(df, str(tmp_path / "out")) is df
    text = open(glob.glob(str(tmp_path / "out" / "*.csv"))[0]).read()
    assert text.split() == ["k,n", "a,NA", "NA,2"]


def test_staged_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.range(5), path)
    assert S.write_table(spark.range(3), path).count() == 3


def test_bucketed_table_is_replaced_and_has_one_file_per_bucket(spark, tmp_path):
    for rows, folder in ((50, "a"), (30, "b"), (40, "b")):
        path = str(tmp_path / folder)
        assert S.write_bucketed(spark.range(rows), "bucketed_copy", path, ["id"]).count() == rows
        assert len(glob.glob(f"{path}/part-*")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lookup_codes_stay_text(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text("tretspef,tretspef_name\n007,Seven\n307,Diabetic Medicine\n")
    assert [r.tretspef for r in S.read_code_lookup(spark, str(path)).collect()] == ["007", "307"]


def test_declared_schema_reads_raw_appointments(spark, sf_dir, tmp_path):
    path = str(tmp_path / "raw")
    X.appointments(spark, sf_dir).write.parquet(path)
    table = S.read_table(spark, path, S.APPOINTMENTS)
    assert table.count() == spark.read.parquet(path).count()
    assert table.agg(F.count("ethnos")).first()[0] == 0


def test_grid_counts_what_lies_outside_the_weeks_as_before(spark):
    """Running totals take in earlier weeks; an entity without a known week has zeros."""
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (1, 9), (2, None), (None, 1)], "id int, w int")
    plain = {(r.id, r.w): r.n for r in week_grid(df, ["id"], "w", 3).collect()}
    total = {(r.id, r.w): r.n for r in week_grid(df, ["id"], "w", 3, running=True).collect()}
    assert plain == {(1, 1): 0, (1, 2): 2, (1, 3): 0, **{(2, w): 0 for w in (1, 2, 3)}, (None, 1): 1, (None, 2): 0, (None, 3): 0}
    assert total == {(1, 1): 1, (1, 2): 3, (1, 3): 3, **{(2, w): 0 for w in (1, 2, 3)}, **{(None, w): 1 for w in (1, 2, 3)}}
