import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from oracle.sql import all_oracles
from tests.compare import difference, duck, duck_rows, spark_rows
from visitflow.operators.cleaning import clean_appointments
from visitflow.operators.lanes import plan_lanes
from visitflow.plans.datasets import study_dataset
from visitflow.plans.queries import STUDY, Inputs, all_queries

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    """Only the operators for training data may have none, where SQL can't express them; tests/llm has their checks."""
    assert set(all_queries()) == set(all_oracles())
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(spark_rows(df), duck_rows(con, ORACLES[name])) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan


def test_matrix_invariants(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    matrix = QUERIES["transition_matrix_prop"](spark, sf_dir)
    sums = matrix.groupBy("group_name", "appt_int_last_binned").agg(F.sum("prop").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    assert matrix.agg(F.sum("n")).first()[0] == i.cohort.count()


def test_study_period_counts_are_the_restricted_all_year_counts(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    total = QUERIES["study_weekly_firstatt"](spark, sf_dir).agg(F.sum("n")).first()[0]
    assert total == i.checked_window.count()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["filter_window_closed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_quantity" not in plan


def test_study_dataset_shuffles_events_twice(spark, sf_dir):
    """Once to remove copies, once for the person join and the windows together."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["study_dataset"](spark, sf_dir)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
    events = [s for s in shuffles if "__key" in s or "admincat" in s]
    assert len(events) == 2, "\n".join(shuffles)


def test_study_filters_reach_the_scan_below_the_join_and_the_merge_of_copies(spark, sf_dir, tmp_path):
    i = Inputs(spark, sf_dir)
    i.raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    lanes = plan_lanes(raw)
    cleaned = clean_appointments(raw, i.patients, i.patient_types, None, lanes)
    study = study_dataset(cleaned, STUDY, lanes).select("patid", "appt_int_last_binned")
    plan = study._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "/raw" in line]
    main = scans[0]
    for pushed in ("EqualTo(tretspef,307)", "GreaterThan(apptdate,1997-12-01)", "IsNotNull(tretspef)"):
        assert pushed in main, main
    assert "apptage" not in main
    counting = [line for line in scans if "ReadSchema: struct<patid:bigint>" in line]
    assert counting, "heavy keys are counted from the key column alone"
