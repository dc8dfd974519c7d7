"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from visitflow.operators.tabulate import cells  # noqa: E402
from visitflow.plans import tables as R  # noqa: E402
from visitflow.plans.jobs import COHORT_CELLS  # noqa: E402
from visitflow.plans.queries import STUDY, Inputs, all_queries  # noqa: E402
from visitflow.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = [
    "clean_appointments", "derive_sequence", "transition_matrix_prop", "cumulative_by_week", "patient_week_grid",
    "weekly_firstatt_outcome", "table_one_all", "impute_outcome_type", "missed_gap_mean_st", "dedupe_keep_first",
]


COHORT_TABLES = [
    R.last_interval_distribution, R.attendance_by_last_counts, R.attendance_by_last_shares, R.new_attendance_percent,
    R.new_next_counts, R.new_next_shares, R.transition_shares, R.transition_counts, R.transition_wide,
    lambda d: R.transition_wide(d, "count"), lambda d: R.weekly_new(d, STUDY),
    lambda d: R.weekly_existing_index(d, STUDY), lambda d: R.cumulative_by_week(d, STUDY), R.count_by_week,
    R.missed_gap_means,
]


def execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def extra(spark) -> dict[str, float]:
    """Variants: the patient spine, and ways to share one cohort among its tables (``BENCH_EXTRA=1``)."""
    timeline = all_queries()["cumulative_timeline"]

    def cohort():
        return Inputs(spark, SF_DIR).indexed

    def tables(data):
        for table in COHORT_TABLES:
            execute(table(data))

    def shared(data):
        data.persist()
        tables(data)
        data.unpersist()

    return {
        "cumulative_by_week over patient timelines": timed(lambda: execute(
            timeline(spark, SF_DIR).groupBy("diabetes_type", "sim_week").agg(F.sum("cumulative_appt_count")))),
        "cohort tables, each from raw": timed(lambda: tables(cohort())),
        "cohort tables, cohort persisted": timed(lambda: shared(cohort())),
        "cohort tables, cells persisted": timed(lambda: shared(cells(cohort(), COHORT_CELLS))),
    }


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "8g"))
    queries = all_queries()
    medians = {name: timed(lambda: execute(queries[name](spark, SF_DIR))) for name in HEADLINE}
    result = {
        "metric": "sum of median warm query times", "value": round(sum(medians.values()), 3), "unit": "sec",
        "queries": medians, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "runs": RUNS,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    if os.environ.get("BENCH_EXTRA"):
        result["extra"] = extra(spark)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
