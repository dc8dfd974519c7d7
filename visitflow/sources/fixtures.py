"""Appointment, patient and lookup tables derived from the order-and-shipment test tables.

The column rules are SQL text valid both in Spark and in DuckDB; only the input mapping is shared between the two,
never an operator.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.params import StudyParams

STUDY = StudyParams(
    study_start=date(1997, 12, 1),
    sim_start=date(1998, 12, 1),
    sim_end=date(1999, 11, 30),
    check_start=date(1997, 12, 1),
    check_end=date(1998, 11, 26),
    calendar_start=date(1996, 1, 1),
)

APPOINTMENT_RULES = {
    "patid": "o_custkey",
    "attendkey": "((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber",
    "apptdate": "CAST(l_shipdate AS DATE)",
    "tretspef": "CASE WHEN l_quantity <= 30 THEN '307' WHEN l_quantity <= 40 THEN '300' "
                "WHEN l_quantity <= 48 THEN '130' END",
    "firstatt": "CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '4' WHEN 4 THEN '2' WHEN 5 THEN '3' "
                "WHEN 6 THEN '5' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'X' ELSE '9' END END",
    "attended": "CASE CAST(floor(l_tax * 100 + 0.5) AS INT) WHEN 0 THEN 9 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 5 "
                "WHEN 4 THEN 6 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 7 END",
    "outcome": "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 9 WHEN l_linestatus = 'F' THEN 2 "
               "ELSE 3 END",
    "admincat": "CASE WHEN l_suppkey % 10 = 0 THEN 99 ELSE CAST(1 + l_suppkey % 3 AS INT) END",
    "atentype": "CASE WHEN l_partkey % 15 = 0 THEN 13 ELSE CAST(1 + l_partkey % 2 AS INT) END",
    "priority": "CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 9 ELSE 1 END",
    "refsourc": "CASE WHEN l_partkey % 20 = 0 THEN 99 ELSE CAST(1 + l_partkey % 6 AS INT) END",
    "servtype": "CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE CAST(1 + l_partkey % 3 AS INT) END",
    "stafftyp": "CASE l_suppkey % 7 WHEN 0 THEN 9 WHEN 1 THEN 99 ELSE CAST(l_suppkey % 7 AS INT) END",
    "apptage": "CASE WHEN l_quantity <= 2 THEN 7001 ELSE CAST(20 + l_quantity AS INT) END",
    "reqdate": "CAST(o_orderdate AS DATE)",
    "mainspef": "CASE l_suppkey % 4 WHEN 0 THEN '300' WHEN 1 THEN '307' WHEN 2 THEN '302' END",
    "dnadate": "CASE WHEN l_tax >= 0.065 THEN CAST(o_orderdate AS DATE) END",
    "wait_ind": "CAST(1 + l_partkey % 3 AS INT)",
    "waiting": "CASE WHEN l_partkey % 3 < 2 THEN CAST(l_partkey % 90 AS INT) END",
    "hes_yr": "CAST(extract(year FROM l_shipdate) AS INT)",
}
PATIENT_RULES = {"patid": "c_custkey", "ons_dod": "CASE WHEN c_acctbal < 0 THEN DATE '2000-06-30' END"}
TYPE_RULES = {
    "patid": "c_custkey",
    "diabetes_type": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'type1' WHEN 'BUILDING' THEN 'type2' "
                     "WHEN 'FURNITURE' THEN 'type2' ELSE 'unspecified' END",
}
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}
SPECIALTY_NAMES = {"307": "Diabetic Medicine", "300": "General Medicine"}


def _project(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.select([F.expr(text).alias(name) for name, text in rules.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return _project(lines.join(orders, lines.l_orderkey == orders.o_orderkey), APPOINTMENT_RULES)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer").where("c_nationkey <> 0"), PATIENT_RULES)


def patient_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'"), TYPE_RULES)


def specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{code}', '{name}')" for code, name in SPECIALTY_NAMES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tretspef, tretspef_name)")


def patient_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region name per patient; stands in for the ethnic-group column."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("c_custkey").alias("patid"), F.col("r_name").alias("ethnos"))
    )
