"""Declared schemas, readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from visitflow.params import NA_TEXT


APPOINTMENTS = """
    patid bigint, attendkey bigint, apptdate date, tretspef string, mainspef string, firstatt string, attended int,
    outcome int, admincat int, atentype int, priority int, refsourc int, servtype int, stafftyp int, apptage int,
    dnadate date, reqdate date, wait_ind int, waiting int, hes_yr int, ethnos string
"""
PATIENTS = "patid bigint, ons_dod date"
PATIENT_TYPES = "patid bigint, diabetes_type string"
SPECIALTIES = "tretspef string, tretspef_name string"
#: Some 200 MB of cleaned appointments.
ROWS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 1 << 16


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; with a declared schema Spark reads no footer to infer one and prunes to these columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_code_lookup(spark: SparkSession, path: str, schema: T.StructType | str = SPECIALTIES) -> DataFrame:
    """Code lookup CSV with a header; the code stays text, so leading zeros survive.

    A line with too many or too few fields is an error that names it, not a code without a name.
    """
    return spark.read.csv(path, schema=schema, header=True, nullValue=NA_TEXT, mode="FAILFAST", enforceSchema=False)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Stage a dataset as Parquet, replacing it, and return the staged copy for the next step to read."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return read_table(df.sparkSession, path, None if partition_by else df.schema)


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a table of ``rows``: a power of two, so that tables of unlike size still nest."""
    return min(1 << max(0, (max(rows, 1) - 1) // rows_per_bucket).bit_length(), MOST_BUCKETS)


def write_bucketed(
    df: DataFrame, table: str, path: str, columns: Sequence[str], buckets: int | None = None, rows_per_file: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Stage a dataset as a table bucketed by ``columns``, replacing it, and return the staged copy.

    Later windows and joins on these columns read it without a shuffle. Without ``buckets`` there are as many as shuffle
    partitions. Each is written by one task; a bucket of more than ``rows_per_file`` rows has several files.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(buckets, *columns)
    writer = placed.write.mode("overwrite").format("parquet").bucketBy(buckets, *columns)
    writer.option("path", path).option("maxRecordsPerFile", rows_per_file).saveAsTable(table)
    return spark.table(table)


def write_result_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a result table as CSV with a header and ``NA`` for NULL, and return its input.

    ``partition_by`` gives one folder per group, e.g. one per transition matrix.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).csv(path, header=True, nullValue=NA_TEXT, emptyValue="")
    return df
