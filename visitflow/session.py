"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins and shuffles are re-planned from measured sizes; branches without rows disappear.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # NULL-on-failure is asked for explicitly (try_cast, try_divide); everything else should fail loudly.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks. On a cluster, set the shuffle partition count to the size of the data."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("visitflow")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a run without one would scatter its files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a folder for the results, or set spark.checkpoint.dir to a shared folder")
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables a query keeps; a temporary one serves local masters only."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local"):
        return _local_folder()
    return checkpoint_folder(spark).rstrip("/")


@lru_cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="visitflow-")
