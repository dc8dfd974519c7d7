"""Shared helpers: tables in the shared folder, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
NOT_LETTERS = r"[^\p{L}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A temporary one serves local masters only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_folder()


@lru_cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``limit`` bytes of text each, or one row if that alone is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def release_memory() -> None:
    """Give free memory of this Python worker back: Spark uses a worker again for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def strings(values: pa.Array) -> list[str | None]:
    """``values.to_pylist()`` without the scalar that this makes of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array into its flattened values, from 0."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def sums_by_list(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each list; 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (lower case, letters only; maybe empty), each token's word, and where each text's tokens begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    tokens = lists.flatten().dictionary_encode()
    letters = pc.replace_substring_regex(pc.utf8_lower(tokens.dictionary), NOT_LETTERS, "").dictionary_encode()
    word = letters.indices.to_numpy()[tokens.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)
    return letters.dictionary, word, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows kept for tests: crc32 of the id as text, modulo ``folds``, is 0. A NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def about(rows: DataFrame, order: Column, n: int) -> Column:
    """Condition that a hash ``order`` meets for about 1.2 ``n`` of ``rows``, so that few rows reach the task that takes n."""
    share = min(1.0, 1.2 * n / max(rows.count(), 1))
    return F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1
