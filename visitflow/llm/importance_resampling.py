"""Importance resampling of documents towards a target distribution, on hashed word runs.

Texts become buckets by Arrow kernels: ascii_lower, split_pattern_regex and list_flatten give words, dictionary_encode
gives each an index; indices moved by one, two, ... places against themselves give the runs of words, whose distinct
pairs are numbered and get their CRC from the CRC of the shorter run. Each task counts its buckets in one array; Spark
adds them up to a table of ``buckets`` rows at most, for documents and target each. A bucket's gain is the floored,
scaled logarithm of its smoothed share in the target over its share in the documents; gains are taken by the same
indices and summed by segment.

Drawing: a document's weight plus Gumbel noise from the SHA-256 of its id is its score, and the highest scores are drawn.
Scores are integers, so a table of their counts in steps of ``STEP`` has a few thousand rows whatever the input. It shows
which step holds the last draw; documents from that step up are range-partitioned by score, numbered within their
partition, and moved up by the counts of the partitions before. No task holds more than its range.

Results in special cases: a NULL or empty text has no features and weight 0; a NULL id counts as empty text in the hash
and comes last among ties; repeated rows are drawn each by itself; further columns are ignored; an empty target gives
gains against the smoothing alone; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import list_offsets, stored, text_slices

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STEP = 64


def words_and_offsets(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after the other, and where each text's words begin."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    parts = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(parts), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return pc.dictionary_encode(parts.filter(real)), before[list_offsets(lists)]


def run_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every run of 1 to ``longest`` words, the number of its text, and each text's number of words."""
    words, offsets = words_and_offsets(texts)
    sizes = np.diff(offsets)
    spelled = [w.encode() for w in words.dictionary.to_pylist()]
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    crc = np.array([zlib.crc32(w) for w in spelled], np.int64)
    run, found, owner = index, [crc[index] % buckets], [text]
    for _ in range(longest - 1):
        # A run one word longer: the run that begins here and the word behind its end, within one text.
        run, tail = run[:-1], index[len(index) - len(run) + 1:]
        same = text[:len(run)] == text[len(index) - len(run):]
        pairs, number = np.unique(run[same] * len(spelled) + tail[same], return_inverse=True)
        crc = np.array([
            zlib.crc32(b" " + spelled[p % len(spelled)], int(crc[p // len(spelled)])) for p in pairs.tolist()], np.int64)
        run = np.full(len(same), -1, np.int64)
        run[same] = number
        found.append(crc[number] % buckets)
        owner.append(text[:len(same)][same])
        if not len(number):
            break
    return np.concatenate(found), np.concatenate(owner), sizes


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) of the buckets that occur in ``texts`` (text): one array per task, added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            total += np.bincount(run_buckets(batch.column("text"), longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Gain of every bucket. What reaches the driver is two tables of at most ``buckets`` rows."""
    counts = np.zeros((2, buckets), np.int64)
    for row, texts in zip(counts, (docs, target), strict=True):
        for bucket, n in bucket_counts(texts, longest, buckets).collect():
            row[bucket] = n
    (s, t), (all_s, all_t) = counts.astype(float), counts.sum(axis=1).tolist()
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs`` (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bucket, owner, sizes = run_buckets(batch.column("text"), longest, len(gain))
            order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
            n = np.bincount(owner, minlength=len(sizes))
            total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": sizes, "n_features": n,
                "weight": (total[ends] - total[ends - n]) // np.maximum(n, 1),
            })

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """``scored`` (doc_id, score and others) with ``rank``: 1, 2, 3, ... by falling score and rising id among the
    floor(percent * N / 100) highest of the N rows that are ``eligible``; else NULL. ``scored`` is read several times."""
    step = F.floor(F.col("score") / STEP)
    histogram = scored.filter(eligible).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    quota = sum(r.n for r in histogram) * percent // 100
    # Without a draw the step lies above all scores.
    above, last = 0, max((r.step for r in histogram), default=0) + 1
    for row in sorted(histogram, key=lambda r: -r.step):
        if above >= quota:
            break
        above, last = above + row.n, row.step
    high = F.expr(eligible) & (step >= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *[c for c in scored.columns if c not in ("score", "doc_id")]]
    place = F.monotonically_increasing_id()
    top = stored(
        scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)), "top-scores")
    sizes, before = top.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), []
    for row in sorted(sizes):
        before.append((row.part, sum(r.n for r in sizes if r.part < row.part)))
    starts = scored.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place") + 1
    drawn = top.join(F.broadcast(starts), "part").select(*scored.columns, F.when(rank <= quota, rank).alias("rank"))
    return drawn.union(scored.filter(~high).select("*", F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weights(docs, gains(docs, target, longest, buckets), longest).withColumn("score", F.col("weight") + noise)
    found = ranked(stored(weighed, "scored"), f"n_words >= {least_words}", percent)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
