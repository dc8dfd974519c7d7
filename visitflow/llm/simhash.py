"""SimHash near-duplicates with pivot distance tables.

A fingerprint sums the XXH64 bits of a text's word shingles. Distinct fingerprints are linked at ``MAX_BITS`` or fewer
differing bits, without loss:

1. Candidates. The 64 bits are cut into four blocks. Two fingerprints that differ in two bits agree on two blocks, that
   is, on the distances of these blocks to all unit vectors; the join key of a table is such a pair of blocks (six).
2. Pivot tables. Distances to ``PIVOTS`` reference fingerprints are stored with each candidate. By the triangle
   inequality no coordinate of a linked pair differs by more than two bits, so pairs with a larger maximum are discarded.
3. Survivors are verified by their Hamming distance.

A key that more than ``DENSE`` distinct fingerprints share is not joined with itself. Its fingerprints emit the 65 points
at distance one or none; those that meet in a point are within two bits of each other, and two fingerprints within two
bits always meet in one. At most 65 can meet in a point, so no group grows with the data.

Results in special cases: a NULL, empty or blank text has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; repeated rows get a row each; a NULL doc_id counts as no candidate for the component's
smallest id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import release_memory, stored, text_slices
from visitflow.llm.components import connected_components

MAX_BITS, DENSE, BLOCKS = 2, 64, 4
_random = random.Random(64)
PIVOTS = [_random.getrandbits(64) - (1 << 63) for _ in range(16)]
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The bits of a byte, lowest first, each in a byte of a 64-bit word.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit ``hashes``."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(octets), 255):  # a lane of eight bits holds up to 255
        counts += LANES[octets[i:i + 255]].sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(octets), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words; of all words if they are fewer; nothing without a word."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1:].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in pairs), np.uint64, n)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed 64-bit number, text_hash XXH64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in text_slices(batches):
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(shingle_hashes(t.as_py() or b"", shingle)) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash").mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def _keys() -> list:
    width = 64 // BLOCKS
    masks = [((1 << width) - 1) << (width * k) for k in range(BLOCKS)]
    pairs = [a | b for a, b in combinations(masks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    return [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]


def linked_fingerprints(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints of ``distinct`` (fp, without repeats) within MAX_BITS bits."""
    rows = distinct.select("fp", F.explode(F.array(*_keys())).alias("k")).select("fp", "k.*")
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pivots = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in PIVOTS])
    rows = stored(rows.join(shared, ["t", "key"]).withColumn("pivots", pivots), "pivots")
    few = rows.filter(F.col("n") <= dense)
    a, b = few.alias("a"), few.alias("b")
    differences = [F.abs(F.col("a.pivots")[i] - F.col("b.pivots")[i]) for i in range(len(PIVOTS))]
    close = reduce(lambda x, y: x & y, [d <= MAX_BITS for d in differences])
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    pairs = (
        a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp"))
               & close & near)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    points = F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))"))
    many = rows.filter(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    met = many.groupBy("point").agg(F.collect_list("fp").alias("met")).filter(F.size("met") > 1)
    stars = met.select(F.array_min("met").alias("b"), F.explode("met").alias("a")).filter("a != b").select("a", "b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, text_hash) of every row; ``docs`` has doc_id and text.

    ``root`` is the least fingerprint of the group, as a number: it names the group also where ids are NULL or shared.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(linked_fingerprints(first.select("fp"), dense))
    rooted = first.join(roots, first.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "text_hash")


def first_of_groups(groups: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of one row of each group of ``near_duplicates``: the smallest id, NULL last, then the least hash."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return groups.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.text_hash")
