"""Removal of byte strings of ``length`` bytes that start twice or more in the corpus, with suffix arrays.

A window is a string of ``length`` bytes. Sorting every suffix of the corpus would move it many times over, so the sort is
given only what can still hold a repeat:

1. Anchors. Each window's anchor is its least ``GRAM``-gram by hash, so equal windows have equal anchors at equal offsets.
   Windows next to each other with one anchor and offsets in one of ``PARTS`` ranges form a region. All of its windows
   contain one core, known from the anchor; before and after it they differ by their fringes.
2. Counts. Regions are counted by core, partially before the shuffle. A core that occurs once holds no repeat. If all
   regions of a core are equal, all their windows repeat. What is left are the edges of repeated passages.
3. Suffix arrays. Distinct regions of a core, as left fringe, core's number, right fringe, form texts that are sorted by
   two-stage sorting, cores dealt over tasks in chunks of bounded size; a window repeats if its suffix has a common prefix
   of a window's length with a neighbour in the array. A core with more than ``CROWD`` distinct regions is not gathered:
   its windows are counted by their 128-bit hash instead, an exact way for the rest.
4. The union of repeated windows is cut out of the texts, which are shuffled by row once, and once more only if they have
   edges.

Copies of one document share all their cores, whose counts are summed before the shuffle; joins on hot cores are left to
adaptive execution, which splits them. Cores and regions are compared by hashes of 64 bits each, not byte by byte: by chance
they agree once in 2**128 pairs.

Results in special cases: a NULL text is empty; a text below ``length`` bytes loses nothing; a repeated row repeats all its
strings; rows with one doc_id are a row each; further columns are ignored unless ``keep`` names them; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import release_memory, stored, text_slices
from visitflow.llm.suffix_array import common_with_neighbour, suffix_array, words_at

LENGTH, GRAM, PARTS, CROWD, CHUNK, SLICE, CUT_SLICE, COUNTED = 400, 32, 3, 4096, 2 << 20, 1 << 19, 2 << 20, 512
_random = random.Random(400)
TABLE = [_random.getrandbits(64) | 1 for _ in range(512)]
REGION = "core long, region long, row long, start int, windows int, left int"
POWERS: dict[int, np.ndarray] = {}
CORE_MARK, END_MARK = 0xFF, 0xFE  # neither occurs in UTF-8


class Layout:
    """Sizes that follow from the length of a window."""

    def __init__(self, length: int):
        if length < GRAM + 4 * PARTS:
            raise ValueError(f"windows must have at least {GRAM + 4 * PARTS} bytes")
        self.length = length
        self.offsets = length - GRAM + 1
        self.part = -(-self.offsets // PARTS)
        self.core = length - self.part + 1


def _mix(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Hashes:
    """Hashes of any stretch of a text in constant time: sums of byte codes times powers of an odd number."""

    def __init__(self, text: np.ndarray, second: bool = False):
        table = np.array(TABLE[256:] if second else TABLE[:256], np.uint64)
        factor = 0xD1342543DE82EF95 if second else 0x2545F4914F6CDD1D
        n = len(text)
        self.inverse = _powers(pow(factor, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[text] * _powers(factor, n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _powers(factor: int, n: int) -> np.ndarray:
    known = POWERS.get(factor)
    if known is None or len(known) < n:
        known = POWERS[factor] = _new_powers(factor, max(n, SLICE + 1))
    return known[:n]


def _new_powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(factor, done, 1 << 64))
        done += step
    return out


def _grams(text: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from every position; the last ones are of no use."""
    code = np.array(TABLE[:256], np.uint64)[text]
    width = 1
    while width < GRAM:
        after = np.zeros_like(code)
        after[:-width or None] = code[width:]
        code = code * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + after
        width *= 2
    return _mix(code)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of the ``span`` values from every position that has so many."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, span), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - span + 1], ahead[span - 1:n])


def regions(text: np.ndarray, begins: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
    """Regions of texts that lie one after the other: (core, region, text, start in it, windows, bytes before the core)."""
    n, length = len(text), layout.length
    empty = {k: np.zeros(0, np.int64) for k in ("core", "region", "text", "start", "windows", "left")}
    if n < length:
        return empty
    # The position in the low bits makes the least gram unique: the first of equal ones.
    bits = np.uint64(max(1, int(n).bit_length()))
    codes = (_grams(text) >> bits << bits) | np.arange(n, dtype=np.uint64)
    anchor = (_least(codes[:n - GRAM + 1], layout.offsets) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(owner[:n - length + 1] == owner[length - 1:])
    if not len(at):
        return empty
    anchor = anchor[at]
    part = (anchor - at) // layout.part
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last] + length
    core = anchor[first] - part[first] * layout.part
    one, two = Hashes(text), Hashes(text, second=True)
    return {
        "core": one.of(core, core + layout.core).view(np.int64), "region": two.of(start, end).view(np.int64),
        "text": owner[start], "start": start - begins[owner[start]], "windows": last - first + 1, "left": core - start,
    }


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins."""
    values = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


def _region_rows(rows: DataFrame, layout: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            text, begins = _flat(batch.column("text"))
            found = regions(text, begins, layout)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["core"]), pa.array(found["region"]),
                 batch.column("row").take(pa.array(found["text"], pa.int64())),
                 *[pa.array(found[c].astype(np.int32)) for c in ("start", "windows", "left")]],
                ["core", "region", "row", "start", "windows", "left"])
        POWERS.clear()
        release_memory()

    return rows.select("row", "text").mapInArrow(run, REGION)


def _fringes(pending: DataFrame, layout: Layout) -> DataFrame:
    """The edge regions of rows (row, text, edges) with the bytes before and after their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=CUT_SLICE):
            out: dict[str, list] = {c: [] for c in ("core", "region", "row", "start", "windows", "before", "after")}
            for row, text, edges in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "edges")), strict=True):
                data = text.encode()
                for e in edges:
                    core = e["start"] + e["left"]
                    out["before"].append(data[e["start"]:core])
                    out["after"].append(data[core + layout.core:e["start"] + e["windows"] - 1 + layout.length])
                    out["row"].append(row)
                    for c in ("core", "region", "start", "windows"):
                        out[c].append(e[c])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.binary()] * 2),
                                                strict=True)], list(out))
        out = None
        release_memory()

    return pending.mapInArrow(
        run, "core long, region long, row long, start int, windows int, before binary, after binary")


def repeated_windows(group: list[tuple[int, int, bytes, bytes, int]], layout: Layout) -> list[list[int]]:
    """For each region (core, windows, before, after, copies) its windows that another one of the list equals."""
    parts, starts, at, numbers = [], [], 0, {}
    for core, _, before, after, _ in group:
        number = numbers.setdefault(core, len(numbers))
        middle = bytes((CORE_MARK, number // 62500, number // 250 % 250, number % 250))
        parts.append(before + middle + after + bytes((END_MARK,)))
        starts.append(at)
        at += len(parts[-1])
    text = np.frombuffer(b"".join(parts), np.uint8)
    depth, words = layout.part - 1 + 4, words_at(text)
    order = suffix_array(text, depth, words)
    repeated = np.zeros(len(text), bool)
    repeated[order[common_with_neighbour(order, words, depth)]] = True
    return [np.flatnonzero(repeated[s:s + g[1]]).tolist() for s, g in zip(starts, group, strict=True)]


def _sorted_regions(distinct: DataFrame, layout: Layout) -> DataFrame:
    """(core, region, repeated) of distinct regions; each core's regions come together, cores in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([(r[0], r[2], r[3], r[4], r[5]) for r in held], layout)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()),
                 pa.array(found, pa.list_(pa.int32()))], ["core", "region", "repeated"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("core", "region", "windows", "before", "after", "copies")]
            for row in zip(*columns, strict=True):
                if held and size >= CHUNK and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + len(row[4]) + 5
        if held:
            yield flush()
        held = columns = None
        release_memory()

    return distinct.repartition("core").sortWithinPartitions("core").select(
        "core", "region", "windows", "before", "after", "copies").mapInArrow(
        run, "core long, region long, repeated array<int>")


def window_rows(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """(core, region, k, one, two) of every window k of the regions, with the two halves of its 128-bit hash."""
    import xxhash

    # A region has up to a third of a window's length of windows, so few regions are taken at once.
    for batch in (b.slice(k, COUNTED) for b in batches for k in range(0, b.num_rows, COUNTED)):
        out: list[list] = [[], [], [], [], []]
        columns = [batch.column(c).to_pylist() for c in ("core", "region", "windows", "before", "after")]
        for core, region, windows, before, after in zip(*columns, strict=True):
            for k in range(windows):
                rest = before[k:] + b"\xff" + after[:layout.part - 1 - (len(before) - k)]
                code = xxhash.xxh3_128_digest(rest)
                for column, value in zip(out, (core, region, k, int.from_bytes(code[:8], "big", signed=True),
                                               int.from_bytes(code[8:], "big", signed=True)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["core", "region", "k", "one", "two"])
    out = None
    release_memory()


def _counted_windows(crowded: DataFrame, layout: Layout) -> DataFrame:
    """The same for cores with many regions: windows are counted by hash, partially before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from window_rows(batches, layout)

    rows = crowded.select("core", "region", "windows", "before", "after").mapInArrow(
        run, "core long, region long, k int, one long, two long")
    counts = rows.groupBy("core", "one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(counts, ["core", "one", "two"]).groupBy("core", "region").agg(F.collect_list("k").alias("repeated"))


def _spans(starts: Sequence[int], windows: Sequence[int], length: int) -> list[tuple[int, int]]:
    """Union of the byte ranges of windows, as falling apart into maximal runs."""
    out: list[list[int]] = []
    for start, count in sorted(zip(starts, windows, strict=True)):
        end = start + count - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(length: int, found: str, kept: Sequence[str], with_text: bool):
    """Cuts the spans of column ``found`` (start, windows) out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=CUT_SLICE):
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")}
            for text, repeats in zip(batch.column("text"), batch.column(found).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                spans = _spans([r["start"] for r in repeats or ()], [r["windows"] for r in repeats or ()], length)
                parts, at = [], 0
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                if with_text:
                    out["kept_text"].append(rest.decode(errors="ignore") if spans or text.is_valid else None)
            if not with_text:
                del out["kept_text"]
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text) + [
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in kept],
                 *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["doc_id", *kept, *out])
        out = None
        release_memory()

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep: Sequence[str] = (), with_text: bool = False, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text).

    ``with_text`` adds ``kept_text``, the remaining bytes without characters that a cut has split. ``keep`` names columns to
    carry along.
    """
    layout = Layout(length)
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "text", *results)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)])
    carried = [f"kept_{i}" for i in range(len(kept))]
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = _region_rows(rows, layout)
    shared = (
        found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("region") != F.max("region")).alias("edge"))
        .filter("n > 1").select("core", "edge")
    )
    shared = stored(shared, "cores")
    by_row = (
        found.join(shared, "core").groupBy("row").agg(
            F.collect_list(F.when(~F.col("edge"), F.struct("start", "windows"))).alias("whole"),
            F.collect_list(F.when(F.col("edge"), F.struct("core", "region", "start", "windows", "left"))).alias("edges"))
        .withColumnRenamed("row", "own")
    )
    marked = rows.join(by_row, F.col("row") == F.col("own"), "left").drop("own")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([
        "doc_id long", *[f"{c} {fields[c]}" for c in carried], "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        *["kept_text string"] * with_text, "spans array<struct<start int, end int>>"])
    # Rows without edges are finished in this pass; the others keep their text until their edges are sorted.
    marked = stored(marked, "marked")
    done = marked.filter("edges is null or size(edges) = 0").select("doc_id", "text", *carried, "whole")
    pending = marked.filter("size(edges) > 0")
    edges = stored(_fringes(pending.select("row", "text", "edges"), layout), "edges")
    distinct = edges.groupBy("core", "region").agg(
        F.count(F.lit(1)).alias("copies"), F.first("windows").alias("windows"), F.first("before").alias("before"),
        F.first("after").alias("after"))
    distinct = stored(distinct, "regions")
    crowds = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    usual = distinct.join(crowds.filter(F.col("n") <= crowd), "core")
    crowded = distinct.join(crowds.filter(F.col("n") > crowd), "core")
    repeated = _sorted_regions(usual, layout).union(_counted_windows(crowded, layout))
    copied = distinct.filter("copies > 1").select("core", "region", "windows")
    some = edges.join(
        repeated.join(copied, ["core", "region"], "left_anti"), ["core", "region"]).select(
        "row", F.explode("repeated").alias("k"), "start").select(
        "row", F.struct((F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("windows")).alias("r"))
    full = edges.select("core", "region", "row", "start").join(copied, ["core", "region"]).select(
        "row", F.struct("start", "windows").alias("r"))
    extra = some.union(full).groupBy("row").agg(F.collect_list("r").alias("more")).withColumnRenamed("row", "own")
    late = pending.join(extra, F.col("row") == F.col("own"), "left").select(
        "doc_id", "text", *carried, F.concat("whole", F.coalesce("more", F.array().cast("array<struct<start:int,windows:int>>"))).alias("whole"))
    cut = _cut(length, "whole", carried, with_text)
    out = done.mapInArrow(cut, schema).union(late.mapInArrow(cut, schema))
    return out.withColumnsRenamed(dict(zip(carried, kept, strict=True)))
