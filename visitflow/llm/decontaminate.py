"""Benchmark decontamination by greedy string tiling.

Words are lower case, letters only. Runs of ``SEED`` words are hashed by Karp-Rabin; the hashes of the benchmark, a stated
query set taken in blocks of at most ``BLOCK_ITEMS`` items, go to every task, and the documents are read in place. Where a
document shares a seed with an item, matches are grown along equal offsets and verified word by word, and the longest one
whose words are all free is marked, again and again, until none of ``SEED`` words is left. Tiles may lie in any order, so
reordered passages count. A document is contaminated if tiles cover ``threshold`` of an item's words.

Results in special cases: a NULL or empty document, or one without letters, is clean; an item without words matches
nothing, one shorter than a seed must match whole; ties between items go to the smallest id; repeated rows are judged
each; an empty benchmark leaves all clean; further columns are ignored unless ``keep`` names them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import release_memory, strings, text_slices, words_of

SEED, THRESHOLD, BLOCK_ITEMS, SLICE = 5, 0.5, 20_000, 4 << 20
TILE = pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])
RESULT = [("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(TILE))]
RESULT_SCHEMA = "item_id long, coverage double, tiles array<struct<doc_word int, item_word int, words int>>"
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with letters, and where each text's words begin."""
    from xxhash import xxh64_intdigest

    words, word, offsets = words_of(texts)
    spelled = strings(words)
    each = np.array([xxh64_intdigest(w) for w in spelled], np.uint64)
    full = np.array([bool(w) for w in spelled], bool)[word] if len(word) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return each[word][full] if len(word) else np.zeros(0, np.uint64), before[offsets]


def running_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash of every run of ``size`` words inside a text, and the run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * BASE + hashes[k:k + n]
        total = (total ^ (total >> np.uint64(31))) * BASE
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(owner[:n] == owner[size - 1:])
    return total[inside], inside


class Benchmark:
    """The seeds of a block of items."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids = ids
        self.words, self.offsets = word_hashes(texts)
        sizes = np.diff(self.offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.tables = []
        for size in sorted({min(int(s), SEED) for s in sizes if s}):
            codes, at = running_hashes(self.words, self.offsets, size)
            mine = (sizes[owner[at]] == size) | ((size == SEED) & (sizes[owner[at]] > size))
            codes, at = codes[mine], at[mine]
            order = np.argsort(codes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(codes >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((size, codes[order], at[order], owner[at[order]], seen))

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(document, item) -> seeds as (document's word, item's word, words)."""
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for size, codes, at, owner, seen in self.tables:
            own, places = running_hashes(hashes, offsets, size)
            maybe = seen[(own >> np.uint64(44)).astype(np.int64)]
            own, places = own[maybe], places[maybe]
            left, right = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
            docs = np.searchsorted(offsets, places, "right") - 1
            for k in np.flatnonzero(right > left):
                for j in range(left[k], right[k]):
                    found.setdefault((int(docs[k]), int(owner[j])), []).append((int(places[k]), int(at[j]), size))
        return found


def tile(seeds: list[tuple[int, int, int]], doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest free match first. Seeds are (document's word, item's word, words)."""
    least, heap, open_runs = seeds[0][2], [], {}
    for d, i, size in sorted(seeds):
        run = open_runs.get(d - i)
        if run and d <= run[0] + run[2]:
            run[2] = max(run[2], d + size - run[0])
        else:
            open_runs[d - i] = run = [d, i, size]
            heap.append(run)
    heap = [(-n, d, i) for d, i, n in heap if (doc[d:d + n] == item[i:i + n]).all()]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item = np.zeros(len(item), bool)
    tiles = []
    while heap:
        minus, d, i = heapq.heappop(heap)
        free = [not used_item[i + k] and d + k not in used_doc for k in range(-minus)]
        if all(free):
            tiles.append((d, i, -minus))
            used_item[i:i - minus] = True
            used_doc.update(range(d, d - minus))
            continue
        start = 0
        for k in range(-minus + 1):
            if k == -minus or not free[k]:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, d + start, i + start))
                start = k + 1
    return sorted(tiles)


def _best(texts: pa.Array, benchmark: Benchmark, so_far: list[tuple]) -> list[tuple]:
    hashes, offsets = word_hashes(texts)
    for (doc, item), seeds in benchmark.matches(hashes, offsets).items():
        a, b = offsets[doc], offsets[doc + 1]
        c, e = benchmark.offsets[item], benchmark.offsets[item + 1]
        tiles = tile([(d - a, i - c, n) for d, i, n in seeds], hashes[a:b], benchmark.words[c:e])
        covered = sum(t[2] for t in tiles) / (e - c)
        best, item_id = so_far[doc], benchmark.ids[item]
        if covered and (best[1], -float("inf") if best[0] is None else -best[0]) < (covered, -item_id):
            so_far[doc] = (item_id, float(covered), tiles)
    return so_far


def tile_documents(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, keep: Sequence[str] = (),
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, tiles) of every row, with the columns ``keep``.

    item_id, coverage and tiles are those of the item with the largest coverage. Each block of the benchmark is one more
    map over the documents, without a shuffle.
    """
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // block_items)
    own = ("doc_id", "text", "item_id", "coverage", "tiles", "contaminated")
    carried = [c for c in dict.fromkeys(keep) if c not in own]
    frame = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", *carried, F.lit(None).cast("long").alias("item_id"),
        F.lit(0.0).alias("coverage"),
        F.array().cast("array<struct<doc_word:int,item_word:int,words:int>>").alias("tiles"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select("doc_id", "text", *carried).schema)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        frame = frame.mapInArrow(
            _tiler(part["item_id"].to_pylist(), part["text"].combine_chunks()), f"{kept}, {RESULT_SCHEMA}")
    flagged = (F.col("coverage") >= threshold).alias("contaminated")
    return frame.select("doc_id", flagged, "item_id", "coverage", "tiles", *["text"] * ("text" in keep), *carried)


def _tiler(ids: list, texts: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(ids, texts)
        for batch in text_slices(batches, limit=SLICE):
            so_far = list(zip(batch.column("item_id").to_pylist(), batch.column("coverage").to_pylist(),
                              [[tuple(t.values()) for t in x] for x in batch.column("tiles").to_pylist()], strict=True))
            found = _best(batch.column("text"), benchmark, so_far)
            columns = {name: batch.column(name) for name in batch.schema.names}
            for k, (name, kind) in enumerate(RESULT):
                values = [x[k] for x in found]
                if name == "tiles":
                    values = [[dict(zip(("doc_word", "item_word", "words"), map(int, t), strict=True)) for t in x]
                              for x in values]
                columns[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_pydict(columns)
        benchmark = columns = None
        release_memory()

    return run
