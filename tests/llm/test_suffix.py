"""Suffix arrays and removal of repeated strings against brute force."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from visitflow.llm import suffix_dedup
from visitflow.llm.suffix_array import common_with_neighbour, suffix_array, words_at


def test_suffix_array_against_sorting():
    random = np.random.default_rng(1)
    for size, letters in ((1, 2), (2, 1), (300, 2), (300, 1), (500, 4), (400, 256)):
        text = random.integers(0, letters, size).astype(np.uint8)
        order = suffix_array(text, size + 8)
        wanted = sorted(range(size), key=lambda i: text[i:].tobytes())
        assert order.tolist() == wanted
        near = common_with_neighbour(order, words_at(text), 11)
        grams = Counter(text[i:i + 11].tobytes() for i in range(size - 10))
        assert [bool(x) for x in near] == [i + 11 <= size and grams[text[i:i + 11].tobytes()] > 1 for i in wanted]


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:-1]
        rest = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def check(docs, length, **options):
    rows = docs.select("doc_id", "text").collect()
    wanted = sorted((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text for r in rows], length), strict=True))
    found = suffix_dedup.remove_repeats(docs, length, **options)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == wanted
    return wanted


@pytest.mark.parametrize("length,crowd", [(400, 4096), (60, 4096), (60, 1)])
def test_documents(documents, length, crowd):
    wanted = check(documents, length, crowd=crowd)
    assert sum(w[2] for w in wanted) > 0


def test_random_passages(spark):
    random = np.random.default_rng(6)
    passages = ["".join(chr(c) for c in random.integers(97, 101, 90)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(4):
            p = passages[random.integers(0, 6)]
            a, b = sorted(random.integers(0, 91, 2))
            parts += [p[a:b], "".join(chr(c) for c in random.integers(97, 99, int(random.integers(0, 20))))]
        rows.append((i, "".join(parts) + "é" * int(random.integers(0, 60))))
    rows += [(200, "z" * 500), (201, "zé" * 200)]
    for crowd in (4096, 2):
        check(spark.createDataFrame(rows, "doc_id long, text string"), 50, crowd=crowd)


def test_awkward(awkward, empty):
    check(awkward.filter("doc_id is null or doc_id not in (5, 7)"), 400)
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(awkward, keep=("lang", "n"), with_text=True).collect()}
    assert found[5].n_removed == found[5].n_bytes and found[7].kept_text == "" and found[1].kept_text is None and found[8].n == 12 - 5
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_memory_of_a_slice_and_of_crowded_cores():
    layout = suffix_dedup.Layout(400)
    text = np.random.default_rng(2).integers(97, 123, suffix_dedup.SLICE).astype(np.uint8)
    suffix_dedup.POWERS.clear()
    tracemalloc.start()
    suffix_dedup.regions(text, np.arange(0, len(text) + 1, 2048), layout)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    # Each of 3000 regions of one core has 100 windows; few of them are held at once.
    n = 3000
    side = [bytes([97 + i % 26]) * 99 for i in range(n)]
    crowd = pa.RecordBatch.from_pydict({
        "core": np.zeros(n, np.int64), "region": np.arange(n), "windows": pa.array([100] * n, pa.int32()),
        "before": pa.array(side, pa.binary()), "after": pa.array(side, pa.binary())})
    found = list(suffix_dedup.window_rows(iter([crowd]), layout))
    assert sum(b.num_rows for b in found) == 100 * n and max(b.num_rows for b in found) < 100_000
    pairs = {x for b in found for x in zip(b["region"].to_pylist(), b["k"].to_pylist(), strict=True)}
    assert len(pairs) == 100 * n
