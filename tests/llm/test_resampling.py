"""Importance resampling against a brute-force version and its SQL."""

import hashlib
import math
import re
import zlib

import pytest

from tests.llm.conftest import SF
from visitflow.llm import importance_resampling
from visitflow.llm.queries import ORACLES, QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def runs(text, longest):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, percent, least):
    docs = [(i, *runs(t, longest)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for side, found in ((s, [r for _, _, r in docs]), (t, [runs(x, longest)[1] for x in target])):
        for run in (x for r in found for x in r):
            side[zlib.crc32(run) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets))))
            for a, b in zip(s, t, strict=True)]
    rows = []
    for i, n_words, found in docs:
        weight = sum(gain[zlib.crc32(x) % buckets] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(able[:percent * len(able) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("frame", ["documents", "awkward", "empty"])
@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 55, 1)])
def test_equals_brute_force(spark, request, frame, longest, percent, least):
    docs = request.getfixturevalue(frame)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = importance_resampling.resample(
        docs.repartition(5), target, longest=longest, buckets=500, percent=percent, least_words=least)
    wanted = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
                   [r.text for r in target.collect()], longest, 500, percent, least)
    assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_ties_share_nothing_and_empty_target(spark, empty):
    docs = spark.createDataFrame([(i % 3, "one two three") for i in range(30)] + [(None, None)], "doc_id long, text string")
    rows = importance_resampling.resample(docs, empty, percent=50, least_words=3).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 16)) and len(rows) == 31
    assert sorted(map(tuple, rows), key=str) == brute(
        [(r.doc_id, r.text) for r in docs.collect()], [], 1, 10_000, 50, 3)


def test_all_or_nothing_is_drawn(documents):
    for percent in (0, 100):
        rows = importance_resampling.resample(documents, documents, percent=percent).collect()
        assert sum(r.rank is not None for r in rows) == sum(r.n_features >= 20 for r in rows) * percent // 100
        assert {r.weight for r in rows} == {0}


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    query = "op13_importance_resampling"
    assert sorted(map(str, map(tuple, QUERIES[query](spark, SF).collect()))) == \
        sorted(map(str, con.sql(ORACLES[query]).fetchall()))
