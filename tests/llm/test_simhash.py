"""SimHash against brute force, and connected components."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.llm import simhash
from visitflow.llm.components import connected_components


def brute_fingerprint(text, size):
    from xxhash import xxh64_intdigest

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    names = list(prints)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([prints[x] for x in names], np.uint64)
    for i, x in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= bits):
            a, b = find(x), find(names[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in names}


@pytest.mark.parametrize("dense", [64, 2])
def test_against_brute_force(documents, dense):
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text, 3) for r in rows}
    parts = brute_components(prints, 2)
    found = simhash.near_duplicates(documents, 3, dense).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == parts and len(found) == len(rows)


@pytest.mark.parametrize("dense", [64, 3])
def test_links_of_random_fingerprints(spark, dense):
    random = np.random.default_rng(5)
    prints = set()
    for _ in range(12):
        centre = int(random.integers(0, 1 << 63))
        for _ in range(30):
            flips = random.integers(0, 64, int(random.integers(0, 5)))
            prints.add(int(np.uint64(centre) ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(map(tuple, connected_components(simhash.linked_fingerprints(frame, dense)).collect()))
    wanted = brute_components(signed, 2)
    assert {p: roots.get(p, p) for p in signed} == {p: wanted[p] for p in signed} or \
        sorted(map(sorted, groups(roots, signed))) == sorted(map(sorted, groups(wanted, signed)))


def groups(root, nodes):
    out = {}
    for n in nodes:
        out.setdefault(root.get(n, n), []).append(n)
    return out.values()


def test_awkward(awkward, empty):
    found = simhash.near_duplicates(awkward, 3).collect()
    assert len(found) == len(awkward.collect())
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].fingerprint == "0" * 16 and by_id[i].component_id == 1 for i in (1, 2, 3))
    assert by_id[12].component_id == 6 and by_id[None].component_id is None
    assert simhash.near_duplicates(empty, 3).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.range(300, 400).select(F.col("id").alias("a"), F.lit(1000).cast("long").alias("b")))
    found = dict(map(tuple, connected_components(edges).collect()))
    assert found == {**{i: 0 for i in range(1, 201)}, **{i: 300 for i in [*range(301, 400), 1000]}}
    assert connected_components(edges.limit(0)).count() == 0
