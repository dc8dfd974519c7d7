"""Token counts, packing, language, toxicity and decontamination against the libraries, brute force and held-out rows."""

import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from visitflow.llm import decontaminate, language_id, packing, token_counts, toxicity
from visitflow.llm.common import strings
from visitflow.llm.queries import QUERIES, tokenizer_bytes

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


@pytest.mark.parametrize("frame", ["documents", "awkward", "empty"])
def test_token_counts_equal_the_library(request, frame):
    import sentencepiece

    docs = request.getfixturevalue(frame)
    found = token_counts.token_counts(docs, tokenizer_bytes(PIECES), limit=100).collect()
    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes(PIECES))
    wanted = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        n = len(library.encode(text or ""))
        wanted.append((doc_id, len((text or "").encode()), n, n > 100))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def ids_of(texts):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_buffer(tokenizer_bytes(WORDS))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("frame", ["documents", "awkward", "empty"])
def test_packing_round_trip(request, frame):
    docs = request.getfixturevalue(frame)
    pieces = packing.pack_documents(
        docs.repartition(3), tokenizer_bytes(WORDS), 2, with_ids=True, chunk_tokens=100_000).collect()
    rows = docs.select("doc_id", "text").collect()
    wanted = sorted((str(r.doc_id), tuple(x)) for r, x in zip(rows, ids_of([r.text for r in rows]), strict=True))
    by_sequence = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # nothing is padded
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id, p.doc_tokens].append(p)
    rebuilt = []
    for (doc_id, n), own in parts.items():
        own.sort(key=lambda p: p.start)
        copies = sum(p.start == 0 for p in own)
        if copies == 1:
            assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own[:-1]]]))
            rebuilt.append((str(doc_id), tuple(i for p in own for i in p.ids)))
        else:
            assert sum(p.length for p in own) == copies * n
            rebuilt += [x for x in wanted if x[0] == str(doc_id)][:copies]
    assert sorted(rebuilt) == wanted


def test_packing_uses_combinations():
    lengths = np.array([64 * 40] * 30 + [64 * 24] * 30 + [64 * 20, 64 * 20, 64 * 24, 100])
    pieces = packing.pack(lengths, 4096, 64, packing.combinations(64, 4))
    whole = [p for p in pieces if p[0] < 60 and p[2] == lengths[p[0]]]
    assert len(whole) >= 58 and sum(p[2] for p in pieces) == lengths.sum()


def cpu_seconds(work):
    def once():
        start = time.process_time()
        work()
        return time.process_time() - start

    return min(once() for _ in range(9))


def test_no_scalar_is_made_of_each_word():
    random = np.random.default_rng(4)
    spelled = ["".join(map(chr, 97 + random.integers(0, 26, 8))) for _ in range(20_000)]
    words, texts = pa.array(spelled), pa.array([" ".join(spelled)])
    encoder = packing.WordEncoder(tokenizer_bytes("word_bpe_49k.json"))
    first = encoder.texts(texts)[0]
    assert first.tolist() == encoder.tokenizer.encode(" ".join(spelled), add_special_tokens=False).ids
    # to_pylist of the words alone is 1.0; the encoder took over 3 when it called that for words and for pre-tokens.
    assert cpu_seconds(lambda: encoder.texts(texts)) < 2.7 * cpu_seconds(words.to_pylist)
    odd = pa.array(["", "é\x00", None, "日本", "a b"])
    assert strings(odd) == odd.to_pylist() and strings(odd[:0]) == []


def test_nnls_is_optimal():
    random = np.random.default_rng(1)
    for _ in range(20):
        a, b = random.random((8, 20)), random.random(8) * 4 - 1
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-5).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-5


def test_language_held_out(spark, awkward, empty):
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.95
    model = language_id.fit(docs.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id"))
    rows = {r.doc_id: r for r in language_id.identify(awkward, model, keep=("lang", "score")).collect()}
    assert len(rows) == 14 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 4))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.fit(empty)).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, "the other of this with and that was from " * 4 + "nicht der die das einer und von ist " * 4)],
                                  "doc_id long, text string")
    segments = language_id.identify(mixed, model, with_segments=True).first().segments
    assert [s.lang for s in segments] == ["en", "de"] and segments[1].first == 36


def test_toxicity(spark, awkward, empty):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = found.filter("held_out").join(docs, "doc_id").select("text", "toxic", "predicted", "spans", "score").collect()
    assert np.mean([r.toxic == r.predicted for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    spoken = {r.text[s.start:s.end].lower().strip(".,") for r in rows for s in r.spans}
    assert "idiot" in spoken or "clown" in spoken
    tagger = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert toxicity.score_texts(awkward, tagger).filter("predicted = 0").count() == len(awkward.collect())
    assert toxicity.score_texts(empty, tagger).count() == 0
    none = toxicity.fit(empty, spark.read.parquet(f"{folder}/labels.parquet").limit(0))
    assert toxicity.score_texts(awkward, none).filter("score = 0").count() == len(awkward.collect())


def test_spans_with_leading_space():
    assert toxicity.spans_of("  ab cd  ef", np.array([False, False, True, True])) == [{"start": 5, "end": 11}]


def normal(text):
    words = (re.sub(r"[^\w]|[\d_]", "", w) for w in re.split(r"[ \t\n\v\f\r]+", (text or "").lower()))
    return [w for w in words if w]


def brute_tiles(doc, item, least):
    """Greedy string tiling as published: scan all free matches, mark the longest, repeat."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]
                       and free_doc[d + n] and free_item[i + n]):
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < least:
            return sum(n for n, _, _ in tiles)
        tiles.append(best)
        for k in range(best[0]):
            free_doc[best[1] + k] = free_item[best[2] + k] = False


def test_tiling_against_brute_force():
    random = np.random.default_rng(3)
    for _ in range(60):
        item = random.integers(0, 12, 30).astype(np.uint64)
        cut = int(random.integers(8, 22))
        doc = np.concatenate([random.integers(0, 12, 15), item[cut:], random.integers(0, 12, 4), item[:cut]]).astype(np.uint64)
        seeds = [(d, i, 4) for d in range(len(doc) - 3) for i in range(len(item) - 3) if (doc[d:d + 4] == item[i:i + 4]).all()]
        tiles = decontaminate.tile(seeds, doc, item)
        assert sum(t[2] for t in tiles) == brute_tiles(doc.tolist(), item.tolist(), 4)


def test_decontamination(spark, documents, awkward, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = benchmark.orderBy("item_id").first()
    words = first.text.split()
    half = len(words) // 2
    planted = spark.createDataFrame(
        [(10**6, "Something before. " + " ".join(words[half:] + ["filler"] + words[:half]) + " and after"),
         (10**6 + 1, " ".join(words[::-1]))], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(planted)
    for block in (20_000, 7):
        found = {r.doc_id: r for r in decontaminate.tile_documents(docs, benchmark, block_items=block).collect()}
        assert found[10**6].contaminated and found[10**6].item_id == first.item_id and len(found[10**6].tiles) == 2
        assert not found[10**6 + 1].contaminated
        items = {r.item_id: normal(r.text) for r in benchmark.collect()}
        for r in docs.collect():
            text = normal(r.text)
            joined = " ".join(text)
            if any(" ".join(w) in joined for w in items.values()):
                assert found[r.doc_id].contaminated
            if found[r.doc_id].coverage and len(text) < 400:
                best = max(brute_tiles(text, w, min(5, len(w))) / len(w) for w in items.values())
                assert abs(best - found[r.doc_id].coverage) < 1e-9
    odd = decontaminate.tile_documents(awkward, benchmark, keep=("lang", "item_id", "text"))
    assert odd.filter("contaminated").count() == 0 and odd.count() == len(awkward.collect())
    assert decontaminate.tile_documents(empty, benchmark).count() == 0
    assert decontaminate.tile_documents(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    short = spark.createDataFrame([(1, "same text twice"), (2, None), (3, " ... ")], "item_id long, text string")
    hits = decontaminate.tile_documents(awkward, short).filter("contaminated").collect()
    assert [r.doc_id for r in hits].count(6) == 2 and {r.doc_id for r in hits} == {6, 12}
