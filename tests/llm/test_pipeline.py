"""The pipeline's stages against what their operators say, and its import guard."""

import tracemalloc

import pyarrow as pa

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_texts import ids_of
from visitflow.llm import decontaminate, language_id, packing
from visitflow.llm.common import stored, text_slices
from visitflow.llm.crf import train


def test_stages(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = stored(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    n = {name: d.count() for name, d in seen.items()}
    assert n["language ID"] > 0.95 * documents.count() and n["SimHash near-dedup"] < n["language ID"]
    assert n["suffix-array dedup"] == n["SimHash near-dedup"] and n["benchmark decontamination"] < n["suffix-array dedup"]
    kept = seen["benchmark decontamination"].select("doc_id", "text").collect()
    tokens = {r.doc_id: len(x) for r, x in zip(kept, ids_of([r.text for r in kept]), strict=True)}
    pieces = seen["packing"].collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == tokens
    assert sum(p.length for p in pieces) == sum(tokens.values())


def test_awkward_documents(spark, awkward, empty):
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "stage")
        docs.collect()


def test_unlike_documents_with_null_or_shared_ids_stay(spark):
    """Six unlike documents, three without an id and two with one id, and copies of some."""
    texts = [f"{w} document about {w} things that no other {w} document holds, written by {w}" for w in
             ("first", "second", "third", "fourth", "fifth", "sixth")]
    ids = [None, None, None, 7, 7, 8]
    rows = [*zip(ids, texts, strict=True), (None, texts[0]), (None, texts[5]), (9, texts[1]), (7, texts[3]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    wanted = [(None, texts[0]), (9, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(wanted, key=str)


def test_slices_of_the_language_and_packing_stages_need_little_memory():
    words = ["alpha", "beta", "gamma", "delta"]
    model = train([words * 5], [[0, 1, 0, 1] * 5], ["x", "y"], epochs=1)
    batch = pa.RecordBatch.from_pydict({"text": ["alpha beta gamma delta " * 100] * 4000})
    tracemalloc.start()
    for part in text_slices(iter([batch]), limit=language_id.SLICE):
        language_id.label_texts(part.column("text"), model, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 9_000_000 and peak < 120 << 20
    assert packing.SLICE <= 2 << 20 and decontaminate.SLICE <= 4 << 20
