"""Language identification of words and texts by a linear-chain conditional random field.

The model is fitted on a bounded sample of labelled texts (``SAMPLE_DOCS`` texts, whole).
Sequences are spliced from stretches of words of different texts, so transitions between languages are learned.
Every word of every whole text then gets its marginal by forward-backward; a text's language is the one with the largest
sum over words with letters, its score that sum's share.

Results in special cases: a NULL text or one without letters is ``und`` with score 0; ties go to the language that sorts
first; without any labelled text all are ``und``; repeated rows are judged each; further columns are ignored unless
``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import about, held_out, release_memory, sums_by_list, text_slices, words_of
from visitflow.llm.crf import Crf, train

SAMPLE_DOCS = 4000
WINDOW, WINDOWS, SEQUENCES, SLICE = 20, 3, 4000, 2 << 20
SEGMENTS = "segments array<struct<lang string, first int, words int>>"


def labelled_sample(docs: DataFrame, n: int = SAMPLE_DOCS) -> pa.Table:
    """(text, lang) of at most ``n`` ids with labels that are not held out, whole texts, in the order of a hash of the id.

    An id with several texts of one language is there with the least of them. No task gathers the sample.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    some = labelled.filter(about(labelled, order, n) & F.col("text").isNotNull())
    texts = some.groupBy(order.alias("o"), "lang").agg(F.min("text").alias("text")).toArrow()
    return texts.sort_by([("o", "ascending"), ("lang", "ascending")]).slice(0, n).select(["text", "lang"])


def fit(docs: DataFrame, seed: int = 11) -> Crf | None:
    """A model of the languages in ``docs`` (doc_id, text, lang); None without labelled words."""
    sample = labelled_sample(docs)
    words, word, offsets = words_of(sample["text"].combine_chunks())
    spelled, langs = words.to_pylist(), sample["lang"].to_pylist()
    texts = [[w for w in (spelled[i] for i in word[a:b]) if w] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    usable = [i for i, t in enumerate(texts) if t]
    if not usable:
        return None
    labels, random = sorted({langs[i] for i in usable}), np.random.default_rng(seed)
    place = {x: k for k, x in enumerate(labels)}
    sequences, targets = [], []
    for _ in range(min(SEQUENCES, 8 * len(usable))):
        one, truth = [], []
        for i in random.choice(usable, WINDOWS):
            at = int(random.integers(0, max(1, len(texts[i]) - WINDOW + 1)))
            part = texts[i][at:at + WINDOW]
            one += part
            truth += [place[langs[i]]] * len(part)
        sequences.append(one)
        targets.append(truth)
    return train(sequences, targets, labels, epochs=3)


def identify(
    docs: DataFrame, model: Crf | None, keep: Sequence[str] = (), with_segments: bool = False
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, with the columns ``keep``.

    ``with_segments`` adds the runs of words of one language: (lang, first word, number of words).
    """
    carried = [c for c in ("text", *keep) if c not in ("doc_id", "lang_pred", "score", "segments")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys(carried))
    kept = [c for c in source.columns if c != "doc_id" and c in keep]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept]
    schema = ", ".join(["doc_id long", "lang_pred string", "score double", *fields, *[SEGMENTS] * with_segments])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            found = label_texts(batch.column("text"), model, with_segments)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), found[0], found[1], *[batch.column(c) for c in kept], *found[2:]],
                ["doc_id", "lang_pred", "score", *kept, *["segments"] * with_segments])
        found = None
        release_memory()

    return source.mapInArrow(run, schema)


def label_texts(texts: pa.Array, model: Crf | None, with_segments: bool) -> list[pa.Array]:
    n = len(texts)
    if model is None:
        empty = [pa.array([[]] * n, pa.list_(SEGMENT))] if with_segments else []
        return [pa.array(["und"] * n), pa.array(np.zeros(n)), *empty]
    words, word, offsets = words_of(texts)
    first = np.zeros(len(word), bool)
    first[offsets[:-1][offsets[:-1] < len(word)]] = True
    lettered = np.array([bool(w) for w in words.to_pylist()], bool)[word] if len(word) else np.zeros(0, bool)
    marginals = model.marginals(model.emissions(words)[word], first)
    sums = sums_by_list(marginals * lettered[:, None], offsets)
    count = sums_by_list(lettered.astype(float), offsets)
    best = sums.argmax(axis=1)
    score = np.where(count > 0, sums[np.arange(n), best] / np.maximum(count, 1), 0).clip(0, 1)
    names = np.array([*map(str, model.labels), "und"], object)
    out = [pa.array(names[np.where(count > 0, best, len(model.labels))], pa.string()), pa.array(score)]
    if with_segments:
        label, rows = marginals.argmax(axis=1), []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = np.flatnonzero(lettered[a:b])
            cuts = np.flatnonzero(np.diff(label[a:b][own], prepend=-1)) if len(own) else []
            ends = [*cuts[1:], len(own)] if len(own) else []
            rows.append([{"lang": names[label[a + own[c]]], "first": int(own[c]), "words": int(e - c)}
                         for c, e in zip(cuts, ends, strict=True)])
        out.append(pa.array(rows, pa.list_(SEGMENT)))
    return out


SEGMENT = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])
