"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given for texts only. Token labels follow from them: words that occur in toxic texts far more often than in
others (log-likelihood ratio) label their occurrences in toxic texts, all else is clean. The field is fitted on windows of
a bounded sample (``SAMPLE_DOCS`` labelled texts, whole), once more with the clean words it scored worst. Forward-backward gives every word of every whole text its probability of being toxic; a
text's score moves with the largest of them from the share of labels among texts without a span to that with one, and
runs of words above one half are its offending offsets.

Results in special cases: a text without words, NULL included, has the score of a text without a span; without any toxic
label all scores are 0; a label that is neither 0 nor 1, or of no text, is left out; repeated rows are judged each;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import about, held_out, text_slices, words_of
from visitflow.llm.crf import Crf, train

SAMPLE_DOCS = 6000
RADIUS, WINDOWS, HARD = 10, 6000, 2000
MIN_RATIO, MIN_SHARE = 30.0, 0.5
SCHEMA = ("doc_id long, held_out boolean, score double, predicted int, "
          "spans array<struct<start int, end int>>")
TOKEN = re.compile(r"[^ \t\n\v\f\r]+")
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


@dataclass
class Tagger:
    crf: Crf | None
    without_span: float
    with_span: float


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> pa.Table:
    """(text, toxic) of at most ``n`` labels that are not held out, whole texts. The chosen labels, ``n`` at most, are
    broadcast. An id with several texts is there with the least of them. No task gathers the sample."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        usable.filter(about(usable, order, n))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), order.alias("o"))
        .orderBy("o", "toxic").limit(n)
    )
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("o", "toxic").agg(F.min("text").alias("text")).toArrow()
    return found.sort_by([("o", "ascending"), ("toxic", "ascending")]).select(["text", "toxic"])


def toxic_words(word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """True for words tied to toxic texts: by the share of toxic texts that hold them and the log-likelihood ratio."""
    pairs = np.unique(doc * n_words + word)
    of, who = pairs // n_words, pairs % n_words
    hit = np.bincount(who, weights=toxic[of], minlength=n_words)
    seen = np.bincount(who, minlength=n_words)
    base = toxic.mean()
    share = hit / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(hit > 0, hit * np.log(share / base), 0)
                     + np.where(seen > hit, (seen - hit) * np.log((1 - share) / (1 - base)), 0))
    return (share >= MIN_SHARE) & (ratio >= MIN_RATIO) & (share > base)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Tagger:
    sample = labelled_sample(docs, labels)
    toxic = sample["toxic"].to_numpy().astype(float)
    if not len(toxic) or not toxic.any():
        return Tagger(None, 0.0, 0.0)
    base, random = float(toxic.mean()), np.random.default_rng(seed)
    words, word, offsets = words_of(sample["text"].combine_chunks())
    spelled = np.array(words.to_pylist(), object)
    doc = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    lexicon = toxic_words(word, doc, toxic, len(words)) if base < 1 else np.zeros(len(words), bool)
    lexicon &= spelled != ""
    truth = (lexicon[word] & (toxic[doc] == 1)).astype(int)
    if not truth.any():
        return Tagger(None, base, base)

    def windows(centres: np.ndarray) -> tuple[list, list]:
        begins = np.maximum(centres - RADIUS, offsets[doc[centres]])
        ends = np.minimum(centres + RADIUS + 1, offsets[doc[centres] + 1])
        cuts = list(zip(begins.tolist(), ends.tolist(), strict=True))
        return [spelled[word[a:b]].tolist() for a, b in cuts], [truth[a:b].tolist() for a, b in cuts]

    hits = random.permutation(np.flatnonzero(truth))[:WINDOWS // 3]
    centres = np.concatenate([hits, random.integers(0, len(word), WINDOWS)])
    crf = train(*windows(centres), labels=[0, 1], epochs=2)
    scores = crf.emissions(words)
    margin = np.where(lexicon, -np.inf, scores[:, 1] - scores[:, 0])
    worst = np.argsort(-margin)[:HARD]
    order = np.argsort(word, kind="stable")
    where = order[np.searchsorted(word[order], worst)]
    crf = train(*windows(np.concatenate([centres, where])), labels=[0, 1], epochs=3)
    largest = _largest(crf, words, word, offsets)[0]
    span = largest >= 0.5

    def share(rows: np.ndarray) -> float:
        return float((toxic[rows].sum() + base) / (rows.sum() + 1))

    return Tagger(crf, share(~span), share(span))


def _largest(crf: Crf, words: pa.Array, word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest probability in each text (0 without words), and that of every token (0 without letters)."""
    first = np.zeros(len(word), bool)
    first[offsets[:-1][offsets[:-1] < len(word)]] = True
    lettered = ~pc.equal(words, "").to_numpy(zero_copy_only=False)
    each = crf.marginals(crf.emissions(words)[word], first)[:, 1] * lettered[word]
    found = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        found[full] = np.maximum.reduceat(each, offsets[:-1][full])
    return found, each


def spans_of(text: str, toxic: np.ndarray) -> list[dict]:
    """Character offsets of runs of toxic tokens."""
    places = [m.span() for m in TOKEN.finditer(text)]
    toxic = toxic[len(toxic) - len(places):] if len(toxic) >= len(places) else toxic
    out: list[dict] = []
    for (start, end), bad, before in zip(places, toxic, [False, *toxic[:-1]], strict=False):
        if bad and before:
            out[-1]["end"] = end
        elif bad:
            out.append({"start": start, "end": end})
    return out


def score_texts(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts, n = batch.column("text"), batch.num_rows
            largest, spans = np.zeros(n), [[] for _ in range(n)]
            if tagger.crf:
                words, word, offsets = words_of(texts)
                largest, each = _largest(tagger.crf, words, word, offsets)
                for i in np.flatnonzero(largest >= 0.5):
                    spans[i] = spans_of(texts[i].as_py(), each[offsets[i]:offsets[i + 1]] >= 0.5)
            score = (tagger.without_span + (tagger.with_span - tagger.without_span) * largest).clip(0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(SPAN))],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return source.mapInArrow(run, SCHEMA)
