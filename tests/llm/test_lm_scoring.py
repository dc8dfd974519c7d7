"""Language-model scores: word counts by brute force; the model bit by bit, as a distribution, and on held-out texts."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from visitflow.llm import context_mixing as M
from visitflow.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def word_columns(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows."""
    counts, ends = Counter(), 0
    for doc_id, text in rows:
        if not is_held_out(doc_id):
            counts.update(words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    found = []
    for doc_id, text in rows:
        own = words(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        found.append((doc_id, is_held_out(doc_id), len(own) + 1, sum(counts[w] > 0 for w in own) + (ends > 0), n, round(base, 6)))
    return found


@pytest.mark.parametrize("frame", ["documents", "awkward", "empty"])
def test_counts_and_base_equal_brute_force(request, frame, monkeypatch):
    # With few frequent words the join of rare words is taken, too.
    monkeypatch.setattr(M, "FREQUENT", 50)
    docs = request.getfixturevalue(frame)
    rows = M.score_texts(docs.repartition(5)).collect()
    wanted = word_columns([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in rows), key=str) == sorted(wanted, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_held_out_texts_and_equal_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.text]
    bits = -sum(r.score for r in held) / math.log10(2) / sum(len(r.text.encode()) + 1 for r in held)
    assert 1 < bits < 2.4  # single bytes alone need more than 4
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.score) == r.score


def test_without_training_texts_every_bit_is_even(spark):
    held = [i for i in range(60) if is_held_out(i)]
    rows = M.score_texts(spark.createDataFrame([(i, "Some text") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.n_tokens) for r in rows} == {(0, 0, 3)}
    assert all(math.isclose(r.score, -80 * math.log10(2), rel_tol=1e-6) for r in rows)


def learned(texts):
    """Tables of these texts, counted without Spark, one byte and one bit at a time."""
    ones, seen = np.zeros((2, M.slots()))
    for text in texts:
        raw = b"\0" * M.ORDERS + text.encode().translate(LOWER) + b"\xff"
        for i in range(M.ORDERS, len(raw)):
            window = np.array([int.from_bytes(raw[i - M.ORDERS:i + 1], "big")], np.uint64)
            for order in range(1, M.ORDERS + 1):
                for j, slot in enumerate(M.order_slots(window, order)[0]):
                    ones[slot] += raw[i] >> (7 - j) & 1
                    seen[slot] += 1
    odds = np.log((ones + M.PRIOR) / (seen - ones + M.PRIOR)) * M.STEPS
    return np.clip(np.rint(odds), -127, 127).astype(np.int8)


TEXTS = ["the cat sat on the mat", "The dog sat on the log. Ünï", "\0\0 odd", ""]


def test_tables_equal_bit_by_bit_counts(spark):
    frame = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").repartition(3)
    found = M.log_odds(M.slot_counts(M.window_counts(frame)))
    wanted = learned([*TEXTS, ""])
    assert (np.abs(found.astype(int) - wanted) <= 1).all() and ((found != 0) == (wanted != 0)).all()


@pytest.fixture(scope="module")
def reader():
    reader = M.Reader(learned(TEXTS[:2]))
    for _ in range(5):
        reader.learn_first(pa.array(TEXTS))
        reader.learn_second(pa.array(TEXTS))
    return reader


def test_probabilities_of_the_next_byte_add_up_to_one(reader):
    # The texts "the " + byte + "..." share their start, so their first blocks differ in that byte only.
    for prefix in ("", "the ca", "zzz"):
        start = np.frombuffer(b"\0" * M.ORDERS + prefix.encode(), np.uint8)
        windows = np.array([int.from_bytes(bytes(start[-M.ORDERS:]) + bytes([b]), "big") for b in range(256)], np.uint64)
        odds = np.hstack([reader.tables.take(M.order_slots(windows, k)) for k in range(1, M.ORDERS + 1)])
        mixed, levels = reader._second_inputs(odds, (odds[:, 16::8] != 0).sum(axis=1))
        total = 0.0
        for b in range(256):
            total += math.exp(reader.second.start().read(
                mixed[b:b + 1].view(np.int8).reshape(1, 8), levels[b:b + 1].view(np.uint8).reshape(1, 8), M._BITS[b:b + 1]))
        assert math.isclose(total, 1, rel_tol=1e-3)


def test_score_does_not_depend_on_the_slice(reader):
    texts = ["the cat " * 400, "dog", "", "the cat " * 400, None]
    together = reader.scores(pa.array(texts))
    alone = [reader.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert together.tolist() == alone and together[0] == together[3] and together[2] == together[4]
    # Reading on, the second stage learns: a repeated text costs less and less.
    assert together[0] > 400 * reader.scores(pa.array(["the cat "]))[0]


def test_long_words_and_hot_unseen_words(spark):
    rows = [(i, "x" * 500 + " common") for i in range(40)] + [(100 + i, "y" * 500) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("row", F.lit(1))
    found = M.score_texts(frame).collect()
    assert sorted(tuple(r)[:5] + (round(r.base_score, 6),) for r in found) == sorted(word_columns(rows))


def test_every_training_text_is_learned_from(spark):
    random = np.random.default_rng(4)

    def text():
        return " ".join("".join(chr(97 + int(c)) for c in random.integers(0, 26, 7)) for _ in range(60))

    # Each text stands in two training rows of one remainder, and some in a held-out row.
    folds = {k: [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == k] for k in range(7)}
    rows, held = [], folds.pop(2)
    for own, copy in zip(folds.values(), held, strict=False):
        texts = [text() for _ in range(6)]
        rows += [*zip(own, texts * 2, strict=False), (copy, texts[0])]
    new, copies = held[len(folds)], held[:len(folds)]
    rows.append((new, text()))
    found = {r.doc_id: r.score for r in M.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A copy of a training text costs far less than a text that is new, whatever the training text's remainder.
    assert max(found[i] / found[new] for i in copies) < 0.6


def test_stages_from_all_windows_without_their_own_occurrence(spark):
    texts = [f"{t} {i % 7}" for i, t in enumerate(TEXTS * 40)]
    windows = M.window_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    counts = M.slot_counts(windows)
    tables = M.odds_tables(counts)
    first, second = M.learn_stages(windows, tables)
    assert round(second.seen.sum() - M.Second.new().seen.sum()) == 8 * sum(len(t.encode()) + 1 for t in texts)
    # The tables without one bit equal those of counts that lack it.
    by_slot = {r.slot: (r.n0, r.n1) for r in counts.collect()}
    rows = [r for r in windows.collect() if r.n < 40]
    window = np.array([r.window for r in rows], np.uint64)
    odds = M.left_out_odds(window, tables[1:].ravel())
    bits = M._BITS[(window & np.uint64(255)).astype(int)]
    for k in range(1, M.ORDERS + 1):
        for i, own in enumerate(M.order_slots(window, k).tolist()):
            for j, slot in enumerate(own):
                n0, n1 = by_slot[slot]
                n0, n1 = n0 - (bits[i, j] == 0), n1 - (bits[i, j] == 1)
                wanted = np.clip(np.rint(np.log((n1 + M.PRIOR) / (n0 + M.PRIOR)) * M.STEPS), -127, 127)
                assert abs(int(odds[i, 8 * (k - 1) + j]) - wanted) <= 1
    # No weights close by are likelier.
    rows = windows.collect()
    window, n = (np.array([r[c] for r in rows]) for c in ("window", "n"))
    odds = M.left_out_odds(window.astype(np.uint64), tables[1:].ravel())
    parts = odds, M._gates(odds), M._BITS[window & 255], n

    def loss(weights):
        by_bit = weights.reshape(M.GATES, M.ORDERS, 8).transpose(0, 2, 1)
        return M.first_sums(*parts, by_bit)[..., 0].sum() + M.PULL / 2 * ((weights - 0.3) ** 2).sum()

    random = np.random.default_rng(5)
    assert all(loss(first.weights) < loss(first.weights + random.normal(0, 0.1, first.weights.shape)) for _ in range(5))


def test_block_counted_by_cells_equals_bit_by_bit(reader):
    random = np.random.default_rng(3)
    odds = random.integers(-127, 128, (3000, M.ORDERS * 8)).astype(np.int8)
    gates = random.integers(0, M.GATES, 3000)
    mixed, levels = (p.view(np.uint8).reshape(-1, 8) for p in reader._second_inputs(odds, gates))
    byte = random.integers(0, 256, 3000).astype(np.uint8)
    bits, place = M._BITS[byte], np.arange(8)
    own, second, wanted = reader.second.start(), reader.second.start(), 0.0
    for part in (slice(0, 500), slice(500, 3000)):
        # As defined, in double precision: one probability for each bit.
        rate = own.ones / own.seen
        x, refined = mixed[part].view(np.int8) / M.STEPS, np.log(rate / (1 - rate)).ravel()[levels[part]]
        one = 1 / (1 + np.exp(-(x * own.weights[0] + refined * own.weights[1])))
        wanted += np.log(np.maximum(np.where(bits[part] == 1, one, 1 - one), M.LEAST)).sum()
        gradient = np.stack([((bits[part] - one) * x).sum(axis=0), ((bits[part] - one) * refined).sum(axis=0)])
        own.squares = own.squares + gradient ** 2
        own.weights = own.weights + own.RATE * gradient / np.sqrt(own.squares)
        np.add.at(own.ones, (place, levels[part] % M.LEVELS), bits[part])
        np.add.at(own.seen, (place, levels[part] % M.LEVELS), 1)
    cells = reader._cells(byte, odds, gates)
    found = sum(second.read_cells(cells[part].view(np.uint16)) for part in (slice(0, 500), slice(500, 3000)))
    assert math.isclose(found, wanted, rel_tol=1e-7)
    assert np.allclose(second.ones, own.ones) and np.allclose(second.seen, own.seen) and np.allclose(second.weights, own.weights)
    # A block costs a number of counts that does not grow with its bytes.
    assert len(M._CELLS) < 300


def test_scoring_a_slice_needs_little_memory(reader):
    random = np.random.default_rng(8)
    letters = random.integers(97, 123, M.SCORED).astype(np.uint8).tobytes().decode()
    texts = pa.array([letters[i:i + 4096] for i in range(0, len(letters), 4096)])
    tracemalloc.start()
    reader.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Besides Arrow's: a number a byte for its window and 16 bytes for each distinct window, but not their log odds.
    assert peak < 40 * M.SCORED
