"""Language-model scores by online logistic mixing of hashed-context bit predictors, next to smoothed word counts.

The model reads the lower-cased bytes of a text and one end mark (a byte that UTF-8 lacks), each byte as eight binary
decisions. A predictor per order, 1 to 5 bytes of context, looks up the log odds of the next bit in a hashed table, in a
slot named by the context and the byte's bits so far. The first mixer adds up the predictors' log odds with weights; the
set of weights is gated by how many of the longer contexts are known, and by the bit's place. Its weights are learned
from all training texts and then stand, so its result is a function of the six-byte window and is computed once per
distinct window of a slice. The second stage goes on learning in every text: counts of ones by level of
confidence refine the mixed probability, and a final mixer weighs refined against mixed log odds. A text is read in blocks
that grow from 512 to 4096 bytes; every block is coded with what was learned up to its start, and then updates it. So the
probability is a proper one, depends on nothing but the text and the model, and two equal texts have equal scores.

All is learned from all training texts: counts of all six-byte windows, which Spark adds up, then of the tables' slots,
then one signed byte of log odds per slot (the tables have a fixed number of slots, ``slots()``). Both mixers and the levels'
first counts are learned from the counted windows, each with the log odds that the slots have without the window's own
occurrence, so that its contexts are as new to them as those of other texts. The first mixer takes Newton steps on the
likelihood of all training bytes, a pass over the windows each; of the second stage one pass counts all bits by first log
odds and level, and the driver fits its weights to these few thousand counts.

Words: counts of all words are added up by Spark. A word of up to ``SHORT`` bytes that makes more than a 2**-20th of all
tokens is known to every task (fewer than 2**20 such words); all other words of a text go to their counts in a join, where
no key can be frequent. A longer word stands there by its SHA-256.

Results in special cases: a NULL or empty text is its end alone; a NULL doc_id belongs to no remainder, so it is a
training text and not held out; repeated rows count and are scored each; without training texts every count is 0 and
every bit has probability one half; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import list_offsets, release_memory, stored, text_slices

ORDERS = 5
ORDER_BITS = (16, 22, 22, 22, 22)
PAGE_BITS = 16
STEPS = 16.0  # log odds are kept in sixteenths
PRIOR = 0.1  # of a bit, added to both of a slot's counts
GATES, LEVELS = 4, 25
BLOCKS = (512, 4096)
ROUNDS, CLOSE, PULL = 7, 0.05, 1.0
FREQUENT, SHORT = 1 << 20, 64
HELD_WINDOWS, SENT_ROWS, SCORED = 1 << 21, 1 << 16, 4 << 20
LEAST = np.float32(1e-5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ADD_ORDERS = np.tile(np.eye(8, dtype=np.float32), (ORDERS, 1))
_BIT_LEVELS = np.arange(0, 8 * LEVELS, LEVELS, dtype=np.uint8)


def _levels(z: np.ndarray) -> np.ndarray:
    return ((z + 8) * np.float32(1.5) + np.float32(0.5)).astype(np.uint8)


def _cells() -> np.ndarray:
    """(cells, 2): level and first log odds (in ``STEPS``) that go together, by level; a log odds has two levels at most."""
    mixed = np.arange(-126, 127)
    ends = [_levels(np.clip((mixed + side) / STEPS, -7.9, 7.9)) for side in (-0.499, 0.499)]
    return np.unique([(level, m) for side in ends for level, m in zip(side.tolist(), mixed.tolist(), strict=True)], axis=0)


_CELLS = _cells()
_CELL_LEVEL, _CELL_ODDS = _CELLS[:, 0], _CELLS[:, 1] / STEPS
_LEVEL_STARTS = np.searchsorted(_CELL_LEVEL, np.arange(LEVELS))
# The cell of a level and of log odds as an unsigned byte; pairs that can't occur lead outside the counts.
_CELL_OF = np.full((LEVELS, 256), 1 << 14, np.uint16)
_CELL_OF[_CELL_LEVEL, _CELLS[:, 1] % 256] = np.arange(len(_CELLS))
_BIT_CELLS = np.arange(0, 8 * len(_CELLS), len(_CELLS), dtype=np.uint16)
_BYTES = np.arange(256)
_BITS = np.unpackbits(_BYTES.astype(np.uint8)[:, None], axis=1).astype(np.float32)
# The node of a byte's bit: a one and the bits before it.
_NODES = np.stack([(1 << j) | (_BYTES >> (8 - j)) for j in range(8)], axis=1)


def slots() -> int:
    return sum(1 << b for b in ORDER_BITS)


# ---------------------------------------------------------------- windows and slots


def byte_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, five zeros before and an end mark behind each; the window that ends at each byte (0 in front
    of a text); where each text's first byte stands, and the place behind its end mark, two by two."""
    raw = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary())
    marked = pc.binary_join_element_wise(b"\0" * ORDERS, raw, b"\xff", b"")
    sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes + ORDERS
    data = np.frombuffer(marked.buffers()[2], np.uint8)[:ends[-1] if len(ends) else 0]
    # The eight bytes that end at each place, read as one big-endian number; the last six are the window.
    led = np.concatenate([np.zeros(7, np.uint8), data])
    window = np.ndarray(len(data), ">u8", led, strides=(1,)).astype(np.uint64)
    window &= np.uint64((1 << (8 * ORDERS + 8)) - 1)
    window[(begins[:, None] - np.arange(1, ORDERS + 1)).ravel()] = 0
    return data, window, np.stack([begins, ends], axis=1)


def order_slots(windows: np.ndarray, order: int) -> np.ndarray:
    """(windows, 8): the slots of one order's table that the eight bits of the windows' last bytes meet."""
    history = (windows >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    bits, start = ORDER_BITS[order - 1], sum(1 << b for b in ORDER_BITS[:order - 1])
    if order == 1:
        base, nodes = history << np.uint64(8), _NODES.astype(np.int32)
    else:
        with np.errstate(over="ignore"):
            base = ((history + np.uint64(order)) * _MIX) >> np.uint64(64 - bits)
        nodes = (_NODES * 0x9E3779B1 & ((1 << bits) - 1)).astype(np.int32)
    found = nodes.take((windows & np.uint64(255)).astype(np.intp), axis=0)
    found ^= base.astype(np.int32)[:, None]
    found += np.int32(start)
    return found


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, *[np.bincount(at, v, len(keys)).astype(np.int64) for v in values]


def window_counts(texts: DataFrame) -> DataFrame:
    """(context, window, n): how often every window occurs in all texts; rows of one context lie in one partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.StructArray] = []

        def added() -> Iterator[pa.RecordBatch]:
            table = pa.table({
                "window": pa.concat_arrays([h.field("values") for h in held]),
                "n": pa.concat_arrays([h.field("counts") for h in held])})
            table = table.group_by("window").aggregate([("n", "sum")]).combine_chunks()
            window = table["window"].combine_chunks()
            out = pa.RecordBatch.from_pydict({
                "context": pc.shift_right(window, 8), "window": window, "n": table["n_sum"].combine_chunks()})
            yield from (out.slice(k, SENT_ROWS) for k in range(0, out.num_rows, SENT_ROWS))

        for batch in text_slices(batches):
            _, windows, ranges = byte_windows(batch.column("text"))
            found = pc.value_counts(pa.array(windows.view(np.int64)))
            n = found.field("counts").to_numpy().copy()
            n[found.field("values").to_numpy() == 0] -= ORDERS * len(ranges)
            held.append(pa.StructArray.from_arrays([found.field("values"), pa.array(n)], ["values", "counts"]))
            if sum(map(len, held)) > HELD_WINDOWS:
                yield from added()
                held = []
        if held:
            yield from added()
        held.clear()
        release_memory()

    return (
        texts.select("text").mapInArrow(count, "context long, window long, n long")
        .repartition("context").groupBy("context", "window").agg(F.sum("n").alias("n")).filter("n > 0")
    )


def slot_counts(windows: DataFrame) -> DataFrame:
    """(slot, n0, n1): how often each slot's bit was 0 and 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window = batch.column("window").to_numpy().view(np.uint64)
            n = batch.column("n").to_numpy()
            for order in range(ORDERS, 0, -1):
                window, n = _summed(window & np.uint64((1 << (8 * order + 8)) - 1), n)
                ones = np.unpackbits((window & np.uint64(255)).astype(np.uint8)[:, None], axis=1) * n[:, None]
                slot, n1, all_ = _summed(order_slots(window, order).ravel(), ones.ravel(), np.repeat(n, 8))
                yield pa.RecordBatch.from_pydict({"slot": slot, "n0": all_ - n1, "n1": n1})

    counted = windows.select("window", "n").mapInArrow(count, "slot int, n0 long, n1 long")
    return counted.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def odds_tables(counts: DataFrame) -> np.ndarray:
    """(3, slots): the tables of all orders, a signed byte per slot: of all bits, without one bit of 0, without one of 1.

    Pages of at most 2**16 slots come to the driver.
    """
    names = ("all", "no0", "no1")

    def odds(name: str) -> Column:
        n0, n1 = F.col("n0") - int(name == "no0"), F.col("n1") - int(name == "no1")
        own = F.round(F.log((F.greatest(n1, F.lit(0)) + PRIOR) / (F.greatest(n0, F.lit(0)) + PRIOR)) * STEPS)
        return F.greatest(F.least(own, F.lit(127)), F.lit(-127)).cast("int").alias(name)

    rows = counts.select(
        F.shiftright("slot", PAGE_BITS).alias("page"), F.col("slot").bitwiseAND((1 << PAGE_BITS) - 1).alias("at"),
        *map(odds, names))

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros((len(names), 1 << PAGE_BITS), np.int8)
        own[:, rows["at"].to_numpy()] = rows[list(names)].to_numpy().T
        return pd.DataFrame({"page": rows["page"].iloc[:1], "odds": [own.tobytes()]})

    tables = np.zeros((len(names), slots()), np.int8)
    for number, found in rows.groupBy("page").applyInPandas(page, "page int, odds binary").toLocalIterator():
        tables[:, number << PAGE_BITS:(number + 1) << PAGE_BITS] = np.frombuffer(found, np.int8).reshape(len(names), -1)
    return tables


def log_odds(counts: DataFrame) -> np.ndarray:
    """The tables of all orders, a signed byte per slot."""
    return odds_tables(counts)[0]


# ---------------------------------------------------------------- mixing


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fitted(start: np.ndarray, measure: Callable[[np.ndarray], tuple]) -> np.ndarray:
    """Weights (..., d) of least loss for each problem: Newton steps from ``start``, halved where the loss has risen.

    ``measure`` gives loss (...), slope (..., d) and curve (..., d, d); a pull to ``start`` keeps weights without data there.
    """
    best = here = start.astype(float)
    lowest, move = np.full(start.shape[:-1], np.inf), np.zeros(start.shape)
    for _ in range(ROUNDS):
        loss, slope, curve = measure(here)
        away = here - start
        loss = loss + PULL / 2 * (away * away).sum(axis=-1)
        ahead = -np.linalg.solve(curve + PULL * np.eye(start.shape[-1]), (slope + PULL * away)[..., None])[..., 0]
        better = (loss < lowest)[..., None]
        lowest, best, move = np.minimum(loss, lowest), np.where(better, here, best), np.where(better, ahead, move / 2)
        here = best + move
        if np.abs(move).max() < CLOSE:
            return np.round(here, 4)
    return np.round(best, 4)


def first_sums(odds: np.ndarray, gates: np.ndarray, bits: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(gate, bit, 1 + orders + orders**2): loss, slope and curve of the first mixer over bytes that occur ``n`` times."""
    out = np.zeros((GATES, 8, 1 + ORDERS + ORDERS ** 2))
    for gate in np.unique(gates):
        mine = np.flatnonzero(gates == gate)
        x = odds[mine].reshape(-1, ORDERS, 8).transpose(2, 1, 0).astype(np.float32, order="C") * np.float32(1 / STEPS)
        bit, times = bits[mine].T, n[mine].astype(np.float32)
        one = _logistic((x * weights[gate].astype(np.float32)[:, :, None]).sum(axis=1))
        fair = np.maximum(np.abs(one + (bit - 1)), LEAST)
        out[gate, :, 0] = -(np.log(fair) * times).sum(axis=1, dtype=float)
        out[gate, :, 1:1 + ORDERS] = (x @ ((one - bit) * times)[:, :, None])[:, :, 0]
        out[gate, :, 1 + ORDERS:] = ((x * (one * (1 - one) * times)[:, None, :]) @ x.transpose(0, 2, 1)).reshape(8, -1)
    return out


@dataclass
class First:
    """The first mixer: a weight per gate, order and bit."""

    weights: np.ndarray

    @classmethod
    def new(cls) -> First:
        return cls(np.full((GATES, ORDERS * 8), 0.3, np.float32))

    @classmethod
    def learned(cls, sums: Callable[[np.ndarray], np.ndarray]) -> First:
        """The mixer of most likelihood; ``sums`` gives what ``first_sums`` does, of all bytes, for weights (gate, bit, order)."""

        def measure(weights: np.ndarray) -> tuple:
            found = sums(weights)
            return found[..., 0], found[..., 1:1 + ORDERS], found[..., 1 + ORDERS:].reshape(GATES, 8, ORDERS, ORDERS)

        weights = fitted(cls.new().weights.reshape(GATES, ORDERS, 8).transpose(0, 2, 1), measure)
        return cls(weights.transpose(0, 2, 1).reshape(GATES, -1).astype(np.float32))

    def mix(self, odds: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Log odds of every bit; ``odds`` holds every order's eight in ``STEPS``, a row per byte."""
        return ((odds * np.float32(1 / STEPS)) * self.weights.take(gates, axis=0)) @ _ADD_ORDERS


@dataclass
class Second:
    """Counts of ones and of all bits (bit, level), and the final mixer: a weight per stage and bit, squared gradients."""

    ones: np.ndarray
    seen: np.ndarray
    weights: np.ndarray
    squares: np.ndarray

    RATE, HELD = 0.03, 32

    @classmethod
    def new(cls) -> Second:
        seen = np.full((8, LEVELS), 4.0)
        return cls(seen * _logistic(np.arange(LEVELS) / 1.5 - 8), seen, np.full((2, 8), 0.5, np.float32),
                   np.full((2, 8), 16, np.float32))

    @classmethod
    def learned(cls, cells: np.ndarray) -> Second:
        """The stage after all bits, counted by ``second_cells``."""
        found, new = cells.reshape(8, LEVELS, 256, 2), cls.new()
        ones, seen = new.ones + found[..., 1].sum(axis=2), new.seen + found.sum(axis=(2, 3))
        place, level, mixed, bit = np.nonzero(found)
        n = found[place, level, mixed, bit]
        rate = ones / seen
        x = np.stack([mixed.astype(np.uint8).view(np.int8) / STEPS, np.log(rate / (1 - rate))[place, level]], axis=1)

        def measure(weights: np.ndarray) -> tuple:
            one = _logistic((x * weights[place]).sum(axis=1))
            sums = np.zeros((8, 7))
            curve = (x[:, :, None] * x[:, None, :]).reshape(-1, 4) * (n * one * (1 - one))[:, None]
            loss = -n * np.log(np.maximum(np.abs(one + bit - 1), LEAST))
            np.add.at(sums, place, np.column_stack([loss, x * (n * (one - bit))[:, None], curve]))
            return sums[:, 0], sums[:, 1:3], sums[:, 3:].reshape(8, 2, 2)

        return cls(ones, seen, fitted(new.weights.T, measure).T.astype(np.float32), new.squares)

    def start(self) -> Second:
        """A copy for a new text; its counts are cut so that they still move."""
        share = np.minimum(1, self.HELD / self.seen)
        return Second(self.ones * share, self.seen * share, self.weights.copy(), np.full_like(self.squares, 16))

    def read(self, mixed: np.ndarray, levels: np.ndarray, bits: np.ndarray) -> float:
        """Log probability of a block's bits by what was learned before it; then learns from the block.

        ``mixed`` are the first mixer's log odds in ``STEPS``, ``levels`` the places of their bits and levels.
        """
        return self.read_cells(bit_cells(mixed, levels, bits).ravel())

    def read_cells(self, cells: np.ndarray) -> float:
        """The same for the ``bit_cells`` of a block: bits of one cell have one probability, so they are counted."""
        zeros, ones = np.bincount(cells, minlength=16 * len(_CELLS)).reshape(2, 8, -1).astype(float)
        rate = self.ones / self.seen
        refined = np.log(rate / (1 - rate)).take(_CELL_LEVEL, axis=1)
        one = _logistic(_CELL_ODDS * self.weights[0][:, None] + refined * self.weights[1][:, None])
        found = np.vdot(zeros, np.log(np.maximum(1 - one, LEAST))) + np.vdot(ones, np.log(np.maximum(one, LEAST)))

        seen = zeros + ones
        miss = ones - seen * one
        gradient = np.stack([miss @ _CELL_ODDS, np.einsum("ij,ij->i", miss, refined)])
        self.squares += gradient * gradient
        self.weights += self.RATE * gradient / np.sqrt(self.squares)
        self.ones += np.add.reduceat(ones, _LEVEL_STARTS, axis=1)
        self.seen += np.add.reduceat(seen, _LEVEL_STARTS, axis=1)
        return float(found)


def bit_cells(mixed: np.ndarray, levels: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(bytes, 8): a number for each bit's place, cell and value."""
    cell = _CELL_OF.ravel().take((levels - _BIT_LEVELS).astype(np.intp) * 256 + mixed.view(np.uint8))
    return cell + _BIT_CELLS + bits.astype(np.uint16) * np.uint16(8 * len(_CELLS))


def _blocks(begin: int, end: int) -> Iterator[slice]:
    sizes = iter(BLOCKS)
    while begin < end:
        stop = min(begin + next(sizes, BLOCKS[-1]), end)
        yield slice(begin, stop)
        begin = stop


def _gates(odds: np.ndarray) -> np.ndarray:
    """How many of the three longest contexts are known."""
    return (odds[:, 16::8] != 0).sum(axis=1)


def left_out_odds(windows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """(windows, orders * 8): log odds of the windows' slots without one occurrence of the window itself; ``held`` are the
    tables without a bit of 0 and without a bit of 1, one after the other."""
    bit = _BITS.take((windows & np.uint64(255)).astype(np.intp), axis=0).astype(np.int32) * np.int32(slots())
    return np.hstack([held.take(order_slots(windows, k) + bit) for k in range(1, ORDERS + 1)])


class Reader:
    """Scores texts with the tables and both stages, or learns the stages from texts."""

    def __init__(self, tables: np.ndarray, first: First | None = None, second: Second | None = None):
        self.tables, self.first, self.second = tables, first or First.new(), second or Second.new()

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows, the texts' ranges, and each place's window."""
        _, windows, ranges = byte_windows(texts)
        coded = pa.array(windows.view(np.int64)).dictionary_encode()
        return coded.dictionary.to_numpy().view(np.uint64), ranges, coded.indices.to_numpy()

    def _odds(self, windows: np.ndarray) -> np.ndarray:
        return np.hstack([self.tables.take(order_slots(windows, k)) for k in range(1, ORDERS + 1)])

    def _second_inputs(self, odds: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First log odds and levels of eight bits, packed in eight bytes each."""
        mixed, levels = np.empty((2, len(odds), 8), np.uint8)
        for at in range(0, len(odds), 1 << 14):
            part = slice(at, at + (1 << 14))
            z = np.clip(self.first.mix(odds[part], gates[part]), -7.9, 7.9)
            mixed[part] = np.rint(z * np.float32(STEPS)).astype(np.int8).view(np.uint8)
            levels[part] = _levels(z) + _BIT_LEVELS
        return mixed.view(np.int64).ravel(), levels.view(np.int64).ravel()

    def _cells(self, byte: np.ndarray, odds: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """The ``bit_cells`` of windows, a window's eight numbers packed in one item of 16 bytes."""
        mixed, levels = (p.view(np.uint8).reshape(-1, 8) for p in self._second_inputs(odds, gates))
        cells = np.empty((len(odds), 8), np.uint16)
        for at in range(0, len(odds), 1 << 14):
            part = slice(at, at + (1 << 14))
            cells[part] = bit_cells(mixed[part], levels[part], _BITS.take(byte[part], axis=0))
        return cells.view(np.complex128).ravel()

    def scores(self, texts: pa.Array) -> np.ndarray:
        """log10 of every text's probability."""
        distinct, ranges, at = self._coded(texts)
        # Log odds are as wide as forty bytes a window, so few windows are looked up at once.
        cells = np.empty(len(distinct), np.complex128)
        for k in range(0, len(distinct), 1 << 14):
            part = distinct[k:k + (1 << 14)]
            odds = self._odds(part)
            cells[k:k + (1 << 14)] = self._cells(part.astype(np.uint8), odds, _gates(odds))
        total = np.zeros(len(ranges))
        for i, (begin, end) in enumerate(ranges.tolist()):
            second = self.second.start()
            total[i] = sum(second.read_cells(cells.take(at[b]).view(np.uint16)) for b in _blocks(begin, end))
        return total / math.log(10)

    def second_cells(self, odds: np.ndarray, gates: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Number of bits by place, level, first log odds and value, of bytes that occur ``n`` times."""
        mixed, levels = (p.view(np.uint8).reshape(-1, 8) for p in self._second_inputs(odds, gates))
        cell = (levels.astype(np.int32) * 256 + mixed) * 2 + bits.astype(np.int32)
        return np.bincount(cell.ravel(), np.repeat(n, 8), 8 * LEVELS * 512)

    def _distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        distinct, ranges, at = self._coded(texts)
        odds = self._odds(distinct)
        own = np.concatenate([np.arange(a, b) for a, b in ranges.tolist()])
        return odds, _gates(odds), _BITS.take(distinct.astype(np.uint8), axis=0), np.bincount(at[own], minlength=len(odds))

    def learn_first(self, texts: pa.Array) -> None:
        parts = self._distinct(texts)
        self.first = First.learned(lambda weights: first_sums(*parts, weights))

    def learn_second(self, texts: pa.Array) -> None:
        self.second = Second.learned(self.second_cells(*self._distinct(texts)))


# ---------------------------------------------------------------- words


def text_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of all texts one after the other, and the number of each text's words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(parts), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return parts.filter(real).dictionary_encode(), np.diff(before[list_offsets(lists)])


def word_keys(words: pa.Array) -> pa.Array:
    """What stands for a word in a table of counts: the word, or a space and its SHA-256 if it is long."""
    long_ = pc.greater(pc.binary_length(words), SHORT).to_numpy(zero_copy_only=False)
    if not long_.any():
        return words
    import hashlib

    keys = words.to_pylist()
    for i in np.flatnonzero(long_):
        keys[i] = " " + hashlib.sha256(keys[i].encode()).hexdigest()
    return pa.array(keys, pa.string())


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, n_train) over all ``texts`` (text, train)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, sizes = text_words(batch.column("text"))
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), sizes)
            index = words.indices.to_numpy(zero_copy_only=False)
            size = len(words.dictionary)
            yield pa.RecordBatch.from_pydict({
                "word": word_keys(words.dictionary), "n": np.bincount(index, minlength=size),
                "n_train": np.bincount(index[train], minlength=size)})
        release_memory()

    counted = texts.select("text", "train").mapInArrow(count, "word string, n long, n_train long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


# ---------------------------------------------------------------- jobs


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def learn_stages(windows: DataFrame, tables: np.ndarray) -> tuple[First, Second]:
    """Both stages from all ``windows`` (window, n); ``tables`` are those of ``odds_tables``."""
    held = windows.sparkSession.sparkContext.broadcast(tables[1:].ravel())

    def added(sums: Callable[..., np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                window = batch.column("window").to_numpy().view(np.uint64)
                odds = left_out_odds(window, held.value)
                bits = _BITS.take((window & np.uint64(255)).astype(np.intp), axis=0)
                total += sums(odds, _gates(odds), bits, batch.column("n").to_numpy()).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "value": total[at]})
            release_memory()

        parts = windows.select("window", "n").mapInArrow(run, "at int, value double")
        found = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[found["at"].to_numpy()] = found["value"].to_numpy()
        return out

    shape = (GATES, 8, 1 + ORDERS + ORDERS ** 2)
    first = First.learned(lambda weights: added(
        lambda *parts: first_sums(*parts, weights), math.prod(shape)).reshape(shape))
    reader = Reader(np.zeros(0, np.int8), first)
    second = Second.learned(added(reader.second_cells, 8 * LEVELS * 512))
    held.unpersist()
    return first, second


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    The rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out; all others are learned from.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id")
    rows = docs.select(doc_id.cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", F.coalesce(remainder(doc_id, folds) == fold, F.lit(False)))
    train = rows.filter(~F.col("held_out"))
    windows = stored(window_counts(train).select("window", "n"), "windows")
    tables = odds_tables(stored(slot_counts(windows), "slot-counts"))
    stages = learn_stages(windows, tables)
    words = stored(word_counts(rows.withColumn("train", ~F.col("held_out"))), "word-counts")
    n, n_train, v = words.agg(F.sum("n"), F.sum("n_train"), F.count_if(F.col("n_train") > 0)).first()
    ends = train.count()
    total, distinct = (n_train or 0) + ends, v + (ends > 0)
    is_frequent = (F.col("n") * FREQUENT > (n or 0)) & (F.octet_length("word") <= SHORT)
    often = words.filter(is_frequent).select("word", "n_train").toArrow()
    known = spark.sparkContext.broadcast((tables[0], stages, often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, stages, often = known.value
        reader, at = Reader(tables, *stages), TaskContext.get().partitionId() << 33
        frequent = often.column("word").combine_chunks()
        counts = np.append(often.column("n_train").to_numpy(), 0)
        logs = np.log10(counts + 1.0)
        for batch in text_slices(batches, limit=SCORED):
            words, sizes = text_words(batch.column("text"))
            place = pc.fill_null(pc.index_in(words.dictionary, value_set=frequent), len(frequent)).to_numpy()
            index = words.indices.to_numpy(zero_copy_only=False)
            each = place[index] if len(index) else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            known_sum = np.concatenate([[0], np.cumsum(counts[each] > 0)])
            log_sum = np.concatenate([[0.0], np.cumsum(logs[each])])
            # Words that are not frequent go on with their numbers, once per text.
            rare = np.flatnonzero(each == len(frequent))
            owner = np.repeat(np.arange(len(sizes)), sizes)[rare]
            pairs, times = np.unique(owner * max(len(words.dictionary), 1) + index[rare], return_counts=True)
            owner, word = np.divmod(pairs, max(len(words.dictionary), 1))
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]), pa.int32())
            keys = word_keys(words.dictionary.take(pa.array(word)))
            yield pa.RecordBatch.from_pydict({
                "row": np.arange(at, at + len(sizes)), "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"), "n_words": sizes,
                "known": known_sum[offsets[1:]] - known_sum[offsets[:-1]],
                "logs": log_sum[offsets[1:]] - log_sum[offsets[:-1]],
                "score": reader.scores(batch.column("text")),
                "rare": pa.ListArray.from_arrays(cuts, keys),
                "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
            })
            at += len(sizes)
        release_memory()

    scored = stored(rows.select("doc_id", "held_out", "text").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_words long, known long, logs double, score double,"
        " rare array<string>, times array<long>"), "scored-texts")
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", "w.rare", "w.times")
    counted = words.filter(~is_frequent & (F.col("n_train") > 0)).select("word", "n_train")
    found = rest.join(counted, F.col("rare") == F.col("word")).groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n_train") + 1)).alias("more_logs"))
    zero = F.lit(0).cast("long")
    n_tokens = F.col("n_words") + 1
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", zero) + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + math.log10(ends + 1)
         - n_tokens * math.log10(total + distinct + 1)).alias("base_score"),
        "score")
