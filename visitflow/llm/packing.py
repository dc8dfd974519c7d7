"""Packing of token sequences into windows by non-negative least squares.

Every task packs the documents of its input split in chunks of about a million tokens. A document of a chunk gives whole windows,
one middle piece of a multiple of ``grid`` tokens and a tail below ``grid``. Shallow combinations (two to ``depth``
lengths) that fill a window exactly are enumerated once; their repeat counts are solved against the chunk's histogram of
middle pieces by non-negative least squares and rounded down to what is there. What is left, and the tails, are packed
greedily end to end, cut at window ends; the last stretch is cut at powers of two, which need no padding. So a chunk has
no padding, and nothing is shuffled or gathered: a lost task is done again on its own split.

Results in special cases: a NULL or empty text is its end token alone; repeated rows are packed each; further columns
are ignored. ``sequence_id`` is the split's number times 2**32 plus a count.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from visitflow.llm.common import list_offsets, release_memory, strings, text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CHUNK_TOKENS = 1 << 20
SLICE = 2 << 20
CACHE = 250_000


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Falling lengths, two to ``depth`` of them, that add up to ``units``."""

    def fill(left: int, largest: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left <= largest:
            yield (left,)
        if parts > 1:
            for first in range(min(largest, left - 1), 0, -1):
                if first * parts < left:
                    break
                for rest in fill(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(fill(units, units - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            trial = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (trial > 1e-9).all():
                x[:] = 0
                x[columns] = trial
                break
            short = trial <= 1e-9
            now = x[columns]
            step = (now[short] / np.maximum(now[short] - trial[short], 1e-12)).min()
            x[columns] = now + step * (trial - now)
            active[columns[(x[columns] <= 1e-9) & short]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def repeat_counts(histogram: np.ndarray, ways: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """Combinations out of ``ways`` and how often each is used; ``histogram[u]`` pieces of u units are there."""
    units, ways = len(histogram), [w for w in ways if all(histogram[u] for u in w)]
    if not ways:
        return []
    uses = np.zeros((units, len(ways)))
    for k, way in enumerate(ways):
        np.add.at(uses[:, k], list(way), 1)
    left, plan = histogram.astype(np.int64).copy(), []
    counts = nnls(uses, left.astype(float))
    for k in np.argsort(-counts, kind="stable"):
        need = uses[:, k].astype(np.int64)
        n = min(int(counts[k] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            plan.append((ways[k], n))
    return plan


def _ends(total: int, window: int) -> Iterator[int]:
    """Where a stretch of ``total`` tokens is cut: at windows, then at falling powers of two."""
    at = 0
    while total - at >= window:
        at += window
        yield at
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        yield at


def pack(lengths: np.ndarray, window: int, grid: int, ways: list) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents with these token counts."""
    units, pieces, sequence = window // grid, [], 0
    by_units: list[list[tuple[int, int]]] = [[] for _ in range(units)]
    stream: list[tuple[int, int, int]] = []
    tails: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= window:
            pieces.append((doc, start, window, sequence, 0))
            sequence, start = sequence + 1, start + window
        if middle := (n - start) // grid:
            by_units[middle].append((doc, start))
            start += middle * grid
        if start < n:
            tails.append((doc, start, n - start))
    for way, times in repeat_counts(np.array([len(x) for x in by_units]), ways):
        for _ in range(times):
            offset = 0
            for u in way:
                doc, start = by_units[u].pop()
                pieces.append((doc, start, u * grid, sequence, offset))
                offset += u * grid
            sequence += 1
    for u in range(units - 1, 0, -1):
        stream += [(doc, start, u * grid) for doc, start in by_units[u]]
    stream += tails
    begin, at, ends = 0, 0, _ends(sum(x[2] for x in stream), window)
    end = next(ends, 0)
    for doc, start, length in stream:
        while length:
            part = min(length, end - at)
            pieces.append((doc, start, part, sequence, at - begin))
            at, start, length = at + part, start + part, length - part
            if at == end:
                sequence, begin, end = sequence + 1, at, next(ends, 0)
    return pieces


def _begins_and_sizes(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.cumsum(sizes) - sizes, sizes


class WordEncoder:
    """Ids of whole texts from the ids of their distinct pre-tokens.

    White space ends every pre-token of such a tokenizer (lower case, a splitting pattern, byte-level BPE). A distinct
    word of ASCII and precomposed Latin letters, on which its normalizer only lowers the case, is split by the tokenizer's
    own pattern and each distinct pre-token goes to its merge model once. Any other word is encoded as it is.
    """

    PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"

    def __init__(self, definition: bytes):
        import regex
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_buffer(definition)
        split, *_ = json.loads(definition)["pre_tokenizer"]["pretokenizers"]
        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        points = [*range(33, 127), *range(192, 256)]
        self.bytes_as_text = {p: level.pre_tokenize_str(chr(p))[0][0] for p in points}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

        # All words of a slice are split at once; no pre-token holds the line feed between two words.
        self.pattern = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.tokens: dict[str, bytes] = {"\n": b""}

    def merge(self, token: str) -> bytes:
        merged = self.tokenizer.model.tokenize(token.translate(self.bytes_as_text))
        return struct.pack(f"<{len(merged)}I", *[t.id for t in merged])

    def merged(self, tokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; those known from earlier slices are not merged again."""
        found = list(map(self.tokens.get, tokens))
        if len(self.tokens) > CACHE:
            self.tokens = {"\n": b""}
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.tokens[tokens[i]] = self.merge(tokens[i])
        return found

    def plain_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of plain ``words``, one after the other, and the number of each word's ids."""
        tokens = pa.array(self.pattern.findall("\n".join(words) + "\n"), pa.string()).dictionary_encode()
        distinct = strings(tokens.dictionary)
        end = distinct.index("\n")
        ids = self.merged(distinct)
        index = tokens.indices.to_numpy()
        pool, begins, sizes = np.frombuffer(b"".join(ids), "<u4"), *_begins_and_sizes(ids)
        each = sizes[index]
        until = np.concatenate([[0], np.cumsum(each)])
        flat = pool[np.repeat(begins[index] - until[:-1], each) + np.arange(until[-1])]
        return flat.tobytes(), np.diff(until[np.concatenate([[0], np.flatnonzero(index == end) + 1])])

    def any_word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``words``, plain ones first, where each word's ids begin, and their number."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        for content in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, content))
        is_plain = plain.to_numpy(zero_copy_only=False)
        sizes, parts = np.zeros(len(words), np.int64), []
        if is_plain.any():
            found, sizes[is_plain] = self.plain_words(strings(pc.utf8_lower(words.filter(plain))))
            parts.append(found)
        other = [self.any_word(w) for w in strings(words.filter(pc.invert(plain)))]
        sizes[~is_plain] = [len(x) // 4 for x in other]
        order = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        begins = np.zeros(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.frombuffer(b"".join(parts + other), "<u4"), begins, sizes

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, one after the other, and where each begins."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        pool, begins, counts = self.words(words.dictionary)
        index = words.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
        sizes = counts[index]
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = pool[np.repeat(begins[index] - before[:-1], sizes) + np.arange(before[-1])]
        return flat, before[list_offsets(lists)]


def pack_documents(
    docs: DataFrame, tokenizer: bytes, end_id: int, window: int = 4096, grid: int = 64, depth: int = 4,
    with_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """Pieces of every document; ``docs`` has doc_id and text. ``with_ids`` adds the ids of each piece.

    ``tokenizer`` is the content of a JSON file of the tokenizers library, for which ``WordEncoder`` holds.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sequence = WordEncoder(tokenizer), TaskContext.get().partitionId() << 32
        doc_ids: list = []
        token_ids: list[np.ndarray] = []
        ways = combinations(window // grid, depth)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            pieces = pack(np.array([len(x) for x in token_ids]), window, grid, ways)
            for i in range(0, len(pieces), 50_000):
                yield table(pieces[i:i + 50_000])
            sequence += 1 + max((p[3] for p in pieces), default=-1)

        def table(pieces: list) -> pa.RecordBatch:
            parts = [token_ids[d][s:s + n] for d, s, n, _, _ in pieces]
            columns = {
                "doc_id": pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
                "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
                "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in parts],
                "doc_tokens": [len(token_ids[p[0]]) for p in pieces],
                "sequence_id": [sequence + p[3] for p in pieces], "offset": [p[4] for p in pieces],
            }
            if with_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        held = 0
        release_memory()
        for batch in text_slices(batches, limit=SLICE):
            ids, starts = own.texts(pc.fill_null(batch.column("text"), ""))
            for k in range(batch.num_rows):
                doc = np.append(ids[starts[k]:starts[k + 1]], np.uint32(end_id))
                doc_ids.append(batch.column("doc_id")[k].as_py())
                token_ids.append(doc)
                held += len(doc)
            if held >= chunk_tokens:
                yield from flush()
                doc_ids, token_ids, held = [], [], 0
        if doc_ids:
            yield from flush()
        own = doc_ids = token_ids = None
        release_memory()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
