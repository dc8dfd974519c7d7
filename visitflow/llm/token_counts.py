"""Token counts of whole texts with the whole-token shortcut, for a sentencepiece BPE model.

Offline proof, once per model: no vocabulary piece has the space mark after another character, so no merge crosses the
start of a word and a text's tokens are the tokens of its words; and which pieces, with the mark in front, the library
encodes as exactly one token. Words in that proved table count one without encoding. Only the others are merged by the
library, each distinct word of a slice once.

Results in special cases: a NULL or empty text has 0 bytes and 0 tokens; repeated rows count each; further columns are
ignored. Texts with runs of spaces, spaces at an end or a space mark of their own are cut before each run of marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from visitflow.llm.common import list_offsets, sums_by_list, text_slices

MARK = "▁"
ODD = f"  |^ | $|{MARK}"
RUNS = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(model: bytes) -> list[str]:
    """Words (without their mark) that the model encodes as one token. Raises where words are not independent."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("a piece crosses the start of a word, so words can't be counted one by one")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return [w for w, ids in zip(words, processor.encode(words), strict=True) if len(ids) == 1]


def _count_odd(processor, text: str) -> int:
    total = 0
    for run in RUNS.findall(MARK + text.replace(" ", MARK)):
        total += 1 if run == MARK else len(processor.encode(run[1:].replace(MARK, " ")))
    return total


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``docs`` has doc_id and text."""
    whole = prove_whole_tokens(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proved = pa.array(whole)
        for batch in text_slices(batches):
            text = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.binary_length(text).to_numpy().astype(np.int64)
            odd = pc.match_substring_regex(text, ODD).to_numpy(zero_copy_only=False)
            plain = ~odd & (n_bytes > 0)
            n_tokens = np.zeros(len(text), np.int64)
            if plain.any():
                lists = pc.split_pattern(text.filter(pa.array(plain)), " ")
                words = lists.flatten().dictionary_encode()
                known = pc.is_in(words.dictionary, value_set=proved).to_numpy(zero_copy_only=False)
                each = np.ones(len(known), np.int64)
                rest = words.dictionary.filter(pa.array(~known)).to_pylist()
                each[~known] = [len(ids) for ids in processor.encode(rest, num_threads=1)] if rest else []
                n_tokens[plain] = sums_by_list(each[words.indices.to_numpy()], list_offsets(lists))
            for i in np.flatnonzero(odd):
                n_tokens[i] = _count_odd(processor, text[i].as_py())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit,
            })

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, SCHEMA)
