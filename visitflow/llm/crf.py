"""Linear-chain conditional random field over words: hashed features, training, forward-backward.

A word's features are its letters' n-grams (two to four, with marks at both ends, so affixes are among them) and the word
itself; each hashes to a row of weights, one weight per label. Transition weights are learned with them. Training runs on
a bounded sample in the driver; labelling runs in tasks on all words. Forward-backward treats the words of many texts as
one chain whose links are cut at the first word of each text: products of blocks of the chain first, then the vectors
that enter each block, then all blocks side by side, so its numpy steps are few whatever the texts' lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of weights, word) of every feature of ``words``, ordered by kind."""
    marked = pc.binary_join_element_wise("^", words, "$", "")
    sizes = pc.utf8_length(marked).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows, of = [], []
    code = points.copy()
    with np.errstate(over="ignore"):
        for n in range(2, 5):
            if len(code) < 2:
                break
            code = code[:-1] * np.uint64(1_000_003) + points[n - 1:]
            inside = owner[:len(code)] == owner[n - 1:]
            rows.append(_row(code[inside] + np.uint64(n)))
            of.append(owner[:len(code)][inside])
        place = (np.arange(len(points)) - starts[owner]).astype(np.uint64) + np.uint64(1)
        spread = (points * _MIX) ^ (points << np.uint64(17))
        whole = np.add.reduceat(spread * (place * place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), starts[:-1]) \
            if len(words) else np.zeros(0, np.uint64)
        rows.append(_row(whole))
        of.append(np.arange(len(words)))
    return np.concatenate(rows), np.concatenate(of)


def _row(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(29))) * _MIX
    return ((code ^ (code >> np.uint64(32))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Crf:
    labels: list
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: pa.Array) -> np.ndarray:
        """Score of each label for each word; 0 for a word without letters."""
        rows, of = features(words)
        scores = np.stack([
            np.bincount(of, weights=self.weights[rows, k], minlength=len(words)) for k in range(len(self.labels))
        ], axis=1) if len(words) else np.zeros((0, len(self.labels)))
        scores[pc.equal(words, "").to_numpy(zero_copy_only=False)] = 0
        return scores

    def marginals(self, scores: np.ndarray, first: np.ndarray, block: int = 512) -> np.ndarray:
        """Probability of each label at each word of a chain that begins anew where ``first``."""
        ahead, behind = self.messages(scores, first, block)
        ahead *= behind
        return ahead / ahead.sum(axis=1, keepdims=True)

    def messages(self, scores: np.ndarray, first: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Forward messages, each word's own score included, and backward messages, without it; each adds up to one."""
        n, size = scores.shape
        if not n:
            return np.zeros((0, size)), np.zeros((0, size))
        count = -(-n // block)
        psi = np.ones((count * block, size))
        psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
        cut = np.ones(count * block, bool)
        cut[:n] = first
        psi, cut = psi.reshape(count, block, size), cut.reshape(count, block)
        go, begin = np.exp(self.transitions), np.exp(self.start)
        product = np.broadcast_to(np.eye(size), (count, size, size)).copy()
        for t in range(block):
            step = product @ go
            new = cut[:, t]
            step[new] = product[new].sum(axis=2, keepdims=True) * begin
            step *= psi[:, t, None, :]
            product = step / step.sum(axis=(1, 2), keepdims=True)
        enter, leave = np.ones((count, size)), np.ones((count, size))
        for b in range(1, count):
            v = enter[b - 1] @ product[b - 1]
            enter[b] = v / v.sum()
        for b in range(count - 2, -1, -1):
            v = product[b + 1] @ leave[b + 1]
            leave[b] = v / v.sum()
        ahead, behind = np.empty((2, block, count, size))
        v = enter
        for t in range(block):
            step = v @ go
            new = cut[:, t]
            step[new] = v[new].sum(axis=1, keepdims=True) * begin
            step *= psi[:, t]
            v = step / step.sum(axis=1, keepdims=True)
            ahead[t] = v
        v = leave
        for t in range(block - 1, -1, -1):
            behind[t] = v
            weighted = psi[:, t] * v
            back = weighted @ go.T
            new = cut[:, t]
            back[new] = (weighted[new] * begin).sum(axis=1, keepdims=True)
            v = back / back.sum(axis=1, keepdims=True)
        return tuple(x.transpose(1, 0, 2).reshape(-1, size)[:n] for x in (ahead, behind))


def train(
    sequences: list[list[str]], targets: list[list[int]], labels: list, epochs: int = 4, batch: int = 64,
    rate: float = 0.2, penalty: float = 1e-5, seed: int = 7,
) -> Crf:
    """Weights by stochastic gradient (Adagrad) on the likelihood of ``targets`` given ``sequences`` of words."""
    size, random = len(labels), np.random.default_rng(seed)
    model = Crf(list(labels), np.zeros((1 << BITS, size)), np.zeros((size, size)), np.zeros(size))
    squares, edge_squares = np.full((1 << BITS, size), 1e-3), np.full((size, size), 1e-1)
    start_squares = np.full(size, 1e-1)
    for _ in range(epochs):
        order = random.permutation(len(sequences))
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at:at + batch] if sequences[i]]
            if not chosen:
                continue
            tokens = pa.array([w for i in chosen for w in sequences[i]], pa.string()).dictionary_encode()
            truth = np.array([y for i in chosen for y in targets[i]])
            sizes = [len(sequences[i]) for i in chosen]
            first = np.zeros(len(truth), bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            word = tokens.indices.to_numpy()
            scores = model.emissions(tokens.dictionary)[word]
            ahead, behind = model.messages(scores, first, block=64)
            found = ahead * behind
            found /= found.sum(axis=1, keepdims=True)
            gap = np.eye(size)[truth] - found
            by_word = np.zeros((len(tokens.dictionary), size))
            np.add.at(by_word, word, gap)
            by_word[pc.equal(tokens.dictionary, "").to_numpy(zero_copy_only=False)] = 0
            rows, of = features(tokens.dictionary)
            used, place = np.unique(rows, return_inverse=True)
            slope = np.zeros((len(used), size))
            np.add.at(slope, place, by_word[of])
            slope = slope / len(chosen) - penalty * model.weights[used]
            squares[used] += slope ** 2
            model.weights[used] += rate * slope / np.sqrt(squares[used])
            # Transitions and starts: observed against expected ones.
            linked = ~first[1:]
            seen = np.zeros((size, size))
            np.add.at(seen, (truth[:-1][linked], truth[1:][linked]), 1)
            slope = (seen - expected_pairs(model, scores, ahead, behind, linked)) / len(chosen) - penalty * model.transitions
            edge_squares += slope ** 2
            model.transitions += rate * slope / np.sqrt(edge_squares)
            slope = gap[first].mean(axis=0) - penalty * model.start
            start_squares += slope ** 2
            model.start += rate * slope / np.sqrt(start_squares)
    return model


def expected_pairs(model: Crf, scores: np.ndarray, ahead: np.ndarray, behind: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Expected number of every pair of labels over linked neighbours: alpha(t) * edge * psi(t + 1) * beta(t + 1)."""
    right = (np.exp(scores - scores.max(axis=1, keepdims=True)) * behind)[1:][linked]
    left, edge = ahead[:-1][linked], np.exp(model.transitions)
    whole = ((left @ edge) * right).sum(axis=1, keepdims=True)
    return (left.T @ (right / whole)) * edge
