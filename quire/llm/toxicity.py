"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is its byte n-grams of 3 to 5, with marks at its ends, and the whole word; each is a row of a
hashed embedding table, so a misspelling nobody has seen shares most of its rows with the word.
Embeddings and softmax are trained together in numpy on a bounded sample of labelled rows. A text
is read in windows of three words, one beginning at each word; the window's mean embedding goes into
the softmax, and a text is as toxic as its worst window, so that one word in a very long text still
counts. Training follows the same rule: a step learns from the window that is worst at that time.

One average over a whole text was tried and does not give right results on texts of thousands of words
(README has the figures); the average over three words does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, frugal, list_array, packed
from .quality import labelled_sample
from .words import Words, mix

BITS, DIM, WINDOW = 18, 8, 3
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def subwords(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the subwords of some words, and how many each word has.

    ASCII punctuation at a word's ends is left off; a word of nothing else keeps it.
    """
    start, end = w.start[words].copy(), w.end[words].copy()
    inner = np.zeros(256, bool)
    inner[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    mark = ~inner[w.data]
    # Of each byte: the next place at or after it, and the last at or before it, that is no mark.
    place = np.arange(len(w.data))
    after = np.minimum.accumulate(np.where(mark, len(w.data), place)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(mark, -1, place))
    if len(words):
        some = after[start] < end
        start, end = np.where(some, after[start], start), np.where(some, before[end - 1] + 1, end)
    length = end - start + 2
    first = np.concatenate([[0], np.cumsum(length)])
    flat = np.empty(first[-1], np.uint8)
    at = np.arange(first[-1]) - np.repeat(first[:-1], length)
    src = np.repeat(start, length) + at - 1
    edge = (at == 0) | (at == np.repeat(length, length) - 1)
    flat[:] = w.data[np.clip(src, 0, len(w.data) - 1)] if len(w.data) else 0
    flat[edge & (at == 0)] = 1
    flat[edge & (at > 0)] = 2
    room = np.repeat(length, length) - at  # bytes from here to the word's end
    value, owner = _BYTE[flat], np.repeat(np.arange(len(words)), length)
    rolling = np.zeros(len(flat), U)
    rows, owners = [], []
    for n in range(1, 6):
        full = max(0, len(flat) - n + 1)
        rolling[:full] = rolling[:full] * _STEP + value[n - 1 :]
        if n >= 3:
            good = room >= n
            rows.append(mix(rolling[good] + U(n)))
            owners.append(owner[good])
    whole = np.add.reduceat(mix(value + at.astype(U) * _STEP), first[:-1]) if len(words) else np.zeros(0, U)
    rows.append(mix(whole))
    owners.append(np.arange(len(words)))
    rows, owners = np.concatenate(rows) >> U(64 - BITS), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a block: first and last word (exclusive) of each window, and the first window of each text."""
    count = np.maximum(1, n_words - WINDOW + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    base = np.cumsum(n_words) - n_words
    lo = np.arange(first[-1]) - np.repeat(first[:-1] - base, count)
    return lo, np.minimum(lo + WINDOW, np.repeat(base + n_words, count)), first


@dataclass
class Bag:
    """A whole text: subword rows of its distinct words, how many each has, and its words in order."""

    rows: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    def worst(self, margin: np.ndarray) -> np.ndarray:
        """The rows of the window whose mean margin is the largest."""
        at = np.cumsum(self.sizes) - self.sizes
        value = np.add.reduceat(margin[self.rows], at, dtype=np.float64)
        total = np.concatenate([[0], np.cumsum(value[self.words])])
        count = np.concatenate([[0], np.cumsum(self.sizes[self.words])])
        lo, hi, _ = windows(np.array([len(self.words)]))
        k = int(np.argmax((total[hi] - total[lo]) / (count[hi] - count[lo])))
        return np.concatenate([self.rows[at[w] : at[w] + self.sizes[w]] for w in self.words[lo[k] : hi[k]]])


@dataclass
class SubwordModel:
    table: np.ndarray  # float32 [2**BITS, DIM]
    out: np.ndarray  # float32 [DIM, 2]
    bias: np.ndarray  # float32 [2]

    @classmethod
    def start(cls, seed: int = 13) -> SubwordModel:
        rng = np.random.default_rng(seed)
        return cls(((rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM), (rng.normal(size=(DIM, 2)) / 2).astype(np.float32), np.zeros(2, np.float32))

    def softmax(self, z: np.ndarray) -> np.ndarray:
        z = z @ self.out + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def step(self, rows: np.ndarray, n: np.ndarray, y: np.ndarray, rate: float, seen: np.ndarray) -> None:
        """One update of all parameters from some bags: rows of the table, bag sizes, labels.

        ``seen`` sums each table row's squared gradients; a row's pace falls with it.
        """
        at = np.cumsum(n) - n
        z = np.add.reduceat(self.table[rows], at) / n[:, None]
        g = self.softmax(z)
        g[np.arange(len(y)), y] -= 1
        g *= np.where(y == 1, 2.0, 1.0).astype(np.float32)[:, None] / len(y)
        each = np.repeat((g @ self.out.T) / n[:, None], n, axis=0)
        self.out -= 0.5 * (z.T @ g)
        self.bias -= 0.1 * g.sum(axis=0)
        distinct, inverse = np.unique(rows, return_inverse=True)
        change = np.stack([np.bincount(inverse, each[:, k], len(distinct)) for k in range(DIM)], axis=1).astype(np.float32)
        seen[distinct] += (change**2).sum(axis=1)
        self.table[distinct] -= rate * change / np.sqrt(seen[distinct])[:, None]

    def fit(self, docs: list[Bag], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.3, seed: int = 17) -> SubwordModel:
        rng = np.random.default_rng(seed)
        seen = np.full(len(self.table), 1e-6, np.float32)
        for epoch in range(epochs):
            for own in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                margin = self.margin()
                worst = [docs[k].worst(margin) for k in own]
                self.step(np.concatenate(worst), np.array([len(x) for x in worst]), y[own], rate * (1 - epoch / (epochs + 2)), seen)
        return self

    def margin(self) -> np.ndarray:
        """What each table row adds to the difference of the two scores."""
        return self.table @ (self.out[:, 1] - self.out[:, 0])


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subword rows of a block's distinct words, counts, first positions, and each word's distinct word."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    rows, n = subwords(w, first)
    return rows, n, np.cumsum(n) - n, inverse


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text as a bag: all its words."""
    for batch in batches:
        for lo, hi, offsets, data in blocks(batch.column(1)):
            with np.errstate(over="ignore"):
                w = Words(offsets, data)
                rows, n, at, inverse = _distinct(w)
            own_rows, own_sizes, own_words = [], [], []
            for a, b in zip(w.first_word[:-1], w.first_word[1:]):
                distinct, words = np.unique(inverse[a:b], return_inverse=True)
                sizes = n[distinct]
                own_rows.append(rows[np.arange(sizes.sum()) + np.repeat(at[distinct] - np.cumsum(sizes) + sizes, sizes)].astype(np.int32).tobytes())
                own_sizes.append(sizes.astype(np.int32).tobytes())
                own_words.append(words.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in (own_rows, own_sizes, own_words))], names=["doc_id", "label", "rows", "sizes", "words"])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, held_out: int | None = 2) -> SubwordModel | None:
    """Fits the model to at most ``most`` labelled texts, each taken whole. None without both classes.

    An id that occurs with several texts has its label learnt for each of them; texts without words and
    labels without a text or a class are left out.
    """
    sample = labelled_sample(docs, labels, label, most, held_out).select("doc_id", "text", "label")
    got = sample.mapInArrow(frugal(_bags), "doc_id long, label int, rows binary, sizes binary, words binary").toArrow()
    array = lambda x: np.frombuffer(x.as_buffer(), np.int32)
    texts = [(d, y, Bag(*map(array, x))) for d, y, *x in zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist(), got.column("rows"), got.column("sizes"), got.column("words"))]
    texts = sorted((t for t in texts if len(t[2].words)), key=lambda t: (t[0], len(t[2].words), zlib.crc32(t[2].rows)))
    y = np.array([t[1] for t in texts], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return SubwordModel.start().fit([t[2] for t in texts], y)


def _scored(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, offsets, data in blocks(batch.column(0).field(place)):
                if got is None:
                    out.append(np.full(hi - lo, 0.5))
                    continue
                margin, bias = got
                with np.errstate(over="ignore"):
                    w = Words(offsets, data)
                    rows, n, at, inverse = _distinct(w)
                value = np.add.reduceat(margin[rows], at) if len(rows) else np.zeros(0)
                total = np.concatenate([[0], np.cumsum(value[inverse], dtype=np.float64)])
                count = np.concatenate([[0], np.cumsum(n[inverse])])
                a, b, first = windows(w.n_words)
                z = (total[b] - total[a]) / np.maximum(1, count[b] - count[a]) + bias
                z = np.maximum.reduceat(z, first[:-1])
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, model: SubwordModel | None, text_column: str = "text") -> DataFrame:
    """(row, score): the source row, kept whole in one struct, and the probability of label 1.

    Null and empty texts are one empty window, scored by the bias alone; without a model every score
    is 0.5. Texts of any length are read whole. Repeated rows each get their score, an empty table gives
    no rows; names of other columns can't clash.
    """
    rows, schema, at = packed(docs, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.margin(), float(model.bias[1] - model.bias[0])))
    return rows.mapInArrow(frugal(_scored(shared, at)), f"row {schema}, score double")
