"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage has counts of byte classes and words and a
hashed word histogram, encoded by a trained layer. Gated attention weights, learnt from document
labels alone, weigh the encoded passages; the weighted sum is scored. Training is numpy on the
driver over a bounded sample of labelled rows; scoring is a map over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, crc32_mod, frugal, packed
from .words import Words, mix

WORDS, BUCKETS = 64, 32
_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = True  # A-Z
_CLASSES[1, 97:123] = True  # a-z
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [ord(c) for c in ".,;:'\"-()?"]] = True  # usual punctuation
_CLASSES[4, [ord(c) for c in "!@#$%^&*+=~<>{}[]\\/`_"]] = True  # symbols
_CLASSES[5, ord("|")] = True
_CLASSES[6, 10] = True
_CLASSES[7, 128:] = True
N_FEATURES = 8 + 9 + BUCKETS


def passages(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the first passage of each text (one entry more).

    A text without words is one passage of zeros.
    """
    with np.errstate(over="ignore"):
        w = Words(offsets, data)
    count = np.maximum(1, -(-w.n_words // WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((first[-1], N_FEATURES), np.float32)
    if not len(w.hash):
        return out, first
    place = np.arange(len(w.hash)) - w.first_word[w.doc]
    own = first[w.doc] + place // WORDS
    head = np.flatnonzero(place % WORDS == 0)
    at = own[head]
    n_words = np.bincount(own, minlength=len(out))[at].astype(np.float32)
    start = w.start[head]
    stop = np.minimum(np.append(start[1:], len(data)), offsets[w.doc[head] + 1])
    n_bytes = (stop - start).astype(np.float32)
    pairs = np.stack([start, stop], axis=1).reshape(-1)
    pairs[-1] = min(pairs[-1], len(data))
    for k, chosen in enumerate(_CLASSES):
        mask = np.append(chosen[data], False)
        out[at, k] = np.add.reduceat(mask, pairs, dtype=np.int32)[::2] / n_bytes
    length = (w.end - w.start).astype(np.float32)
    same = np.zeros(len(w.hash), np.float32)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (place[1:] > 0)
    two = np.zeros(len(w.hash), np.float32)
    two[2:] = (w.hash[2:] == w.hash[:-2]) & (place[2:] > 1)
    sums = lambda x: np.add.reduceat(x, head)
    mean = sums(length) / n_words
    order = np.lexsort((w.hash, own))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (own[order][1:] != own[order][:-1])
    ends = w.data[w.end - 1]
    caps = data[w.start]
    out[at, 8] = np.log1p(mean)
    out[at, 9] = np.sqrt(np.maximum(0, sums(length * length) / n_words - mean * mean)) / 8
    out[at, 10] = sums(same) / n_words
    out[at, 11] = sums(two) / n_words
    out[at, 12] = np.bincount(own[order], fresh, len(out))[at] / n_words
    out[at, 13] = np.log1p(n_words) / 4
    out[at, 14] = sums((length <= 3).astype(np.float32)) / n_words
    out[at, 15] = sums(((caps >= 65) & (caps <= 90)).astype(np.float32)) / n_words
    out[at, 16] = sums((ends == ord(".")).astype(np.float32)) / n_words
    with np.errstate(over="ignore"):
        bucket = (mix(w.hash ^ np.uint64(0x51)) % np.uint64(BUCKETS)).astype(np.int64)
    out[:, 17:] = np.bincount(own * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(1, np.bincount(own, minlength=len(out)))[:, None]
    return out, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """h = tanh(x W + c); weight ~ exp(u . (tanh(h V) * sigmoid(h G))); score = sigmoid(o . sum + b)."""

    p: dict[str, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 3) -> AttentionModel:
        rng = np.random.default_rng(seed)
        n = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        p = {"W": n(N_FEATURES, hidden), "c": np.zeros(hidden, np.float32), "V": n(hidden, gate), "G": n(hidden, gate), "u": n(gate, 1)[:, 0], "o": n(hidden, 1)[:, 0], "b": np.zeros(1, np.float32)}
        return cls(p, x.mean(axis=0), x.std(axis=0) + 0.02)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, at, n = self.p, first[:-1], np.diff(first)
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["G"])
        a = (t * g) @ p["u"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
        a = a / np.repeat(np.add.reduceat(a, at), n)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["o"] + p["b"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"].astype(np.float64)

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        at, n = first[:-1], np.diff(first)
        d = (f["y"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["o"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), n))
        dt, dg = da[:, None] * p["u"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * p["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["G"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "c": dx.sum(axis=0), "V": f["h"].T @ dt, "G": f["h"].T @ dg, "u": (f["t"] * f["g"]).T @ da, "o": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.004, seed: int = 5) -> AttentionModel:
        """Adam over shuffled documents."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        n, step = np.diff(first), 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = order[lo : lo + batch]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in own])
                g = self.gradient(x[rows], np.concatenate([[0], np.cumsum(n[own])]), y[own])
                step += 1
                for k, d in g.items():
                    d = d.astype(np.float32) + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out: int | None = 2) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows, chosen by a hash of the id.

    Rows whose crc32(id) mod 4 is ``held_out`` are never taken. An id that is labelled twice has the greater
    label; each of the texts that occur with an id comes once.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if held_out is not None:
        chosen = chosen.where(crc32_mod("doc_id", 4) != held_out)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(chosen), "doc_id").distinct()  # at most ``most`` ids


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, offsets, data in blocks(batch.column(1)):
            x, first = passages(offsets, data)
            out = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["doc_id", "label", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, held_out: int | None = 2) -> AttentionModel | None:
    """Fits the model to all passages of at most ``most`` labelled documents.

    None where no row is labelled, or only with one class.
    """
    sample = labelled_sample(docs, labels, label, most, held_out).select("doc_id", "text", "label")
    rows = sorted((r[0], r[1], bytes(r[2])) for r in sample.mapInArrow(frugal(_sampled), "doc_id long, label int, x binary").collect())
    if len({r[1] for r in rows}) < 2:
        return None
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x, first = np.concatenate(xs), np.concatenate([[0], np.cumsum([len(a) for a in xs])])
    y = np.array([r[1] for r in rows], np.float32)
    return AttentionModel.start(x).fit(x, first, y)


def _scored(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, offsets, data in blocks(batch.column(0).field(at)):
                x, first = passages(offsets, data)
                out.append(m.score(x, first) if m else np.full(hi - lo, 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["row", "score"])

    return run


def score_quality(docs: DataFrame, model: AttentionModel | None, text_column: str = "text") -> DataFrame:
    """(row, score): the source row, kept whole in one struct, and the probability of label 1.

    Null and empty texts are one empty passage and get that passage's score; without a model every
    score is 0.5. Texts of any length are read whole. Repeated rows each get their score, an empty table
    gives no rows; names of other columns can't clash.
    """
    rows, schema, at = packed(docs, text_column)
    model = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(frugal(_scored(model, at)), f"row {schema}, score double")
