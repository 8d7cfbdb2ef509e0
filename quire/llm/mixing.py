"""Mixing sources to target weights with soft domain membership.

A classifier trained on a labelled table gives every document a posterior over domains. The rates r of
the documents, at least 0, then minimise

    sum over domains k of (sum over documents d of tokens_d * r_d * posterior_dk - target_k)**2

by projected gradient from r = 1, in the metric that weighs a document by its tokens. In that metric the
step of a document is its posterior times one vector of the domains, so a document's rate follows from
the vectors so far: an iteration is one pass that sums a number per domain and per pair of domains, and
neither rates nor documents are ever gathered.

The vector is the gradient, scaled by the curvature between the domains, as long as that halves the error;
then the plain gradient over the greatest curvature, with momentum. The fit ends when every domain is at
its target, or when steps bring little more: the targets are out of reach then, and what is missing is
reported. A fit that does neither is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stages, blocks, frugal, list_array
from .quality import N_FEATURES, passages
from .words import Words

BITS = 18
#: Where a fit ends: at this share of all tokens off any target, or when so many steps lower the squared error by less than this share of it.
TOLERANCE, STEPS, GAIN = 1e-5, 8, 0.1
#: Passes after which a fit that has not ended is an error.
PASSES = 200


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each text: mean passage features, the hashed words it holds, and its number of words."""
    with np.errstate(over="ignore"):
        w = Words(offsets, data)
    x, first = passages(offsets, data)
    dense = np.add.reduceat(x, first[:-1]) / np.diff(first)[:, None]
    bucket = (w.hash >> np.uint64(64 - BITS)).astype(np.int32)
    bags = [np.unique(bucket[a:b]) for a, b in zip(w.first_word[:-1], w.first_word[1:])]
    return dense, bags, w.n_words


class DomainClassifier:
    """Softmax over dense passage features and hashed words, trained with adaptive steps."""

    def __init__(self, domains: list[str]):
        k = len(domains)
        self.domains = domains
        self.words = np.zeros((1 << BITS, k), np.float32)
        self.dense, self.bias = np.zeros((N_FEATURES, k), np.float32), np.zeros(k, np.float32)
        self.centre, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def posterior(self, dense: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(b) for b in bags])
        z = np.clip((dense - self.centre) / self.scale, -6, 6) @ self.dense + self.bias
        if n.sum():
            some = n > 0
            z[some] += np.add.reduceat(self.words[np.concatenate(bags)], (np.cumsum(n) - n)[some])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, dense: np.ndarray, bags: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.2, seed: int = 19) -> DomainClassifier:
        rng = np.random.default_rng(seed)
        self.centre, self.scale = dense.mean(axis=0), dense.std(axis=0) + 0.02
        seen_w, seen_d = np.full(len(self.words), 1e-3, np.float32), np.full(N_FEATURES, 1e-3, np.float32)
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                part = [bags[k] for k in own]
                g = self.posterior(dense[own], part)
                g[np.arange(len(own)), y[own]] -= 1
                g /= len(own)
                x = np.clip((dense[own] - self.centre) / self.scale, -6, 6)
                gd = x.T @ g
                seen_d += (gd**2).mean(axis=1)
                self.dense -= (rate / np.sqrt(seen_d))[:, None] * gd
                self.bias -= rate * g.sum(axis=0)
                n = np.array([len(b) for b in part])
                rows, inverse = np.unique(np.concatenate(part), return_inverse=True)
                each = np.repeat(g, n, axis=0)
                gw = np.stack([np.bincount(inverse, each[:, k], len(rows)) for k in range(g.shape[1])], axis=1) if len(rows) else np.zeros((0, g.shape[1]))
                seen_w[rows] += (gw**2).mean(axis=1)
                self.words[rows] -= (0.3 * rate / np.sqrt(seen_w[rows]))[:, None] * gw
        return self


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, offsets, data in blocks(batch.column(1)):
            dense, bags, _ = _features(offsets, data)
            starts = np.cumsum([0, *(len(b) for b in bags)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), list_array(dense.astype(np.float32).reshape(-1), np.arange(hi - lo + 1) * N_FEATURES, pa.float32()), list_array(np.concatenate(bags), starts, pa.int32())], names=["doc_id", "domain", "dense", "words"])


def train_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = 4000) -> DomainClassifier:
    """Fits the classifier to at most ``most`` labelled documents, chosen by a hash of the id.

    ``labelled`` has doc_id and domain; other domains than ``domains`` are left out, and an id with several
    domains has the first of them. An id that occurs with several texts teaches with each of them. Without
    any such document all posteriors are equal. The driver holds the distinct words of the sample's texts,
    as places in a table of 2^18: at most 1 MB a document, however long it is.
    """
    chosen = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("domain").isin(domains)).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = docs.distinct().mapInArrow(frugal(_sampled), "doc_id long, domain string, dense array<float>, words array<int>").withColumn("n", F.size("words")).toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending")])
    model = DomainClassifier(domains)
    if got.num_rows:
        dense = np.stack([np.asarray(x.values) for x in got.column("dense")])
        bags = [np.asarray(x.values) for x in got.column("words")]
        model.fit(dense, bags, np.array([domains.index(x) for x in got.column("domain").to_pylist()]))
    return model


def _posteriors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.domains)
        for batch in batches:
            for lo, hi, offsets, data in blocks(batch.column(1)):
                dense, bags, n = _features(offsets, data)
                p = model.posterior(dense, bags)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), list_array(p.astype(np.float64).reshape(-1), np.arange(hi - lo + 1) * k, pa.float64())], names=["doc_id", "n_tokens", "posterior"])

    return run


#: A vector of the domains and how much of the step before is carried on.
Move = tuple[np.ndarray, float]


def rates(p: np.ndarray, moves: list[Move]) -> np.ndarray:
    """Rates after all moves so far."""
    r = last = np.ones(len(p))
    for m, momentum in moves:
        r, last = np.maximum(0, r + momentum * (r - last) - p @ m), r
    return r


def _flat(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)


def _totals(moves: list[Move], k: int):
    """Tokens of each domain at the rates after all moves, and of each pair of domains where rates are above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            n, p = batch.column(0).to_numpy().astype(np.float64), _flat(batch.column(1), k)
            r = rates(p, moves)
            total += (n * r) @ p
            free = p[r > 0]
            pairs += (n[r > 0, None] * free).T @ free
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k, dtype=np.int32)), pa.array([*total, *pairs.reshape(-1)])], names=["k", "v"])

    return run


@dataclass
class Fit:
    """Moves whose rates come nearest the goal (tokens of each domain), the tokens they give, and the passes taken."""

    moves: list[Move]
    goal: np.ndarray
    reached: np.ndarray
    passes: int

    @property
    def residual(self) -> float:
        """The largest distance to a target, as a share of all wanted tokens."""
        return float(np.abs(self.reached - self.goal).max() / self.goal.sum()) if self.goal.sum() else 0.0


def fit_rates(soft: DataFrame, weights: np.ndarray, budget: float = 1.0) -> Fit:
    """Fits rates to (n_tokens, posterior): see the head of this file. Each pass gathers k + k * k numbers."""
    k = len(weights)
    small, passes = soft.select("n_tokens", "posterior"), 0

    def look(moves: list[Move]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        if passes > PASSES:
            raise RuntimeError(f"rates did not settle in {PASSES} passes")
        got = {r[0]: r[1] for r in small.mapInArrow(frugal(_totals(moves, k)), "k int, v double").groupBy("k").agg(F.sum("v")).collect()}
        flat = np.array([got.get(i, 0.0) for i in range(k + k * k)])
        return flat[:k], flat[k:].reshape(k, k)

    moves: list[Move] = []
    now, pairs = look(moves)
    total = float(now.sum())
    goal = weights / weights.sum() * total * budget
    if not total:
        return Fit(moves, goal, now, passes)
    steepest = float(np.linalg.eigvalsh(pairs)[-1]) / total
    error = lambda x: float((((x - goal) / total) ** 2).sum())
    settled = lambda: float(np.abs(now - goal).max()) < TOLERANCE * total
    while not settled():
        scaled = np.linalg.solve(pairs + 1e-9 * steepest * total * np.eye(k), now - goal)
        found, curve = look([*moves, (scaled, 0.0)])
        if error(found) > 0.5 * error(now):
            break
        moves, now, pairs = [*moves, (scaled, 0.0)], found, curve
    last, age, errors = now, 1.0, [error(now)]
    while not settled():
        older = age
        age = (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = float((older - 1) / age)
        step = ((now - goal + momentum * (now - last)) / total / steepest, momentum)  # totals are linear in rates
        found, _ = look([*moves, step])
        if error(found) > errors[-1] and momentum:
            age = 1.0  # momentum went too far: begin anew from here
            last = now
            continue
        moves, now, last = [*moves, step], found, now
        errors.append(error(now))
        if len(errors) > STEPS and errors[-1] > (1 - GAIN) * errors[-1 - STEPS]:
            break
    return Fit(moves, goal, now, passes)


def _rated(moves: list[Move], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_flat(batch.column(2), k), moves))], names=["doc_id", "n_tokens", "posterior", "rate"])

    return run


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, id_column: str = "doc_id", text_column: str = "text", most: int = 4000) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies, residual): how often each document should be seen.

    ``targets`` are weights of domains; they are scaled to ``budget`` times the tokens there are. ``copies``
    is the rate with its fraction settled by a hash of the id, so it is the same on every run. Tokens
    are words between blanks. Null and empty texts have no tokens, get their posterior from empty
    features and a rate all the same; texts of any length are read whole. Where targets can't be reached,
    the nearest totals are; ``residual``, the same in all rows, is the largest distance to a target as a
    share of all wanted tokens. An empty table gives no rows. Repeated rows each get their rate, and so do
    the texts of one id and null ids; other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "mixing")
    domains, k = sorted(targets), len(targets)
    shared = spark.sparkContext.broadcast(train_domains(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), labelled, domains, most))
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    soft = stages.put(docs.mapInArrow(frugal(_posteriors(shared)), "doc_id long, n_tokens long, posterior array<double>"), "posteriors")
    fit = fit_rates(soft, np.array([targets[d] for d in domains], float), budget)
    out = soft.mapInArrow(frugal(_rated(fit.moves, k)), "doc_id long, n_tokens long, posterior array<double>, rate double")
    part = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out = out.withColumn("copies", (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
    return out.withColumn("residual", F.lit(fit.residual))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains from quality and toxicity labels: junk, toxic or clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


#: Domain weights of op2 and the pipeline, and tokens wanted for each token there is.
TARGETS, BUDGET = {"clean": 0.97, "toxic": 0.03, "junk": 0.0}, 1.25
