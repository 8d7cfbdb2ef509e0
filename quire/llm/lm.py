"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

    P(w | h) = P(class(w) | h) * P(first branch | class, h) * P(next branch | node, h) * ...

Every word has a path. The most frequent training tokens (at most ``FREQUENT``, so that their counts fit on
every executor) lie in 24 classes by frequency, as leaves of trees of 32 branches, one to three levels
deep. Every other word, known or not, lies in one of 16 classes by its last bytes and below that in one of
32 * 32 leaves by its hash, where its probability is its smoothed count. Each class and each node is a
softmax of its own; its constant part is the counts' share, and its features are the word before (an n-gram
feature), the one before that (a skip feature) and, for classes, both together. Words are features by
their rank or their hash, and features of classes and nodes are hashed into tables of fixed size, so all
words take part in both roles.

Counts come from all training texts. The weights are trained by distributed gradient updates: the texts are
dealt into ``ROUNDS`` lots by a hash, and a round sums the gradient of all tokens of its lot at the weights
so far, each step scaled by how often its feature was seen. The sums don't depend on how rows lie
in partitions or on how many cores there are, and so neither do the scores (but for rounding).

Only words outside the most frequent have to meet their counts through a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Stages, blocks, crc32_mod, frugal, list_array
from .words import Words, mix

U = np.uint64
BRANCH = 32
#: Classes by frequency (a third each of trees of one, two and three levels) and by last bytes.
CLASSES, RARE = 24, 16
SIZES = np.repeat([BRANCH, BRANCH**2, BRANCH**3], CLASSES // 3)
DEPTH = np.repeat([1, 2, 3], CLASSES // 3)
#: Words whose counts every executor holds, at most.
FREQUENT = int(SIZES.sum())
LEAVES = RARE * BRANCH * BRANCH
#: Nodes: classes, branches of classes, branches of those in the classes of three levels.
SECOND, THIRD = CLASSES + RARE, (CLASSES + RARE) * (BRANCH + 1)
NODES = THIRD + CLASSES // 3 * BRANCH * BRANCH
#: Places of a word as a feature: its own for the most frequent ones, hashed for all others, and one for a text's start.
OWN, HASHED = 2048, 2048
START = OWN + HASHED
HISTORY = START + 1
PAIRS, INNER = 8192, 8192
#: The hash of the end token; no word's hash is looked up under another name.
END = U(0x454E44)
#: Tokens that are taken at once, and of a round's task at least (what it hands on is as large as all weights).
STEP, TASK = 1 << 14, 1 << 19
PIECE = 1 << 15
#: No weight goes further than this, so that the exponential of a sum of them fits.
FURTHEST = 20.0
ROUNDS, RATE, PRIOR = 4, 0.4, 6.0


def rare_class(w: Words) -> np.ndarray:
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 5 + before * 13) % RARE


def rare_leaf(rare: np.ndarray, h: np.ndarray) -> np.ndarray:
    return rare * BRANCH**2 + (h & U(BRANCH**2 - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, r): words and their counts, summed over about 16 MB of text before they are handed on."""
    held, size = [], 0

    def out():
        h, c, r = (np.concatenate(x) for x in zip(*held))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(inverse, c, len(distinct)).astype(np.int64)), pa.array(r[first].astype(np.int32))], names=["h", "c", "r"])

    for batch in batches:
        for lo, hi, offsets, data in blocks(batch.column(0)):
            with np.errstate(over="ignore"):
                w = Words(offsets, data)
            distinct, first, c = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((distinct, c, rare_class(w)[first]))
            held.append((np.array([END]), np.array([hi - lo]), np.array([0])))
            size += len(data)
            if size >= 16 << 20:
                yield out()
                held, size = [], 0
    if held:
        yield out()


@dataclass
class Vocabulary:
    """What the counts of the training texts say, in bounded size."""

    hash: np.ndarray  # of frequent words, sorted
    count: np.ndarray
    rank: np.ndarray
    n: int
    v: int
    leaf_log: np.ndarray  # log10(N + V + 1) of the leaves of other words
    class_log: np.ndarray  # natural logs of the classes' shares
    node_log: np.ndarray  # and of the branches' in their node

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        # A power of 2 in sixteenths bounds the number of rows here.
        bucket = F.floor(F.log2("c") * 16).cast("int")
        sizes = sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
        least, total = None, 0
        for b, n in sizes:
            total += n
            if total > FREQUENT:
                break
            least = b
        often = bucket >= least if least is not None else F.lit(False)
        got = counts.where(often).select("h", "c").toPandas()
        h, c = got["h"].to_numpy(np.int64).view(U), got["c"].to_numpy(np.int64)
        leaf = F.col("r") * BRANCH**2 + F.col("h").bitwiseAND(BRANCH**2 - 1)
        rest = counts.where(~often).groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
        n_leaf, v_leaf = np.zeros(LEAVES), np.zeros(LEAVES)
        n_leaf[rest["leaf"].to_numpy(np.int64)], v_leaf[rest["leaf"].to_numpy(np.int64)] = rest["n"], rest["v"]
        return cls.build(h, c, n_leaf, v_leaf)

    @classmethod
    def build(cls, h: np.ndarray, c: np.ndarray, n_leaf: np.ndarray, v_leaf: np.ndarray) -> Vocabulary:
        order = np.lexsort((h, -c))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        mass = np.zeros((NODES, BRANCH))
        classes = np.zeros(CLASSES + RARE)
        klass, nodes, branches = frequent_paths(np.arange(len(h)))
        for level in range(3):
            here = np.flatnonzero(nodes[level] >= 0)
            np.add.at(mass, (nodes[level][here], branches[level][here]), c[order][here] + 1.0)
        classes += np.bincount(klass, c[order] + 1.0, len(classes))
        smooth = (n_leaf + v_leaf + 1).reshape(RARE, BRANCH, BRANCH)
        classes[CLASSES:] += smooth.sum(axis=(1, 2))
        mass[CLASSES:SECOND] += smooth.sum(axis=2)
        mass[SECOND + CLASSES * BRANCH : THIRD] += smooth.reshape(-1, BRANCH)
        empty = classes == 0
        classes[empty] = 1e-3
        mass += 1e-3 * (mass == 0)
        by = np.argsort(h)
        return cls(h[by], c[by], rank[by], int(c.sum() + n_leaf.sum()), int(len(h) + v_leaf.sum()), np.log10(n_leaf + v_leaf + 1), np.log(classes / classes.sum()).astype(np.float32), np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32))


def frequent_paths(rank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Classes of words by rank, and the nodes (-1 below a leaf) and branches of their paths."""
    ends = np.cumsum(SIZES)
    klass = np.searchsorted(ends, rank, "right")
    depth = DEPTH[klass]
    place = (rank - (ends - SIZES)[klass]) * BRANCH ** (3 - depth)  # as in a tree of three levels
    one, two, three = place // BRANCH**2, place // BRANCH % BRANCH, place % BRANCH
    second = np.where(depth > 1, SECOND + klass * BRANCH + one, -1)
    third = np.where(depth > 2, THIRD + ((klass - CLASSES // 3 * 2) * BRANCH + one) * BRANCH + two, -1)
    return klass, [klass, second, third], [one, two, three]


class Tokens:
    """Tokens of a block in text order, an end after each text: paths and histories."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, vocab: Vocabulary):
        with np.errstate(over="ignore"):
            w = Words(offsets, data)
        n = w.n_words + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(w.hash)) + w.doc
        self.hash = np.full(self.first[-1], END, U)
        self.hash[place] = w.hash
        rare = np.zeros(self.first[-1], np.int64)
        rare[place] = rare_class(w) if len(w.hash) else 0
        if len(vocab.hash):
            at = np.minimum(np.searchsorted(vocab.hash, self.hash), len(vocab.hash) - 1)
            self.frequent = vocab.hash[at] == self.hash
            self.count = np.where(self.frequent, vocab.count[at], 0)
            rank = vocab.rank[at]
        else:
            self.frequent, self.count, rank = np.zeros(len(self.hash), bool), np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash), np.int64)
        self.leaf = rare_leaf(rare, self.hash)
        klass, nodes, branches = frequent_paths(np.where(self.frequent, rank, 0))
        other = ~self.frequent
        one, two = self.leaf // BRANCH % BRANCH, self.leaf % BRANCH
        self.klass = np.where(other, CLASSES + rare, klass)
        nodes = [np.where(other, x, y) for x, y in zip((CLASSES + rare, SECOND + (CLASSES + rare) * BRANCH + one, -1), nodes)]
        branches = [np.where(other, x, y) for x, y in zip((one, two, 0), branches)]
        # Every step down a tree: its token, node and branch.
        self.token = np.concatenate([np.flatnonzero(x >= 0) for x in nodes])
        self.node = np.concatenate([x[x >= 0] for x in nodes])
        self.branch = np.concatenate([b[x >= 0] for x, b in zip(nodes, branches)])
        with np.errstate(over="ignore"):
            number = np.where(self.frequent & (rank < OWN), rank, OWN + (mix(self.hash) % U(HASHED)).astype(np.int64))
        back = np.arange(len(number)) - self.first[self.doc]
        self.prev = np.full(len(number), START)
        self.prev[1:] = number[:-1]
        self.prev[back < 1] = START
        self.skip = np.full(len(number), START)
        self.skip[2:] = number[:-2]
        self.skip[back < 2] = START

    def class_rows(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        prev, skip = self.prev[lo:hi], self.skip[lo:hi]
        return prev, HISTORY + skip, 2 * HISTORY + (prev * 4099 + skip * 7919) % PAIRS

    def node_rows(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        node, token = self.node[lo:hi], self.token[lo:hi]
        return (node * 1361 + self.prev[token] * 2654435761) % INNER, INNER + (node * 1847 + self.skip[token] * 2246822519) % INNER


def add_rows(z: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    z += np.take(table, rows, axis=0, mode="clip")


def exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of sums of weights and logs, which all fit, and their sums by row."""
    e = np.exp(z)
    return e, np.einsum("ij->i", e)


class MaxEnt:
    """Weights of the features of classes and of nodes."""

    CLASS, NODE = (2 * HISTORY + PAIRS, CLASSES + RARE), (2 * INNER, BRANCH)

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.class_w, self.node_w = np.zeros(self.CLASS, np.float32), np.zeros(self.NODE, np.float32)

    def classes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        """Natural logs of the weights of all classes, up to a constant of each row, for some histories."""
        z = np.take(self.class_w, rows[0], axis=0, mode="clip")
        for x in rows[1:]:
            add_rows(z, self.class_w, x)
        z += self.vocab.class_log
        return z

    def nodes(self, rows: tuple[np.ndarray, ...], node: np.ndarray) -> np.ndarray:
        """And of all branches of some nodes."""
        z = np.take(self.vocab.node_log, node, axis=0, mode="clip")
        for x in rows:
            add_rows(z, self.node_w, x)
        return z

    def score(self, t: Tokens) -> np.ndarray:
        """Natural log of the probability of each token's path."""
        out = np.empty(len(t.hash))
        for lo in range(0, len(out), STEP):
            hi = min(len(out), lo + STEP)
            z = self.classes(t.class_rows(lo, hi))
            out[lo:hi] = z[np.arange(hi - lo), t.klass[lo:hi]] - np.log(exp_sums(z)[1])
        down = np.empty(len(t.token))
        for lo in range(0, len(down), STEP):
            hi = min(len(down), lo + STEP)
            z = self.nodes(t.node_rows(lo, hi), t.node[lo:hi])
            down[lo:hi] = z[np.arange(hi - lo), t.branch[lo:hi]] - np.log(exp_sums(z)[1])
        return out + np.bincount(t.token, down, len(out))


class Gradient:
    """Sums over tokens: what the model expects less what is there, and what it expects, of all weights.

    A row of these tables is a class or branch, a column a feature: the weights' tables lie the other way.
    """

    #: Where the columns of each feature of a class begin, and how many there are.
    PARTS = ((0, HISTORY), (HISTORY, HISTORY), (2 * HISTORY, PAIRS))
    SIZES = (MaxEnt.CLASS[0] * MaxEnt.CLASS[1], MaxEnt.CLASS[0], MaxEnt.NODE[0] * MaxEnt.NODE[1], MaxEnt.NODE[0] * MaxEnt.NODE[1])

    def __init__(self):
        self.class_g, self.class_n = np.zeros(MaxEnt.CLASS[::-1]), np.zeros(MaxEnt.CLASS[0])
        self.node_g, self.node_e = np.zeros(MaxEnt.NODE[::-1]), np.zeros(MaxEnt.NODE[::-1])
        self.tokens = 0

    @staticmethod
    def _scatter(total: np.ndarray, rows: np.ndarray, first: int, count: int, g: np.ndarray) -> None:
        rows = rows - first
        for k, values in enumerate(g):
            total[k, first : first + count] += np.bincount(rows, values, count)

    def add(self, model: MaxEnt, t: Tokens) -> None:
        self.tokens += len(t.hash)
        for lo in range(0, len(t.hash), STEP):
            hi = min(len(t.hash), lo + STEP)
            rows = t.class_rows(lo, hi)
            e, total = exp_sums(model.classes(rows))
            g = np.ascontiguousarray((e / total[:, None]).T)
            g[t.klass[lo:hi], np.arange(hi - lo)] -= 1
            for x, (first, count) in zip(rows, self.PARTS):
                self._scatter(self.class_g, x, first, count, g)
                self.class_n[first : first + count] += np.bincount(x - first, minlength=count)
        for lo in range(0, len(t.token), STEP):
            hi = min(len(t.token), lo + STEP)
            rows, branch = t.node_rows(lo, hi), t.branch[lo:hi]
            e, total = exp_sums(model.nodes(rows, t.node[lo:hi]))
            g = np.ascontiguousarray((e / total[:, None]).T)
            for k, x in enumerate(rows):
                self._scatter(self.node_e, x, k * INNER, INNER, g)
                np.subtract.at(self.node_g.reshape(-1), branch * (2 * INNER) + x, 1.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.class_g, self.class_n, self.node_g + self.node_e, self.node_e)])

    @classmethod
    def step(cls, model: MaxEnt, flat: np.ndarray, rate: float) -> None:
        """One update of all weights. A step is the gradient over the feature's own expectation, on a log scale,
        so that rare features learn as fast as common ones and none leaps."""
        class_g, class_n, node_g, node_e = np.split(flat, np.cumsum(cls.SIZES)[:-1])
        expect = np.exp(model.vocab.class_log.astype(np.float64))[:, None] * class_n + PRIOR
        for w, g, e in ((model.class_w, class_g.reshape(MaxEnt.CLASS[::-1]), expect), (model.node_w, node_g.reshape(MaxEnt.NODE[::-1]), node_e.reshape(MaxEnt.NODE[::-1]) + PRIOR)):
            w -= (rate * np.sign(g) * np.log1p(np.abs(g) / e)).T.astype(np.float32)
            np.clip(w, -FURTHEST, FURTHEST, out=w)


def _gradients(shared, groups: int):
    """(piece, part, total): a partition's sums, cut into pieces; partitions are dealt into groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, class_w, node_w = shared.value
        model = MaxEnt(vocab)
        model.class_w, model.node_w = class_w, node_w
        sums = Gradient()
        for batch in batches:
            for _, _, offsets, data in blocks(batch.column(0)):
                sums.add(model, Tokens(offsets, data, vocab))
        if sums.tokens:
            flat = sums.flat().astype(np.float32)
            pieces = [flat[a : a + PIECE].tobytes() for a in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(np.full(len(pieces), TaskContext.get().partitionId() % groups, np.int32)), pa.array(pieces, pa.binary())], names=["piece", "part", "total"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal pieces of a partition; it holds one sum for each, however many rows come."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, x in zip(batch.column(0).to_pylist(), batch.column(2)):
            own = np.frombuffer(x.as_buffer(), np.float32)
            totals[piece] = totals[piece] + own if piece in totals else own.astype(np.float64)
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([0] * len(totals), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in totals.values()], pa.binary())], names=["piece", "part", "total"])


KIND = "piece int, part int, total binary"


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> MaxEnt:
    """The trained model. Each round goes over its lot of the texts, and all texts are in one; the weights have a
    fixed size (5 MB), and so has what a task hands on (7 MB). Tasks' sums are added up in two steps. Small
    partitions are read together, up to ``TASK`` tokens, so that sums are not more than texts; sums are the same."""
    spark = texts.sparkSession
    tasks = max(1, -(-vocab.n // (rounds * TASK)))
    groups = math.isqrt(tasks) + 1  # each of them about as large as there are groups
    model = MaxEnt(vocab)
    lot = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, model.class_w, model.node_w))
        rows = texts.where(lot == k).coalesce(tasks).mapInArrow(frugal(_gradients(shared, groups)), KIND)
        rows = rows.repartition("piece", "part").mapInArrow(frugal(_summed), KIND).repartition("piece").mapInArrow(frugal(_summed), KIND)
        got = sorted((r.piece, bytes(r.total)) for r in rows.collect())
        shared.unpersist()
        if got:
            Gradient.step(model, np.frombuffer(b"".join(x for _, x in got), np.float32).astype(np.float64), rate)
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocab = model.vocab
        part, row = TaskContext.get().partitionId(), 0
        total = np.log10(vocab.n + vocab.v + 1)
        for batch in batches:
            for lo, hi, offsets, data in blocks(batch.column(1)):
                t = Tokens(offsets, data, vocab)
                n_docs = hi - lo
                own = np.log10(t.count + 1.0)
                base = np.bincount(t.doc, own, n_docs) - np.diff(t.first) * total
                by = model.score(t) / np.log(10) - np.where(t.frequent, 0, vocab.leaf_log[t.leaf])
                score = np.bincount(t.doc, by, n_docs) if vocab.n else base
                rest = np.flatnonzero(~t.frequent)
                order = rest[np.lexsort((t.hash[rest], t.doc[rest]))]
                h, d = t.hash[order], t.doc[order]
                head = np.ones(len(order), bool)
                head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(head)
                count = np.diff(np.append(at, len(order)))
                starts = np.searchsorted(d[at], np.arange(n_docs + 1))
                uid = (np.int64(part) << 33) + row + np.arange(n_docs)
                row += n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), batch.column(0).slice(lo, n_docs), pa.array(np.diff(t.first)), pa.array(np.bincount(t.doc, t.count > 0, n_docs).astype(np.int64)), pa.array(base), pa.array(score), list_array(h[at].view(np.int64), starts, pa.int64()), list_array(count.astype(np.int32), starts, pa.int32())],
                    names=["uid", "doc_id", "n_tokens", "n_known", "base", "score", "h", "n"],
                )

    return run


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 7, held_out: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, in log10.

    Training texts are those whose crc32(id) mod ``folds`` is not ``held_out``. Words are
    [^\\x20\\x09-\\x0D]+ after A-Z became a-z, and one end follows every text. Null and empty texts are the end
    alone. Repeated rows each count and each get a score; a null id counts as empty text for the folds.
    Without training texts base_score and score are 0. Texts of any length are read whole, an empty table gives
    no rows, other columns are ignored.

    The probabilities of a history add up to 1 over the frequent words, the other known words and, in every
    leaf of those, one place for all unknown words.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "lm")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    texts = docs.where(crc32_mod("doc_id", folds) != held_out).select("text")
    counts = texts.mapInArrow(frugal(_counts), "h long, c long, r int").groupBy("h").agg(F.sum("c").alias("c"), F.min("r").alias("r"))
    counts = stages.put(counts, "counts")
    vocab = Vocabulary.of(counts)
    shared = spark.sparkContext.broadcast(train(texts, vocab, rounds) if vocab.n else MaxEnt(vocab))
    kind = "uid long, doc_id long, n_tokens long, n_known long, base double, score double, h array<long>, n array<int>"
    first = stages.put(docs.mapInArrow(frugal(_scored(shared)), kind), "scored")

    rest = first.select("uid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("uid", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    rest = rest.join(counts.select("h", "c"), "h").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.sum("n").alias("known"))
    out = first.drop("h", "n").join(rest, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        (crc32_mod("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
