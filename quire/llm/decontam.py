"""Benchmark decontamination with an FM-index over every training shard.

A shard is a run of documents of one partition. Only words that occur in the benchmark can take part
in a match, so the index holds the runs of such words that are at least as long as the shortest
window; everything else becomes a separator. That loses no occurrence. The index is a
Burrows-Wheeler transform with a wavelet matrix for ranks and every ``SAMPLE``-th suffix position.
All windows are searched backwards at once, occurrences are located by walking to a sampled
position, and overlapping ones merge to removal spans.

The benchmark goes to the executors in blocks of bounded size, one pass over a document row for
each block; its rows are never joined with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stages, blocks, frugal
from .words import NOT_ALNUM, Words, mix

SAMPLE = 16
#: Text bytes and indexed words of one shard, at most (a longer document is a shard of its own).
SHARD_BYTES, SHARD_WORDS = 16 << 20, 1 << 20
#: Characters of the benchmark in one block.
BLOCK_CHARS = 8 << 20
SPAN = "array<struct<w0:int,w1:int,b0:int,b1:int>>"


class WaveletMatrix:
    """rank(symbol, i) over an array of small integers, for many queries at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes on the way down the path of symbol."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][i]
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.below(symbol, i) - self.below(symbol, np.zeros_like(i))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the last symbol must be the only smallest one."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, k = new, 2 * k
        if rank.max() == n - 1 or k >= n:
            return order


class FMIndex:
    """text: symbols from 1; 0 is appended as its end."""

    def __init__(self, text: np.ndarray, top: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, top)
        marked = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.sampled = marked, order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half-open row ranges of all patterns (one per row, equally long)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            symbol = c[live]
            start = self.first[symbol]
            lo[live] = start + self.tree.rank(symbol, lo[live])
            hi[live] = start + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, at most SAMPLE steps each."""
        out = np.empty(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        step = 0
        while len(live):
            there = self.marked[at]
            out[live[there]] = self.sampled[self.marks[at[there]]] + step
            live, at = live[~there], at[~there]
            symbol = self.bwt[at]
            at = self.first[symbol] + self.tree.rank(symbol, at)
            step += 1
        return out


@dataclass
class Windows:
    """Distinct windows of one block of the benchmark, by length, as symbols from 2; 1 separates."""

    vocab: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # patterns, first item, items
    shortest: int

    @classmethod
    def of(cls, ids: list[str], texts: list[str | None], n: int) -> Windows:
        found: dict[bytes, set[str]] = {}
        per_item = []
        for lo, hi, offsets, data in blocks(pa.array(texts, pa.string())):
            with np.errstate(over="ignore"):
                w = Words(offsets, data, NOT_ALNUM)
            per_item += [w.hash[w.first_word[d] : w.first_word[d + 1]] for d in range(hi - lo)]
        for item, h in zip(ids, per_item):
            for i in range(max(1, len(h) - n + 1) if len(h) else 0):
                found.setdefault(h[i : i + n].tobytes(), set()).add(item)
        vocab = np.unique(np.concatenate(per_item)) if per_item else np.zeros(0, np.uint64)
        lengths: dict[int, list[tuple[bytes, list[str]]]] = {}
        for key, items in found.items():
            lengths.setdefault(len(key) // 8, []).append((key, sorted(items)))
        by_length = {}
        for length, rows in lengths.items():
            patterns = np.searchsorted(vocab, np.frombuffer(b"".join(k for k, _ in rows), np.uint64).reshape(-1, length)) + 2
            by_length[length] = (patterns, np.cumsum([0, *(len(x) for _, x in rows)]), np.array([y for _, x in rows for y in x], object))
        return cls(vocab, by_length, min(by_length, default=n))


class _Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(windows.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        self.parts, self.n_words, self.rows, self.docs, self.bytes, self.indexed = [], [], [], 0, 0, 0

    def add(self, rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            w = Words(offsets, data, NOT_ALNUM)
        known = self.maybe[(w.hash & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(known)
        symbol = np.searchsorted(self.w.vocab, w.hash[at])
        symbol[symbol == len(self.w.vocab)] = 0
        true = self.w.vocab[symbol] == w.hash[at] if len(self.w.vocab) else np.zeros(len(at), bool)
        at, symbol = at[true], symbol[true] + 2
        if len(at):
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
            run = np.cumsum(head) - 1
            long = np.bincount(run)[run] >= self.w.shortest
            at, symbol, head = at[long], symbol[long], head[long]
            self.parts.append((symbol, head, w.doc[at] + self.docs, at - w.first_word[w.doc[at]], w.start[at] - offsets[w.doc[at]], w.end[at] - offsets[w.doc[at]]))
            self.indexed += len(at)
        self.n_words.append(w.n_words)
        self.rows.append(rows)
        self.docs += len(rows)
        self.bytes += len(data)

    def hits(self) -> tuple[list[list[tuple[int, int, int, int]]], list[list[str]]]:
        spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(self.docs)]
        items: list[set[str]] = [set() for _ in range(self.docs)]
        if not self.indexed:
            return spans, [[] for _ in items]
        symbol, head, doc, place, b0, b1 = (np.concatenate(x) for x in zip(*self.parts))
        place_in = np.arange(len(symbol)) + np.cumsum(head)  # a separator stands before every run
        text = np.ones(len(symbol) + int(head.sum()), np.int64)
        text[place_in] = symbol
        back = np.full(len(text), -1)
        back[place_in] = np.arange(len(symbol))
        index = FMIndex(text, len(self.w.vocab) + 2)
        edge = np.zeros(len(symbol) + 1, np.int64)
        for length, (patterns, first, names) in self.w.by_length.items():
            lo, hi = index.search(patterns)
            n = hi - lo
            if not n.sum():
                continue
            rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = back[index.locate(rows)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            pair = np.unique(np.stack([doc[at], np.repeat(np.arange(len(n)), n)]), axis=1)
            for d, p in pair.T:
                items[d].update(names[first[p] : first[p + 1]])
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if len(hit):
            cut = np.ones(len(hit), bool)
            cut[1:] = (hit[1:] != hit[:-1] + 1) | (doc[hit[1:]] != doc[hit[:-1]]) | head[hit[1:]]
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(hit)) - 1
            for s, e in zip(hit[starts], hit[ends]):
                spans[doc[s]].append((int(place[s]), int(place[e]) + 1, int(b0[s]), int(b1[e])))
        return spans, [sorted(x) for x in items]


def _merge(a: list, b: list) -> list:
    out: list = []
    for s in sorted([*a, *b]):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


SPAN_TYPE = pa.list_(pa.struct([(x, pa.int32()) for x in ("w0", "w1", "b0", "b1")]))


def _search(windows, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(windows.value)

        def flush():
            spans, items = shard.hits()
            lo = 0
            for rows, n in zip(shard.rows, shard.n_words):
                hi = lo + len(rows)
                old_s, old_i = rows.column(2).to_pylist(), rows.column(3).to_pylist()
                s = [_merge([tuple(y.values()) for y in x or []], z) for x, z in zip(old_s, spans[lo:hi])]
                i = [sorted({*(x or []), *z}) for x, z in zip(old_i, items[lo:hi])]
                text = pa.array([_cut(x, y) for x, y in zip(rows.column(1).to_pylist(), s)], pa.string()) if cut else rows.column(1)
                yield pa.RecordBatch.from_arrays([rows.column(0), text, pa.array([[dict(zip(("w0", "w1", "b0", "b1"), y)) for y in x] for x in s], SPAN_TYPE), pa.array(i, pa.list_(pa.string())), pa.array(n, pa.int64())], names=["row", "text", "spans", "items", "n_words"])
                lo = hi
            shard.clear()

        for batch in batches:
            for lo, hi, offsets, data in blocks(batch.column(1)):
                shard.add(batch.slice(lo, hi - lo), offsets, data)
                if shard.bytes >= SHARD_BYTES or shard.indexed >= SHARD_WORDS:
                    yield from flush()
        if shard.docs:
            yield from flush()

    return run


def _cut(text: str | None, spans: list[tuple[int, int, int, int]]) -> str | None:
    """A text without the bytes of its spans."""
    if not spans:
        return text
    raw, at, kept = text.encode(), 0, []
    for _, _, b0, b1 in spans:
        kept.append(raw[at:b0])
        at = b1
    return b"".join([*kept, raw[at:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", n: int = 10, cut: bool = False) -> DataFrame:
    """(row, text, spans, items, n_words): the source row without its text, the text, hit spans and items found.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. A window is ``n`` consecutive
    words of an item, or all of a shorter item. ``spans`` holds merged hits as word and byte ranges;
    with ``cut`` they are taken out of ``text``. Null and empty texts have no words and no hits, an
    item without words never matches, a null item id counts as the empty string, equal items count once,
    items of one id with several texts have the windows of all of them, repeated rows each have their
    hits, an empty benchmark hits nothing and an empty table gives no rows. A very long text is a shard of
    its own and searched whole. ``row`` keeps the other source columns apart, so no name can clash.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS) or 1
    row = F.struct(*([c for c in docs.columns if c != text_column] or [F.lit(None).cast("string").alias("none")]))
    schema = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    out = docs.select(row.alias("row"), F.col(text_column).cast("string").alias("text"), F.lit(None).cast(SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    kind = f"row {schema}, text string, spans {SPAN}, items array<string>, n_words long"
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()
        windows = spark.sparkContext.broadcast(Windows.of([r[0] for r in rows], [r[1] for r in rows], n))
        out = out.select("row", "text", "spans", "items").mapInArrow(frugal(_search(windows, cut and k == n_blocks - 1)), kind)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", stages: Stages | None = None, **settings) -> DataFrame:
    """The rows of contamination() with all hits cut out of their texts, until no window is left.

    A cut joins the words before and after it, which can make a window anew, so the texts that were cut are
    searched again until nothing more is found; every pass takes words away, so there is an end. ``spans`` and
    ``items`` are those of the last pass over a row, empty ones then.
    """
    stages = stages or Stages(docs.sparkSession, "decontam")
    found = stages.put(contamination(docs, benchmark, text_column, cut=True, **settings), "cut")
    clean, left = [found.where(F.size("spans") == 0)], found.where(F.size("spans") > 0)
    while not left.isEmpty():
        names = [c for c in docs.columns if c != text_column]
        again = left.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("text").alias(text_column))
        found = stages.put(contamination(again, benchmark, text_column, cut=True, **settings), "cut")
        clean, left = [*clean, found.where(F.size("spans") == 0)], found.where(F.size("spans") > 0)
    return reduce(DataFrame.unionByName, clean)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["w1"] - s["w0"]))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
