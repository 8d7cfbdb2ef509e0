"""Token ids in patched frame-of-reference blocks.

A shard holds whole documents in id order. Its ids are cut into blocks of 128: the block's minimum is
subtracted, the differences are packed at the width that holds ``KEEP`` of each block's values, and the
others are stored as exceptions (place, difference). Layout, little-endian:

    b"PFB1", n_ids u64, n_blocks u32
    minimum u32[n_blocks], width u8[n_blocks], n_exceptions u8[n_blocks], start u64[n_blocks + 1]
    per block: 16 * width bytes of packed values, places u8[n], differences u32[n]

``start`` is the index: block k begins at that byte of the block area, so any run of ids is read from
the blocks that hold it alone.
Shards are rows of a Parquet table, so Spark's writer places and commits them in any store.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Stages, blocks, frugal
from .words import Words

BLOCK, KEEP = 128, 0.9
#: Ids after which a shard ends (with its document).
SHARD_IDS = 1 << 20
MAGIC, HEAD = b"PFB1", struct.Struct("<4sQI")
U = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Columns of 128 values (one row for each place in a block) as rows of 16 * width bytes."""
    out = np.zeros((2 * width + 1, values.shape[1]), U)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        v = values[i].astype(U)
        out[word] |= v << U(shift)
        if shift + width > 64:
            out[word + 1] |= v >> U(64 - shift)
    return np.ascontiguousarray(out[: 2 * width].T).view(np.uint8).reshape(values.shape[1], 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(U).reshape(len(packed), 2 * width).T)
    out = np.zeros((BLOCK, len(packed)), np.uint32)
    mask = U((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        v = words[word] >> U(shift)
        if shift + width > 64:
            v |= words[word + 1] << U(64 - shift)
        out[i] = v & mask
    return out.T


def encode_ids(ids: np.ndarray) -> bytes:
    """A shard of 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    full[: len(ids)] = ids
    diff = np.ascontiguousarray(full.reshape(n, BLOCK).T)  # a row for each place: all steps run over whole rows
    low = diff.min(axis=0) if n else np.zeros(0, np.uint32)
    diff -= low
    place_kept = int(KEEP * (BLOCK - 1))
    typical = np.partition(diff, place_kept, axis=0)[place_kept] if n else low
    width = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)  # bits of the value
    over = np.zeros(diff.shape, bool)
    np.greater(diff, ((U(1) << width.astype(U)) - U(1)).astype(np.uint32), out=over)
    n_over = over.sum(axis=0)
    start = np.concatenate([[0], np.cumsum(16 * width.astype(np.int64) + 5 * n_over)])
    area = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(diff[:, rows] & np.uint32((1 << int(w)) - 1), int(w))
        area[start[rows][:, None] + np.arange(16 * int(w))] = packed
    block, place = np.nonzero(over.T)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    at = start[block] + 16 * width[block].astype(np.int64)
    area[at + nth] = place
    value = diff[place, block].astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)
    area[(at + n_over[block] + 4 * nth)[:, None] + np.arange(4)] = value
    return b"".join([HEAD.pack(MAGIC, len(ids), n), low.astype("<u4").tobytes(), width.tobytes(), n_over.astype(np.uint8).tobytes(), start.astype("<u8").tobytes(), area.tobytes()])


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a shard, or those from place ``first`` up to ``last``; only their blocks are read."""
    magic, n_ids, n = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block file")
    last = n_ids if last is None else min(last, n_ids)
    first = min(max(first, 0), last)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    at, count = HEAD.size, max(0, b1 - b0)
    low = np.frombuffer(data, "<u4", count, at + 4 * b0)
    width = np.frombuffer(data, np.uint8, count, at + 4 * n + b0)
    n_over = np.frombuffer(data, np.uint8, count, at + 5 * n + b0).astype(np.int64)
    start = np.frombuffer(data, "<u8", count + 1, at + 6 * n + 8 * b0).astype(np.int64)
    area = np.frombuffer(data, np.uint8, int(start[-1] - start[0]), at + 6 * n + 8 * (n + 1) + int(start[0]))
    start = start - start[0]
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(area[start[rows][:, None] + np.arange(16 * int(w))], int(w))
    block = np.repeat(np.arange(count), n_over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    begin = start[block] + 16 * width[block].astype(np.int64)
    place = area[begin + nth]
    value = np.ascontiguousarray(area[(begin + n_over[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[block, place] = value
    out += low[:, None]
    return out.reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


#: Bytes of ASCII letters, digits, other marks (not the apostrophe) and of letters of U+00C0 to U+00FF.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0


#: Marks that are split from a word's end: after a letter or digit they begin a piece of their own anyway.
TAILS = np.zeros(256, bool)
TAILS[[ord(c) for c in ".,;:!?"]] = True


# What a tokenizer file must say for texts to be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def by_words(config: dict) -> bool:
    """Whether a tokenizer is of the kind that WordEncoder takes apart."""
    added = config.get("added_tokens") or []
    plain = all(not x["single_word"] and not x["lstrip"] and not x["rstrip"] and not x["normalized"] and x["content"].startswith("<|") for x in added)
    model = config.get("model") or {}
    whole = model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not config.get("truncation") and not config.get("padding")
    return plain and bool(whole) and config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER


class TextEncoder:
    """Encodes whole texts: for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = data.tobytes(), offsets.tolist()
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(ends, ends[1:])], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


class WordEncoder:
    """Encodes texts word by word with a tokenizer that lowers case and never joins words across blanks.

    Ids of words seen are kept (by a 64-bit hash of the exact word), up to ``MOST`` words. New words go
    through the tokenizer many at a time, with blanks between them. Where one ends is known from its
    pieces: the pre-tokenizer cuts a word into runs of letters, single digits and runs of other marks, and
    the last id of each piece ends with the mark of a word's end. Words with anything else in them
    (apostrophes, other letters, special tokens) are encoded one by one.
    """

    MOST = 1 << 19
    TOGETHER = 100

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.hash, self.at, self.n, self.ids = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many pieces the pre-tokenizer makes of each word; 0 where that is left to it."""
        length = end - start
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(first - start, length)
        raw, kind = data[at], _KIND[data[at]]
        lead = raw == 0xC3  # U+00C0 to U+00FF but for the signs at D7 and F7
        follow = np.zeros(len(raw), bool)
        follow[1:] = lead[:-1] & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        kind[follow] = 1
        kind[:-1][follow[1:]] = 1
        cut = np.ones(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[first[length > 0]] = True
        pieces = np.add.reduceat(cut, first, dtype=np.int32)
        pieces[np.minimum.reduceat(kind, first) == 0] = 0
        return pieces

    def _lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some words: how many each has, where they begin, and all ids."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        pieces = self._pieces(data, start, end)
        marked = np.flatnonzero((pieces > 0) & (data[start] == 60))
        pieces[[k for k in marked if any(x in words[k] for x in self.special)]] = 0
        n, at, parts, held = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), [], 0

        def alone(rows):
            nonlocal held
            for k, x in zip(rows, self.tokenizer.encode_batch_fast([words[k].decode() for k in rows], add_special_tokens=False)):
                ids = np.array(x.ids, np.uint32)
                n[k], at[k] = len(ids), held
                parts.append(ids)
                held += len(ids)

        together = np.flatnonzero(pieces > 0)
        groups = [together[k : k + self.TOGETHER] for k in range(0, len(together), self.TOGETHER)]
        for rows, x in zip(groups, self.tokenizer.encode_batch_fast([b" ".join([words[k] for k in rows]).decode() for rows in groups], add_special_tokens=False)):
            ids = np.array(x.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != pieces[rows].sum():
                alone(rows)
                continue
            stop = last[np.cumsum(pieces[rows]) - 1] + 1
            n[rows] = np.diff(stop, prepend=0)
            at[rows] = held + stop - n[rows]
            parts.append(ids)
            held += len(ids)
        alone(np.flatnonzero(pieces == 0))
        return n, at, np.concatenate(parts)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a block, and how many each text has."""
        with np.errstate(over="ignore"):
            # Special tokens are told by their case, so a block that may hold one keeps it.
            w = Words(offsets, data, lower=b"<|" not in data.tobytes(), tails=TAILS)
        unique, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        n, place = np.zeros(len(unique), np.int32), np.zeros(len(unique), np.int32)
        known = np.zeros(len(unique), bool)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, unique), len(self.hash) - 1)
            known = self.hash[at] == unique
            n[known], place[known] = self.n[at[known]], self.at[at[known]]
        fresh = np.flatnonzero(~known)
        n[fresh], place[fresh], ids_new = self._lookup(data, w.start[first[fresh]], w.end[first[fresh]])
        place[fresh] += len(self.ids)
        pool = np.concatenate([self.ids, ids_new])
        if len(self.hash) + len(fresh) <= self.MOST:
            into = np.searchsorted(self.hash, unique[fresh])  # both are sorted: merged, not sorted anew
            self.hash, self.at, self.n = (np.insert(x, into, y[fresh]) for x, y in ((self.hash, unique), (self.at, place), (self.n, n)))
            self.ids = pool
        each = n[inverse]
        total = np.cumsum(each, dtype=np.int64)
        index = np.repeat((place[inverse] - total + each).astype(np.int32), each)
        index += np.arange(len(index), dtype=np.int32)
        ends = np.concatenate([[0], total])[w.first_word]
        return pool[index], np.diff(ends)


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """The worker's own encoder, kept from task to task.

    Tasks must come here for it: a function that is sent to a worker takes copies of the globals it
    names, and a copied table would be empty for every task.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = WordEncoder if by_words(json.load(file)) else TextEncoder
        _encoders[path] = kind(Tokenizer.from_file(path))
    return _encoders[path]


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        part, before, seq = TaskContext.get().partitionId(), 0, 0
        docs, sizes, ids, held = [], [], [], 0

        def shard():
            nonlocal before, seq, docs, sizes, ids, held
            flat = np.concatenate(ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([list(chain.from_iterable(docs))], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([encode_ids(flat)], pa.binary())], names=["part", "seq", "before", "n_ids", "doc_ids", "n_tokens", "payload"])
            before, seq = before + held, seq + 1
            docs, sizes, ids, held = [], [], [], 0
            return out

        for batch in batches:
            for lo, hi, offsets, data in blocks(batch.column(1), 2 << 20):
                flat, n = coder.encode(offsets, data)
                with_end = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
                stops, at, cut = np.cumsum(n), 0, 0
                every = batch.column(0).slice(lo, hi - lo).to_pylist()
                while at < hi - lo:
                    to = min(hi - lo, int(np.searchsorted(stops, cut + SHARD_IDS - held)) + 1)
                    docs.append(every[at:to])
                    sizes.append(n[at:to])
                    ids.append(with_end[cut : stops[to - 1]])
                    held += int(stops[to - 1]) - cut
                    cut, at = int(stops[to - 1]), to
                    if held >= SHARD_IDS:
                        yield shard()
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, stages: Stages | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2) -> DataFrame:
    """Writes all texts as block shards, in ascending id order over the whole table, and returns that table.

    ``part`` and ``seq`` order the shards; ``before`` counts the ids of the same part before a shard.
    Null text counts as empty, which is the end id alone; a null id comes first; rows with one id
    are ordered by their text's first 32 characters and then its hash, and equal rows each have their place. A text of any length is one document of
    one shard. An empty table gives an empty one. Other columns are ignored.

    Parts are ranges of that order, so an id that a third of all rows have is cut between parts too.
    """
    stages = stages or Stages(docs.sparkSession, "tokens")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "head", "hash", "read"]
    docs = docs.select("*", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("read"))
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stages.put(docs.mapInArrow(frugal(_write(tokenizer, end_id)), "part int, seq int, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"), "shards")


def read_window(shards: DataFrame, part: int, first: int, count: int) -> np.ndarray:
    """``count`` ids of one part from its place ``first`` on, from the shards and blocks that hold them."""
    own = shards.where((F.col("part") == part) & (F.col("before") < first + count) & (F.col("before") + F.col("n_ids") > first))
    rows = sorted((r.before, bytes(r.payload)) for r in own.select("before", "payload").collect())  # as much as was asked for
    return np.concatenate([np.zeros(0, np.uint32), *(decode_ids(data, first - before, first + count - before) for before, data in rows)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            base, docs, n, payload = (batch.column(i)[k] for i in range(4))
            ids = decode_ids(payload.as_py()).astype("<u4")
            n = np.asarray(n.values)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([docs.values, pa.array(base.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards' bytes.

    Only one sum per part goes to the driver; a part is a partition of the writer, so there are as many
    as that job had tasks.
    """
    spark = shards.sparkSession
    sums = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = [], 0
    for part, n in sums:
        base.append((part, total))
        total += n
    # From Arrow, not from rows: those would start a second kind of Python worker on every executor.
    base = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in base], pa.int32()), "base": pa.array([b for _, b in base], pa.int64())}))
    rows = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "n_tokens", "payload")
    return rows.mapInArrow(frugal(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
