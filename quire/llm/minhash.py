"""Near-duplicate documents by tensored MinHash banding.

A document's set holds its distinct word shingles. ``collections`` small hash collections are
computed, each joining ``width`` minhashes; every pair (i, j) of collections makes one table key, so
``collections * (collections - 1) / 2`` tables of ``2 * width`` minhashes come from only
``collections * width`` minhash computations, about the square root of what separate tables need.
At similarity 0.8 and the defaults (20 collections of 3), a pair of documents shares no table with
probability 0.488**20 * (1 + 20 * 0.512 / 0.488), about 1.3e-5; at 0.85 it is about 2e-7.

Candidates are confirmed on full sets. Equal sets are joined into one class first, and a bucket's
members are compared to one member of it (a star) before anything else; only members of buckets
that still hold several components are compared further, across components. A component never needs all
its pairs, and no link across two components is skipped: two sets that reach the similarity share one of
their few rarest shingles, so a document meets only those blocks of others that hold one of its own.

Rows are numbered when their signatures are written, and a class is told by its smallest row; ids come
in only to tie the texts of one id together and to name components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import Stages, blocks, frugal, list_array
from .words import Words, mix

U = np.uint64


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a block, and the first position of each text."""
    n = w.n_words
    flat, starts = [], [0]
    h = w.hash
    whole = np.zeros(len(h), np.uint64)
    if len(h):
        for k in range(size):
            part = np.roll(h, -k)
            whole = mix(whole * U(0xD6E8FEB86659FD93) + part + U(k + 1))
    for d in range(w.n_docs):
        lo, k = w.first_word[d], n[d]
        if k >= size:
            own = np.unique(whole[lo : lo + k - size + 1])
        elif k:
            short = np.uint64(k)
            for x in h[lo : lo + k]:
                short = mix(np.array([short * U(0xA0761D6478BD642F) + x], np.uint64))[0]
            own = np.array([short], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        flat.append(own)
        starts.append(starts[-1] + len(own))
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array(starts, np.int64)


def signatures(flat: np.ndarray, starts: np.ndarray, collections: int, width: int, seed: int) -> np.ndarray:
    """One row for each text with a set: its ``collections`` joined minhashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, collections * width, dtype=np.uint64) * U(2) + U(1)
    x = rng.integers(0, 2**63, collections * width, dtype=np.uint64)
    at = starts[:-1][np.diff(starts) > 0]
    out = np.zeros((len(at), collections), np.uint64)
    for i in range(collections if len(at) else 0):
        for j in range(width):
            k = i * width + j
            v = flat ^ x[k]
            v *= a[k]
            v ^= v >> U(32)
            out[:, i] = mix(out[:, i] * U(0xE7037ED1A0B428DB) + np.minimum.reduceat(v, at))
    return out


def _signature_batches(size: int, collections: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, offsets, data in blocks(batch.column(1)):
                with np.errstate(over="ignore"):
                    flat, starts = shingle_sets(Words(offsets, data), size)
                    sig = signatures(flat, starts, collections, width, seed)
                    fp = fingerprints(flat, starts)
                n = np.diff(starts)
                lists = np.concatenate([[0], np.cumsum(n > 0)]) * collections
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(hi - lo)), ids.slice(lo, hi - lo), pa.array(n), pa.array(fp[0]), pa.array(fp[1]), list_array(sig.reshape(-1).view(np.int64), lists, pa.int64())],
                    names=["id", "doc_id", "n_shingles", "fp1", "fp2", "sig"],
                )
                number += hi - lo

    return run


def fingerprints(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each whole set."""
    out = np.zeros((2, len(starts) - 1), U)
    some = np.diff(starts) > 0
    if some.any():
        out[0, some] = np.add.reduceat(mix(flat), starts[:-1][some])
        out[1, some] = np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), starts[:-1][some])
    return out.view(np.int64)


#: Places of the bitmap that tells which ids are wanted: 8 MB, whatever the number of documents.
PLACES = 67108859


def _set_batches(size: int, wanted):
    """Sets of the texts whose id may be wanted, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            place = batch.column(0).to_numpy() % PLACES
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for _, _, offsets, data in blocks(batch.column(1)):
                with np.errstate(over="ignore"):
                    flat, starts = shingle_sets(Words(offsets, data), size)
                    fp = fingerprints(flat, starts)
                keys = list(zip(*fp.tolist()))
                fresh = [k for k, x in enumerate(keys) if x not in seen and not seen.add(x)]
                items = list_array(flat.view(np.int64), starts, pa.int64()).take(pa.array(fresh, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(fp[0][fresh]), pa.array(fp[1][fresh]), items], names=["fp1", "fp2", "items"])

    return run


def _sets(docs: DataFrame, sig: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the full sets of these rows (class representatives).

    A bitmap of fixed size drops most other documents before anything is shuffled; the join drops the
    rest, so texts are never moved.
    """
    spark = docs.sparkSession
    own = sig.select("id", "doc_id", "fp1", "fp2").join(ids, "id", "left_semi")
    place = F.pmod("doc_id", F.lit(PLACES)) + 1
    parts = own.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((PLACES // 32768 + 1, 4096), np.uint8)
    for k, part in parts:
        bits[k - 1] = np.frombuffer(part, np.uint8)
    wanted = spark.sparkContext.broadcast(bits.reshape(-1))
    sets = docs.mapInArrow(frugal(_set_batches(shingle, wanted)), "fp1 long, fp2 long, items array<long>")
    return sets.join(own.drop("doc_id"), ["fp1", "fp2"]).dropDuplicates(["fp1", "fp2"]).select("id", "items")


def _key_batches(collections: int):
    """Table keys of all pairs of collections; inside a batch, equal keys meet already here.

    Of the rows of one key in a batch, the smallest id leads and alone goes on to meet other
    batches; the others name it.
    """
    i, j = np.triu_indices(collections, 1)
    salt = mix(np.arange(1, len(i) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            order = np.argsort(every, kind="stable")
            sig_all = np.asarray(batch.column(1).flatten()).view(np.uint64).reshape(-1, collections)
            for lo in range(0, len(order), 4096):
                part = order[lo : lo + 4096]
                ids, sig = every[part], sig_all[part]
                with np.errstate(over="ignore"):
                    keys = mix((sig[:, i] * U(0x9FB21C651E98DF25) + sig[:, j]) ^ salt).reshape(-1)
                who = np.repeat(ids, len(i))
                by = np.argsort(keys, kind="stable")  # ids rise within a key
                keys, who = keys[by], who[by]
                head = np.ones(len(keys), bool)
                head[1:] = keys[1:] != keys[:-1]
                lead = who[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
                more = np.zeros(len(keys), bool)
                more[:-1] = ~head[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(who), pa.array(np.where(head, who, lead)), pa.array(head), pa.array(more)],
                    names=["key", "id", "lead", "head", "more"],
                )

    return run


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node of the links (a, b) reaches.

    Every round hangs each node below its smallest neighbour, follows that up to the root, doubling the way
    each time, and contracts the links. At least half of the nodes with links go in a round and a way of n
    nodes takes log n doublings, so a chain in the order of its ids is one round. Each step is
    written out, so no lineage grows. Nothing is collected but whether there is more.
    """
    edges = stages.put(edges.select("a", "b").distinct(), "links")
    found = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("o")))
        parent = stages.put(both.groupBy("id").agg(F.least(F.min("o"), F.first("id")).alias("component")), "parents")
        while True:
            up = parent.select(F.col("id").alias("component"), F.col("component").alias("next"))
            step = parent.select("id", "component").join(up, "component")
            parent = stages.put(step.select("id", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")), "roots")
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("id", "component")
        if found is None:
            found = parent
        else:
            step = parent.select(F.col("id").alias("component"), F.col("component").alias("next"))
            found = stages.put(found.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "found")
        pa_, pb = (parent.select(F.col("id").alias(x), F.col("component").alias("c" + x)) for x in "ab")
        edges = stages.put(edges.join(pa_, "a").join(pb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return found


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80, collections: int = 20, width: int = 3, seed: int = 7) -> DataFrame:
    """One row for each source row, with its set size and component: (doc_id, n_shingles, component_id, kept).

    Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z. A text of fewer words than ``shingle`` has
    its whole sequence as its one shingle. Null, empty or wordless texts have an empty set, are
    linked with nothing and are kept. Rows with the same id and text fall together. An id with several
    texts is one document: what any of its texts is linked with, all are; each row has its own set
    size. A null id with words is left unlinked and kept. Texts of any length are read whole, similarity
    of exactly ``percent`` is a link, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sig = stages.put(docs.mapInArrow(frugal(_signature_batches(shingle, collections, width, seed)), "id long, doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>"), "signatures")

    # Classes of equal sets; the smallest row stands for each.
    able = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = able.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = stages.put(classes.where("n > 1").drop("n"), "classes")
    copies = stages.put(able.select("id", "doc_id", "fp1", "fp2").join(shared, ["fp1", "fp2"]).where("id <> rep").select("id", "doc_id", "rep"), "copies")
    reps = able.join(copies.select("id"), "id", "left_anti")

    rows = reps.select("id", "sig").mapInArrow(frugal(_key_batches(collections)), "key long, id long, lead long, head boolean, more boolean")
    # Rows that already met a smaller id in their batch take no part in the meeting across batches.
    rows = rows.withColumn("apart", F.when(F.col("head"), F.lit(-1)).otherwise(F.pmod(F.col("id"), F.lit(65536))).cast("int"))
    over = W.partitionBy("key", "apart").orderBy("id")
    heads = rows.select("key", "id", "lead", "head", "more", F.first("id").over(over).alias("f"), F.lead("id").over(over).alias("next"))
    heads = heads.select("key", "id", "lead", F.when(F.col("head"), F.col("f")).otherwise(F.col("lead")).alias("first"), "more", "next")
    heads = heads.where((F.col("first") != F.col("id")) | F.col("more") | F.col("next").isNotNull())
    members = stages.put(heads.select("key", "id", "first", "lead").distinct(), "buckets")
    star = members.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b")
    star = stages.put(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    edges = stages.put(_verified(docs, sig, star, shingle, percent, stages).unionByName(_ties(able, copies, stages)), "edges")
    found = components(stages, edges)

    more = _across(docs, sig, members, found, shingle, percent, stages)
    more = stages.put(more, "more")
    if not more.isEmpty():
        found = components(stages, edges.unionByName(more))

    # Of every class that is shared or linked: its smallest id, and that of its component.
    nodes = shared.select(F.col("rep").alias("id"), "least").join(found, "id", "full")
    nodes = nodes.join(sig.select("id", "doc_id"), "id").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("least", "doc_id").alias("least"))
    nodes = stages.put(nodes, "nodes")
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stages.put(nodes.select("id", "component").join(names, "component").select("id", "component_id"), "names")
    own = copies.select("id", "rep").join(names.select(F.col("id").alias("rep"), "component_id"), "rep").select("id", "component_id")
    label = stages.put(names.unionByName(own), "labels")
    stages.keep(sig, label)
    out = sig.select("id", "doc_id", "n_shingles").join(label, "id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def _ties(able: DataFrame, copies: DataFrame, stages: Stages) -> DataFrame:
    """Links (a, b) between the classes in which the texts of one id are."""
    node = able.select("id", "doc_id").join(copies.select("id", "rep"), "id", "left").select("doc_id", F.coalesce("rep", "id").alias("node"))
    node = stages.put(node, "ids")
    several = stages.put(node.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a"), "several")
    return node.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _ranked(size: str, component: str):
    return F.struct(F.col(size).alias("size"), F.col(component).alias("component"))


def _compare(percent: int):
    """Links between the queries and the members of one block that lie in different components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        parts = []
        for t in (left, right):
            items = t.column("items").combine_chunks()
            items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
            sizes = np.diff(items.offsets.to_numpy())
            parts.append((t.column("id").to_numpy(), t.column("component").to_numpy(), sizes, items.flatten().to_numpy()))
        (ids, comp, n, flat), (q_ids, q_comp, q_n, q_flat) = parts
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(ids)), n)[order]
        lo, hi = np.searchsorted(flat, q_flat, "left"), np.searchsorted(flat, q_flat, "right")
        ends, found = np.cumsum(q_n), set()
        for k in range(len(q_ids)):
            s = slice(ends[k] - q_n[k], ends[k])
            count = hi[s] - lo[s]
            at = np.repeat(lo[s] - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(ids))
            good = (common * 100 >= (n + q_n[k] - common) * percent) & (comp != q_comp[k])
            found.update((int(min(q_comp[k], c)), int(max(q_comp[k], c))) for c in comp[good])
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, schema=out)

    return run


#: Documents of a block, queries that meet it in one group, and shingles whose counts every executor holds, at most.
MEMBERS, QUERIES, COMMON = 128, 128, 1 << 20


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): shingles and how many sets hold them, summed over runs of about two million."""
    held, size = [], 0

    def out():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    for batch in batches:
        held.append(np.asarray(batch.column(0).flatten()))
        size += len(held[-1])
        if size >= 1 << 21:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def common_shingles(sets: DataFrame, stages: Stages) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts: at most ``COMMON``, all others are rarer."""
    counts = sets.select("items").mapInArrow(frugal(_shingle_counts), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    counts = stages.put(counts.withColumn("b", F.floor(F.log2("c") * 16).cast("int")), "counts")
    # A power of 2 in sixteenths bounds the number of rows here.
    least, total = None, 0
    for b, n in sorted(counts.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += n
        if total > COMMON:
            break
        least = b
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(F.col("b") >= least).select("h", "c").toArrow().sort_by("h")
    return got.column("h").to_numpy(), got.column("c").to_numpy()


def _prefixes(shared, percent: int):
    """The shingles of each set of which any set that is similar enough must hold one: its rarest, all by one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            items = batch.column(1)
            flat = np.asarray(items.flatten())
            n = np.diff(items.offsets.to_numpy())
            often = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = np.where(known[at] == flat, count[at], 0)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, often, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            most = n - -(-n * percent // 100) + 1
            keep = order[place < most[owner]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(flat[keep])], names=["id", "shingle"])

    return run


def _across(docs: DataFrame, sig: DataFrame, members: DataFrame, found: DataFrame, shingle: int, percent: int, stages: Stages) -> DataFrame:
    """Links (a, b) between components that share a bucket: none across them is missed.

    In a bucket, all but the members of its largest component are queries. A query asks every cluster it
    shares a bucket with: a component, with the single documents whose largest neighbour it is. Clusters
    are cut into blocks; a query goes to those blocks alone where a rare shingle of its own is a
    rare shingle of a member too, as it is for any two sets that are similar enough. So documents that
    share a template and no more don't meet, however many they are. Inside a block all common
    shingles are counted at once; pairs never become rows.
    """
    spark = docs.sparkSession
    own = members.select("key", "id").distinct().join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rest = own.join(open_keys, "key", "left_semi").join(sizes, "component", "left").select("key", "id", "component", F.coalesce("size", F.lit(1)).alias("size"))
    rest = stages.put(rest, "rest")
    top = rest.groupBy("key").agg(F.max(_ranked("size", "component")).alias("top"))
    rest = rest.join(top, "key").withColumn("asks", F.col("component") != F.col("top.component"))
    group = rest.groupBy("id").agg(F.first("component").alias("component"), F.first("size").alias("size"), F.max("top").alias("top"))
    group = stages.put(group.select("id", "component", F.when(F.col("size") > 1, F.col("component")).otherwise(F.col("top.component")).alias("g")), "clusters")
    # By bucket: its queries, and the clusters of its members.
    held = rest.select("key", "id").join(group.select("id", "g"), "id").select("key", "g").distinct()
    asks = stages.put(rest.where("asks").select("key", "id").join(held, "key").select("id", "g").distinct(), "queries")

    sets = stages.put(_sets(docs, sig, group.select("id"), shingle).join(group.select("id", "component"), "id"), "sets")
    shared = spark.sparkContext.broadcast(common_shingles(sets, stages))
    rare = stages.put(sets.select("id", "items").mapInArrow(frugal(_prefixes(shared, percent)), "id long, shingle long"), "rare")
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    n = group.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("nb"))
    group = stages.put(group.join(n, "g").select("id", "g", mine("nb").alias("block")), "blocks")
    there = group.join(rare, "id").select("g", "shingle", "block").distinct()
    meets = stages.put(asks.join(rare, "id").join(there, ["g", "shingle"]).select("id", "g", "block").distinct(), "meets")
    parts = stages.put(meets.groupBy("g", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("nq")), "parts")
    left = group.join(parts, ["g", "block"]).select("id", "g", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("part")).join(sets, "id")
    right = meets.join(parts, ["g", "block"]).select("id", "g", "block", mine("nq").alias("part")).join(sets, "id")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # names of its own: both sides come from one table
    by = ("g", "block", "part")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare(percent), "a long, b long").distinct()


def _verified(docs: DataFrame, sig: DataFrame, pairs: DataFrame, shingle: int, percent: int, stages: Stages) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    na = sig.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"))
    nb = sig.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"))
    pairs = pairs.join(na, "a").join(nb, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = stages.put(pairs.select("a", "b", "na", "nb"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stages.put(_sets(docs, sig, ids, shingle), "sets")
    sa = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b").distinct()
