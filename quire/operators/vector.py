"""Vector index and batch search.

The index is a table of admitted nodes with unit vectors. A search scans it once for a whole block of
queries: every partition keeps its best rows for each query, so only those are shuffled. Larger
indexes carry the nearest of a few centroids; a search reads the lists of the nearest ones first and of
the others those that may hold a better row, so it finds what a full search finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import tables as T
from ..functions.packed import pack, units
from ..functions.scalar import strip, unit

#: Queries that are sent to the executors at once.
BLOCK = 4096
#: Rows found that may be sent to the executors to join the index.
FEW = 1 << 18


def is_noise(region_class="region_class", role="role"):
    return F.col(region_class).isin(*T.NOISE_CLASSES) | (F.col(role) == "N/A")


def is_admitted():
    """For the index: no noise, at least five characters of text within the first 400."""
    return ~is_noise() & (F.length(strip(F.substring("text", 1, T.INDEX_CHARS))) >= T.INDEX_MIN_CHARS)


def admit(nodes: DataFrame) -> DataFrame:
    """Nodes for the index, their texts cut to 400 characters."""
    return nodes.where(is_admitted()).withColumn("is_noise", is_noise()).withColumn("text", F.substring("text", 1, T.INDEX_CHARS))


def build_index(nodes: DataFrame, vector: str = "embedding") -> DataFrame:
    return admit(nodes).withColumn("embedding", unit(F.col(vector)))


def index_type(n: int) -> tuple[str, int]:
    """(kind, number of lists) for n rows."""
    return ("exact", 1) if n <= T.EXACT_ROWS else ("ivf", max(1, min(T.MAX_LISTS, n // 10)))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Vectors are unpacked for so many rows at once, which bounds a worker's memory."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def _by_pieces(f: Callable[..., np.ndarray], *columns: pa.Array, rows: int = 2048) -> np.ndarray:
    """f over the vectors of some rows at a time."""
    return np.concatenate([f(*(units(c.slice(k, rows)) for c in columns)) for k in range(0, len(columns[0]), rows)] or [np.zeros(0)])


def _best(queries, vector_at: int, probe_at: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, k, probes, reach = queries.value
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]

        def cut(i: int):
            node, score = (np.concatenate(x) for x in zip(*found[i]))
            order = np.lexsort((node, -np.floor(score * 1e9 + 0.5)))[: k[i]]
            found[i] = [(node[order], score[order])]

        def take(i: int, node: np.ndarray, score: np.ndarray, rows: np.ndarray):
            if len(rows) > k[i]:
                least = np.partition(score[rows], len(rows) - k[i])[len(rows) - k[i]]
                rows = rows[score[rows] >= least - 1e-8]
            found[i].append((node[rows], score[rows]))
            cut(i)

        def least(i: int) -> float:
            """The score that a row must reach to be of use."""
            best = found[i][0][1] if found[i] else ()
            return best[-1] - 1e-8 if len(best) == k[i] else -np.inf

        for batch in _pieces(batches):
            node = batch.column(0).to_numpy()
            e = units(batch.column(vector_at))
            if probe_at is None:
                s = e @ q.T
                for i in range(len(ids)):
                    take(i, node, s[:, i], np.arange(len(node)))
                continue
            lists = batch.column(probe_at).to_numpy()
            here = [(x, np.flatnonzero(lists == x)) for x in np.unique(lists)]
            for near in (True, False):  # what the nearest lists give rules most others out
                for x, rows in here:
                    asks = [i for i in range(len(ids)) if (x in probes[i]) == near and (near or reach[i][x] >= least(i))]
                    if asks:
                        s = e[rows] @ q[asks].T
                        for column, i in enumerate(asks):
                            take(i, node[rows], s[:, column], np.arange(len(rows)))
        for i in range(len(ids)):
            if found[i] and len(found[i][0][0]):
                n, s = found[i][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), ids[i])), pa.array(n), pa.array(s)], names=["query_id", "node_id", "score"])

    return run


def _radius(index: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The greatest distance of a row to its list's centroid, for each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(centroids), -1.0)
        for batch in _pieces(batches):
            at = batch.column(0).to_numpy()
            e = units(batch.column(1))
            np.maximum.at(far, at, np.linalg.norm(e - centroids[at], axis=1))
        have = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(far[have])], names=["list", "far"])

    out = np.full(len(centroids), -np.inf)
    for r in index.select("list", "embedding").mapInArrow(run, "list int, far double").groupBy("list").agg(F.max("far").alias("far")).collect():
        out[r["list"]] = r["far"]
    return out


def scan(index: DataFrame, queries: DataFrame, vector: str = "qvec", centroids: np.ndarray | None = None, probes: int = T.PROBES) -> DataFrame:
    """(query_id, node_id, score, rank): the best ``fetch_k`` rows of every query, ties by id.

    ``queries`` has query_id, the vector and fetch_k. They are read in blocks of ``BLOCK`` and sent to the
    executors, each block a scan of its own. With centroids (and a ``list`` column in the index) a query
    sees the lists of its nearest ones first; a list whose centroid and radius rule out a better row is skipped.
    """
    spark = index.sparkSession
    rows = queries.select("query_id", F.col(vector).alias("v"), "fetch_k")
    out, columns = None, ["node_id", "embedding"] + (["list"] if centroids is not None else [])
    n = rows.count()
    radius = _radius(index, centroids) if centroids is not None else None
    for b in range(max(1, -(-n // BLOCK))):
        part = (rows if n <= BLOCK else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))) == b)).collect()
        q = np.array([r.v for r in part], np.float64).reshape(len(part), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = q / np.where(norm == 0, 1, norm)
        near = [np.argsort(((centroids - x) ** 2).sum(axis=1), kind="stable")[:probes] for x in q] if centroids is not None else None
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in part], np.int64), q, [int(r.fetch_k) for r in part], near, q @ centroids.T + radius if centroids is not None else None))
        found = index.select(*columns).mapInArrow(_best(sent, 1, 2 if centroids is not None else None), "query_id long, node_id long, score double")
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.floor(F.col("score") * 1e9 + 0.5).desc(), "node_id")
    out = out.withColumn("rank", F.row_number().over(order)).join(F.broadcast(queries.select("query_id", "fetch_k")) if n <= BLOCK else queries.select("query_id", "fetch_k"), "query_id")
    return out.where("rank <= fetch_k").drop("fetch_k")


def search(index: DataFrame, queries: DataFrame, top_k: int = T.TOP_K, exclude_noise: bool = True, centroids: np.ndarray | None = None) -> DataFrame:
    """Seeds of every query: rank within the best ``top_k`` after the role filter.

    With a role filter, or when noise is left out, six times as many rows are fetched first and only
    those are filtered, so a filtered search can return fewer rows than asked for.
    """
    wide = F.when(F.col("role_filter").isNotNull() | F.lit(exclude_noise), top_k * T.OVERFETCH).otherwise(top_k)
    asked = queries.withColumn("fetch_k", wide.cast("int"))
    hits = scan(index, asked, centroids=centroids).withColumnRenamed("rank", "raw_rank")
    # Only what the filters need meets all that was fetched; texts and the rest join what is left. Few rows go to the index.
    n = queries.limit(BLOCK + 1).count()
    few = F.broadcast if n <= BLOCK and n * top_k * T.OVERFETCH <= FEW else lambda x: x
    hits = few(hits).join(index.select("node_id", "role", "is_noise"), "node_id").join(asked.select("query_id", "role_filter"), "query_id")
    if exclude_noise:
        hits = hits.where(~F.col("is_noise"))
    hits = hits.where(F.col("role_filter").isNull() | (F.col("role") == F.col("role_filter"))).drop("role_filter")
    order = W.partitionBy("query_id").orderBy("raw_rank")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("raw_rank")
    return few(hits).join(index.drop("embedding", "list", "role", "is_noise"), "node_id")


def cluster(index: DataFrame, lists: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """The index with each row's list, and the lists' centroids, by k-means over the unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.withColumn("v", array_to_vector("embedding"))
    model = KMeans(k=lists, seed=seed, featuresCol="v", predictionCol="list", maxIter=20).fit(rows)
    return model.transform(rows).drop("v"), np.array(model.clusterCenters())


def packed(vector: str = "embedding"):
    """A column of float or double arrays as packed vectors; nulls are no vectors and stay."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        kind = np.float64 if pa.types.is_float64(column.type.value_type) else np.float32
        have = column.drop_null()
        out = pack(np.asarray(have.flatten(), kind).reshape(len(have), -1))
        return out if len(have) == len(column) else out.take(pa.array(np.where(column.is_valid(), np.cumsum(column.is_valid()) - 1, 0), mask=~np.asarray(column.is_valid())))

    return run(F.col(vector))


def cosines(a, b):
    """Of packed vectors; 0 where either has no length."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(_by_pieces(lambda a, b: (a * b).sum(axis=1), left, right), pa.float64())

    return run(a, b)


def sampled_lists(index: DataFrame, n: int, lists: int, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """Centroids by k-means over at most about ``T.LIST_ROWS`` of the n rows of a packed index, chosen by their ids."""
    some = index if n <= T.LIST_ROWS else index.where(F.pmod(F.xxhash64("node_id"), F.lit(n)) < T.LIST_ROWS)
    rows = some.select("node_id", "embedding").toArrow().sort_by("node_id")
    v = units(rows.column("embedding").combine_chunks())
    at = np.random.default_rng(seed).choice(len(v), min(lists, len(v)), replace=False)
    centroids = np.concatenate([v[at], np.zeros((lists - len(at), v.shape[1]))])
    for _ in range(rounds):
        near = _nearest(v, centroids)
        for k in np.unique(near):
            centroids[k] = v[near == k].mean(axis=0)
    return centroids


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (v @ centroids.T)).argmin(axis=1)


def listed(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A packed index with each row's list, that of the nearest centroid."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(_by_pieces(lambda v: _nearest(v, centroids), column).astype(np.int32))

    return index.withColumn("list", run(F.col("embedding")))


def summary(index: DataFrame) -> DataFrame:
    return index.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def validate(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of checks: rows of the index, whether they match the metadata, whether any is useful."""
    own = index.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_noise").alias("n_noise"), F.countDistinct("node_id").alias("n_ids"))
    return own.select("n_rows", (F.col("n_rows") > 0).alias("built"), (F.col("n_rows") == F.col("n_ids")).alias("ids_match"), ((F.col("n_rows") > 0) & (F.col("n_noise") < F.col("n_rows"))).alias("has_useful"))
