"""Building a corpus of documents and asking it: the stages put together.

build() writes the graph and the index as tables, so that questions read them and nothing is built
twice; asking is one plan for all questions of a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions.scalar import unit
from ..operators import graph as G, layout as L, pages as P, prompt as A, retrieval as R, semantic as S, vector as V
from ..sources import json_io as J
from ..sources.staging import saved


@dataclass
class Settings:
    top_k: int = T.TOP_K
    expand_k: int = T.EXPAND_K
    final_k: int = T.FINAL_K
    alpha: float = T.ALPHA
    version: int = 2
    mode: str = "hybrid"


def regions_of(blocks: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Classified regions in reading order.

    Blocks are shuffled once, by document; boxes alone go a second way, to the function that orders a page, and a
    document's orders come back as one row. The rows stay dealt by document for what needs all of one.
    """
    found = L.detect(blocks, figures, by_document=True)
    orders = P.page_orders(found).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_index", "places"))).alias("orders"))
    place = F.array_position(F.col("orders")[F.col("page_index").cast("int")], F.col("region_pos").cast("int")) - 1
    return found.join(orders.hint("merge"), "doc_id").withColumn("reading_pos", place.cast("int")).drop("orders")


def region_nodes(regions: DataFrame) -> DataFrame:
    """Regions as nodes of a graph, still without vectors and roles; ``full_text`` is what those are made of."""
    return regions.select(
        F.col("doc_id").alias("doc"),
        F.col("page_index").alias("page"),
        F.col("region_id").alias("node_id"),
        "region_class",
        F.col("text_content").alias("text"),
        F.col("text_content").alias("full_text"),
        "bbox",
        F.col("bbox.y0").alias("y0"),
        F.lit(None).cast("string").alias("role"),
        "confidence",
        "backend",
        "source_block_ids",
        (F.col("page_index") * 100_000 + F.col("reading_pos")).cast("long").alias("node_seq"),
    )


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes whose ids are numbers: an id that is text becomes a hash of the document and the id, and stays as
    ``text_id``."""
    if dict(nodes.dtypes)["node_id"] != "string":
        return nodes
    return nodes.withColumn("text_id", F.col("node_id")).withColumn("node_id", F.xxhash64("doc", "text_id"))


def encode_queries(queries: DataFrame, encoder=S.hashed_vectors) -> DataFrame:
    """Adds qvec, each query's unit vector."""
    return S.encode(queries, "query", encoder).withColumn("qvec", unit(F.col("embedding"))).drop("embedding")


@dataclass
class Corpus:
    """A built corpus: tables under one path, and the encoder that its vectors come from."""

    spark: SparkSession
    path: str
    encoder: Callable[[list[str]], np.ndarray] = S.hashed_vectors

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")

    @cached_property
    def _index(self) -> tuple[DataFrame, np.ndarray | None]:
        return J.read_index(self.spark, f"{self.path}/index")

    @property
    def index(self) -> DataFrame:
        return self._index[0]

    @property
    def centroids(self) -> np.ndarray | None:
        """Those of a clustered index."""
        return self._index[1]

    @property
    def kind(self) -> str:
        return "exact" if self.centroids is None else "ivf"

    @property
    def size(self) -> int:
        return self.index.count()

    def validate(self) -> dict[str, bool]:
        return R.validate(self.index, self.edges, T.ALPHA)

    def retrieve(self, queries: DataFrame, settings: Settings | None = None) -> R.Retrieval:
        """queries: query_id, query and, if wanted, qvec, role_filter and intent_override; a missing qvec is made of the query."""
        s = settings or Settings()
        queries = queries if "qvec" in queries.columns else saved(encode_queries(queries, self.encoder), "asked")
        hops = 0 if s.mode == "vector" else s.expand_k
        return R.retrieve(self.index, self.nodes, self.edges, queries, s.top_k, hops, s.final_k, s.alpha, s.version, self.centroids)

    def prompts(self, found: R.Retrieval) -> DataFrame:
        return A.assemble(found.queries, A.passages(found.ranked), A.prompt_edges(found.subgraph, self.nodes))

    def ask(self, queries: DataFrame, generator=A.extractive, settings: Settings | None = None) -> DataFrame:
        """(query_id, answer, evidence, reasoning, response, error)."""
        return A.parse(A.generate(self.prompts(self.retrieve(queries, settings)), generator))


def build(nodes: DataFrame, path: str, links: DataFrame | None = None, heading=None, encoder=S.hashed_vectors) -> Corpus:
    """Writes nodes, edges and index of documents below ``path``; a large index is clustered.

    Nodes with text ids are numbered first, and links are then made here; ids that collide are an error.
    """
    spark = nodes.sparkSession
    if links is not None and dict(nodes.dtypes)["node_id"] == "string":
        raise ValueError("links of nodes with text ids are made here")
    nodes = numbered(nodes)
    return _store(G.assign_sections(G.distinct_nodes(nodes), heading).withColumn("embedding", V.packed()), path, links, encoder)


def _store(known: DataFrame, path: str, links: DataFrame | None, encoder) -> Corpus:
    """Writes nodes with sections and packed vectors, then edges and the index, which read them."""
    spark = known.sparkSession
    known.withColumn("is_indexed", V.is_admitted()).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    known = spark.read.parquet(f"{path}/nodes")
    # One row is left of a document's node, so a number that comes twice is that of two documents.
    if "text_id" in known.columns and not known.groupBy("node_id").count().where("count > 1").isEmpty():
        raise ValueError("two nodes have one number")
    G.build_edges(known, G.link_captions(known) if links is None else links).write.mode("overwrite").parquet(f"{path}/edges")
    index = known.where("is_indexed").select("node_id", "doc", "page", "region_class", "role", "is_noise", "embedding")  # texts are in the nodes
    n = index.count()
    kind, lists = V.index_type(n)
    centroids = None if kind == "exact" else V.sampled_lists(index, n, lists)
    J.write_index(index if centroids is None else V.listed(index, centroids), f"{path}/index", kind, centroids, folders=False)
    return Corpus(spark, path, encoder)


def build_from_blocks(blocks: DataFrame, path: str, figures: DataFrame | None = None, encoder=S.hashed_vectors) -> Corpus:
    """The whole way from page blocks: regions in reading order, roles and vectors, links, graph and index."""
    nodes = G.assign_sections(G.distinct_nodes(numbered(region_nodes(regions_of(blocks, figures)))))
    nodes = S.RoleModel(blocks.sparkSession, encoder=encoder).describe(nodes, "full_text")
    nodes = nodes.withColumn("role", F.col("scholarly_role")).withColumn("is_noise", V.is_noise()).drop("scholarly_role", "full_text")
    return _store(nodes, path, None, encoder)
