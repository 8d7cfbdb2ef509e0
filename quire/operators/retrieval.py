"""Hybrid retrieval of a batch of queries: intent, seeds, expansion over the graph, merge and rank.

Parameters are columns or arguments; there is no state between queries, so a batch is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import tables as T
from ..functions.scalar import r4
from ..sources.staging import saved
from . import graph as G
from . import vector as V


def classify_intent(queries: DataFrame, patterns: dict[str, tuple[str, ...]] = T.INTENT_PATTERNS) -> DataFrame:
    """Adds intent and intent_conf: the intent with the most matching patterns, by share of its list.

    A tie is ``general`` but keeps the winner's confidence; no match is ``general`` with 0.
    """
    text = F.lower("query")
    hits = F.array(*(F.struct(sum((text.rlike("(?U)" + p).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(i).alias("intent"), F.lit(len(ps)).alias("size")) for k, (i, ps) in enumerate(patterns.items())))
    out = queries.withColumn("_hits", hits).withColumn("_best", F.array_max("_hits"))
    ties = F.size(F.filter("_hits", lambda h: h["n"] == F.col("_best.n")))
    conf = F.floor(F.least(F.lit(1.0), F.col("_best.n") / F.col("_best.size")) * 1e3 + 0.5) / 1e3
    intent = F.when((F.col("_best.n") == 0) | (ties > 1), "general").otherwise(F.col("_best.intent"))
    return out.withColumn("intent", intent).withColumn("intent_conf", F.when(F.col("_best.n") == 0, 0.0).otherwise(conf)).drop("_hits", "_best")


def settle_intent(queries: DataFrame, seeds: DataFrame, override: str | None = "intent_override") -> DataFrame:
    """Adds intent_used and intent_source: an override, the classified intent, or that of the seeds' main role."""
    role = seeds.where("role <> 'N/A'").groupBy("query_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    main = role.groupBy("query_id").agg(F.max_by("role", F.struct(F.col("n"), -F.col("first"))).alias("main_role"))
    out = queries.join(main, "query_id", "left")
    given = F.col(override) if override in queries.columns else F.lit(None).cast("string")
    weak = (F.col("intent_conf") < T.WEAK_INTENT) & F.col("main_role").isNotNull()
    used = F.when(given.isNotNull(), given).when(weak, F.lower("main_role")).otherwise(F.col("intent"))
    source = F.when(given.isNotNull(), "override").when(weak, "role").otherwise("classifier")
    return out.withColumn("intent_used", used).withColumn("intent_source", source).drop("main_role")


def expand(queries: DataFrame, seeds: DataFrame, edges: DataFrame, expand_k: int = T.EXPAND_K, most: int = T.MAX_EXPANSION) -> DataFrame:
    """Neighbours of the seeds along the relations of the query's intent.

    (query_id, seed_id, node_id, weighted, relation, hit_pos): out-edges, then in-edges marked with an arrow,
    each in edge order; never another seed, never below the least score; ``expand_k`` for each seed and
    ``most`` for each query. An unknown intent follows the relations of ``general``.
    """
    follows = F.broadcast(T.intent_relations(queries.sparkSession))
    intent = F.when(F.col("intent_used").isin(*T.INTENT_OUT), F.col("intent_used")).otherwise("general")
    s = seeds.join(queries.select("query_id", intent.alias("intent")), "query_id").select("query_id", F.col("node_id").alias("seed_id"), F.col("rank").alias("seed_rank"), "intent").join(follows, "intent")
    way = lambda d, a, b: edges.select(F.lit(d).alias("direction"), F.col(a).alias("seed_id"), F.col(b).alias("node_id"), "relation", "weight", "doc", "edge_seq")
    s = saved(s, "followed")  # so that its size is known: a few rows go to the edges
    hit = s.join(way(0, "src", "tgt").unionByName(way(1, "tgt", "src")), ["direction", "seed_id", "relation"])
    hit = hit.withColumn("weighted", r4(F.col("weight") * F.col("multiplier"))).where(F.col("weighted") >= T.MIN_GRAPH_SCORE)
    hit = hit.join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    per_seed = W.partitionBy("query_id", "seed_id").orderBy("direction", "edge_seq")
    hit = hit.withColumn("k", F.row_number().over(per_seed)).where(F.col("k") <= expand_k)
    order = W.partitionBy("query_id").orderBy("seed_rank", "direction", "edge_seq")
    hit = hit.withColumn("hit_pos", F.row_number().over(order)).where(F.col("hit_pos") <= most)
    shown = F.when(F.col("direction") == 1, F.concat(F.lit("←"), "relation")).otherwise(F.col("relation"))
    return hit.select("query_id", "seed_id", "node_id", "weighted", shown.alias("relation"), "hit_pos")


def bonus_flat(bonus: float = T.SEED_BONUS):
    return lambda rank: F.lit(bonus)


def bonus_decayed(base: float = T.BONUS_V3, decay: float = T.DECAY_V3):
    """A bonus that falls with the seed's rank (from 1)."""
    return lambda rank: r4(base * F.pow(F.lit(decay), rank - 1))


def merge(seeds: DataFrame, hits: DataFrame, nodes: DataFrame, alpha: float = T.ALPHA, bonus=bonus_flat(), round_base: bool = True) -> DataFrame:
    """Seeds and expanded nodes with their scores, ranked within their query.

    A seed has its similarity and a bonus, an expanded node the best weight of its hits.
    """
    zero = F.lit(0.0)
    a = seeds.select("query_id", "node_id", F.col("score").alias("s"), zero.alias("g"), F.lit(True).alias("is_seed"), F.col("rank").alias("pos"), F.array().cast("array<string>").alias("relation_path"), F.coalesce(F.col("origin") if "origin" in seeds.columns else F.lit(None), F.lit("seed")).alias("origin"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("hit_pos", "relation"))), lambda x: x["relation"])
    b = hits.groupBy("query_id", "node_id").agg(F.max("weighted").alias("g"), F.min("hit_pos").alias("pos"), path.alias("relation_path"))
    b = b.select("query_id", "node_id", zero.alias("s"), "g", F.lit(False).alias("is_seed"), "pos", "relation_path", F.lit("expansion").alias("origin"))
    score = F.floor(F.col("s") * 1e4 + 0.5) / 1e4
    base = alpha * score + (1 - alpha) * F.col("g")
    final = (r4(base) if round_base else base) + F.when(F.col("is_seed"), bonus(F.col("pos"))).otherwise(0.0)
    out = a.unionByName(b).withColumn("final_score", r4(final)).withColumn("similarity", score).withColumnRenamed("g", "graph_score")
    out = out.join(nodes.select("node_id", "doc", "role", "page", "region_class", "section_id", "text"), "node_id")
    return out.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("is_seed").desc(), "pos"))).drop("s", "pos")


def prefer_role(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Moves a query's wanted role to the front and keeps all rows."""
    wanted = queries.select("query_id", F.col("role_filter").alias("wanted"))
    other = F.coalesce((F.col("role") != F.col("wanted")).cast("int"), F.lit(0))
    order = W.partitionBy("query_id").orderBy(other, "final_rank")
    return ranked.join(wanted, "query_id").withColumn("final_rank", F.row_number().over(order)).drop("wanted")


def rescue(index: DataFrame, queries: DataFrame, seeds: DataFrame, role: str = T.RESCUE_ROLE, k: int = T.RESCUE_K, centroids: np.ndarray | None = None) -> DataFrame:
    """Seeds and, for queries without a seed of a role, the best rows of that role after them."""
    have = seeds.where(F.col("role") == role).select("query_id").distinct()
    lone = queries.join(have, "query_id", "left_anti").withColumn("role_filter", F.lit(role))
    more = V.search(index, lone, top_k=k, centroids=centroids).join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    last = seeds.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = more.join(last, "query_id", "left").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    more = more.withColumn("rank", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int")).drop("last", "n").withColumn("origin", F.lit("rescue"))
    return seeds.withColumn("origin", F.lit("seed")).unionByName(more.select(*seeds.columns, "origin"))


@dataclass
class Retrieval:
    """What a batch of queries found; all frames share query_id."""

    queries: DataFrame
    seeds: DataFrame
    hits: DataFrame
    ranked: DataFrame
    subgraph: DataFrame

    def top_texts(self, n: int = 5) -> DataFrame:
        return self.ranked.where(F.trim("text") != "").where(F.col("final_rank") <= n).select("query_id", "final_rank", "text")

    def top_nodes(self, n: int = 5) -> DataFrame:
        return self.ranked.where(F.col("final_rank") <= n)

    def by_role(self, role: str) -> DataFrame:
        return self.ranked.where(F.col("role") == role)

    def provenance(self) -> DataFrame:
        """One row per query, those without any seed too."""
        s = self.seeds.groupBy("query_id").agg(F.array_sort(F.collect_list("node_id")).alias("seed_ids"))
        e = self.hits.groupBy("query_id").agg(F.array_sort(F.collect_set("node_id")).alias("expanded_ids"), F.array_sort(F.collect_set("relation")).alias("relations"))
        n = self.ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_final"))
        none = F.array()
        out = self.queries.join(s, "query_id", "left").join(e, "query_id", "left").join(n, "query_id", "left")
        return out.select("query_id", "intent_used", "intent_source", F.coalesce("seed_ids", none.cast("array<long>")).alias("seed_ids"), F.coalesce("expanded_ids", none.cast("array<long>")).alias("expanded_ids"), F.coalesce("relations", none.cast("array<string>")).alias("relations"), F.coalesce("n_final", F.lit(0)).alias("n_final"))


def retrieve(index: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, top_k: int = T.TOP_K, expand_k: int = T.EXPAND_K, final_k: int = T.FINAL_K, alpha: float | None = None, version: int = 2, centroids: np.ndarray | None = None) -> Retrieval:
    """The whole engine. The role filter only moves rows to the front; seeds are searched without it.

    ``centroids`` are those of a clustered index.

    Version 3 has a bonus that falls with the rank and rescues observations.
    """
    third = version == 3
    queries = classify_intent(queries, T.INTENT_PATTERNS_V3 if third else T.INTENT_PATTERNS)
    seeds = V.search(index, queries.withColumn("role_filter", F.lit(None).cast("string")), top_k=top_k, centroids=centroids)
    if third:
        seeds = rescue(index, queries, saved(seeds, "seeds"), centroids=centroids)
    seeds = saved(seeds, "seeds")
    queries = settle_intent(queries, seeds)
    hits = saved(expand(queries, seeds, edges, expand_k), "hits")
    alpha = alpha if alpha is not None else T.ALPHA_V3 if third else T.ALPHA
    ranked = merge(seeds, hits, nodes, alpha, bonus_decayed() if third else bonus_flat(), not third)
    if "role_filter" in queries.columns:
        ranked = prefer_role(ranked, queries)
    ranked = saved(ranked.where(F.col("final_rank") <= final_k), "ranked")
    return Retrieval(queries, seeds, hits, ranked, G.induced_subgraph(edges, ranked))


def retrieve_for(intent: str):
    """retrieve() with an intent given."""

    def run(index, nodes, edges, queries, **kw) -> Retrieval:
        return retrieve(index, nodes, edges, queries.withColumn("intent_override", F.lit(intent)), **kw)

    return run


retrieve_method, retrieve_result, retrieve_dataset, retrieve_figure, retrieve_definition, retrieve_observation = map(retrieve_for, ("method", "result", "dataset", "figure", "definition", "observation"))


def validate(index: DataFrame, edges: DataFrame, alpha: float) -> dict[str, bool]:
    return {"index": not index.isEmpty(), "graph": not edges.isEmpty(), "alpha": 0.0 <= alpha <= 1.0}


