"""Retrieval metrics over ranked lists: precision, recall, reciprocal rank, nDCG, hit rate."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import tables as T
from ..sources.staging import saved


def query_bank(spark: SparkSession) -> DataFrame:
    rows = [(k, q, [], list(r), d) for k, (q, r, d) in enumerate(T.EVAL_QUERIES)]
    return spark.createDataFrame(rows, "query_id long, query string, relevant_ids array<long>, relevant_roles array<string>, description string")


def label_queries(nodes: DataFrame) -> DataFrame:
    """One query for each role there is; all nodes of the role are relevant, noise too.

    ``relevant_ids`` holds a role's nodes in one row, as the metrics' recall asks for; for corpora where that is
    too much, queries with the role in ``relevant_roles`` alone find the same hits.
    """
    text = F.create_map(*(F.lit(x) for kv in T.ROLE_QUERIES.items() for x in kv))
    by = nodes.where(F.col("role").isin(*T.ROLE_QUERIES)).groupBy("role").agg(F.array_sort(F.collect_set("node_id")).alias("relevant_ids"))
    return by.select(text[F.col("role")].alias("query"), "relevant_ids", F.array("role").alias("relevant_roles"), F.concat(F.lower("role"), F.lit("_retrieval")).alias("description"))


def mark_hits(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds hit and n_relevant: a row is relevant by its id or its role; at least one id counts as relevant."""
    q = queries.select("query_id", "relevant_ids", "relevant_roles")
    hit = F.array_contains("relevant_ids", F.col("node_id")) | F.array_contains("relevant_roles", F.col("role"))
    out = results.join(q, "query_id").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return out.withColumn("n_relevant", F.greatest(F.size("relevant_ids"), F.lit(1))).drop("relevant_ids", "relevant_roles")


def metrics(hits: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10), systems: tuple[str, ...] | None = None) -> DataFrame:
    """(system, query_id, k, precision, recall, rr, ndcg, hit_rate); a query without results has zeros.

    Precision divides by k even for shorter lists, the reciprocal rank looks at the whole list, and nDCG's
    ideal puts the list's own hits first.
    """
    spark = hits.sparkSession
    systems = hits.select("system").distinct() if systems is None else spark.createDataFrame([(x,) for x in systems], "system string")
    k = F.broadcast(spark.createDataFrame([(x,) for x in ks], "k int"))
    grid = queries.select("query_id", F.greatest(F.size("relevant_ids"), F.lit(1)).alias("n_relevant")).crossJoin(F.broadcast(systems)).crossJoin(k)
    rows = hits.select("system", "query_id", "rank", "hit").crossJoin(k)
    inside = F.col("hit") & (F.col("rank") <= F.col("k"))
    own = rows.groupBy("system", "query_id", "k").agg(
        F.count_if(inside).alias("n"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = grid.join(own, ["system", "query_id", "k"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "system", "query_id", "k",
        (n / F.col("k")).alias("precision"),
        (n / F.col("n_relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(n > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        (n > 0).cast("double").alias("hit_rate"),
    )


NAMES = ("precision", "recall", "rr", "ndcg", "hit_rate")


def report(per_query: DataFrame, latency: dict[str, float] | None = None) -> DataFrame:
    """Means by system and k, with the mean milliseconds of a query where they are known."""
    out = per_query.groupBy("system", "k").agg(*(F.avg(m).alias(f"mean_{m}") for m in NAMES), F.count(F.lit(1)).alias("n_queries"))
    if latency is None:
        return out
    table = F.create_map(*(F.lit(x) for kv in latency.items() for x in kv)) if latency else F.lit(None).cast("map<string,double>")
    return out.withColumn("mean_latency_ms", table[F.col("system")])


@dataclass
class Comparison:
    """What compare() found: rows by query, means with latencies, and why a system failed, if it did."""

    per_query: DataFrame
    reports: DataFrame
    errors: dict[str, str]


def compare(queries: DataFrame, systems: dict[str, Callable[[DataFrame], DataFrame]], ks: tuple[int, ...] = (5, 10)) -> Comparison:
    """Runs each system over all queries and measures its lists.

    A system takes the queries and gives (query_id, node_id, role, rank). It is run as one batch; the time
    of the batch over its queries is its latency. A system that fails has empty lists and its error is
    told; the others go on.
    """
    n, latency, errors, lists = queries.count(), {}, {}, []
    for name, system in systems.items():
        start = time.monotonic()
        try:
            rows = saved(ranked_list(system(queries), name), "ranks")
        except Exception as e:  # a system can be anything
            errors[name] = str(e)
            rows = queries.sparkSession.createDataFrame([], "system string, query_id long, node_id long, role string, rank int")
        latency[name] = 1000 * (time.monotonic() - start) / max(n, 1)
        lists.append(rows)
    hits = mark_hits(reduce(DataFrame.unionByName, lists), queries)
    per_query = metrics(hits, queries, ks, tuple(systems))
    return Comparison(per_query, report(per_query, latency), errors)


def delta(reports: DataFrame, of: str = "hybrid", against: str = "vector") -> DataFrame:
    """One system's means minus another's."""
    both = reports.where(F.col("system").isin(of, against)).groupBy("k").pivot("system", [of, against]).agg(*(F.first(f"mean_{m}").alias(m) for m in NAMES))
    return both.select("k", *((F.col(f"{of}_{m}") - F.col(f"{against}_{m}")).alias(f"delta_{m}") for m in NAMES))


def breakdown(per_query: DataFrame, queries: DataFrame, systems: tuple[str, ...] = ("vector", "hybrid")) -> DataFrame:
    """nDCG by description and k, one column for each system."""
    return per_query.join(queries.select("query_id", "description"), "query_id").groupBy("description", "k").pivot("system", list(systems)).agg(F.avg("ndcg"))


def ranked_list(df: DataFrame, system: str, rank: str = "rank") -> DataFrame:
    order = W.partitionBy("query_id").orderBy(rank)
    return df.select(F.lit(system).alias("system"), "query_id", "node_id", "role", F.row_number().over(order).alias("rank"))
