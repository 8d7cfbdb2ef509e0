"""Counts and shares that a viewer of documents shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import r4


def class_histogram(regions: DataFrame, column: str = "region_class") -> DataFrame:
    return regions.groupBy(column).agg(F.count("*").alias("n"))


def role_share(nodes: DataFrame) -> DataFrame:
    """Roles but N/A, with their share of these rows in percent."""
    n = nodes.where("role <> 'N/A'").groupBy("role").agg(F.count("*").alias("n"))
    return n.withColumn("percent", r4(100.0 * F.col("n") / F.sum("n").over(W.partitionBy())))


def region_filter(regions: DataFrame, classes: list[str] | None = None, roles: list[str] | None = None) -> DataFrame:
    out = regions
    if classes:
        out = out.where(F.col("region_class").isin(*classes))
    return out.where(F.col("role").isin(*roles)) if roles else out


def counters(nodes: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """One row: pages, nodes, edges and vectors."""
    n = nodes.agg(F.count_distinct("doc", "page").alias("n_pages"), F.count("*").alias("n_nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(index.agg(F.count("*").alias("n_vectors")))


def edge_percent(edges: DataFrame) -> DataFrame:
    """Edges by relation, and their whole percent of all."""
    n = edges.groupBy("relation").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy())).cast("long"))


def shorten(text: Column, n: int = 120, html: bool = False) -> Column:
    """At most n characters, with HTML's signs replaced if asked for."""
    out = F.substring(text, 1, n)
    if html:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
    return out
