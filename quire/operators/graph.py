"""The typed document graph: nodes, sections, four kinds of edges, and its queries.

Edges come in stages (captions' links, role rules, definitions of a section, section contents); one pair
of nodes has one edge, and an earlier stage wins. ``edge_seq`` is the order in which edges come into being.
Caps per source are kept by ranking the targets inside a section before they meet its sources, so a
section never multiplies its sources with all its targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tables as T
from ..functions.scalar import dot, r4
from ..sources.staging import saved
from .vector import cosines, is_noise


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (doc, node), the first; ``duplicates`` says how many there were besides."""
    over = W.partitionBy("doc", "node_id")
    out = nodes.withColumn("rn", F.row_number().over(over.orderBy("node_seq"))).withColumn("duplicates", F.count("*").over(over) - 1)
    out = out.where("rn = 1").drop("rn").withColumn("region_class", F.lower("region_class"))
    out = out.withColumn("text", F.coalesce(F.substring("text", 1, T.INDEX_CHARS), F.lit(""))).withColumn("y0", F.coalesce("y0", F.lit(0.0)))
    return out.withColumn("is_noise", is_noise())


def is_heading(region_class: Column, text: Column) -> Column:
    return (region_class == "abstract") | ((region_class == "title") & F.trim(text).rlike(T.SECTION_TITLE))


def assign_sections(nodes: DataFrame, heading: Column | None = None) -> DataFrame:
    """Every node with the last heading at or before it in (page, y0) order; a heading has its own id."""
    heading = is_heading(F.col("region_class"), F.col("text")) if heading is None else heading
    order = W.partitionBy("doc").orderBy("page", "y0", "node_seq").rowsBetween(W.unboundedPreceding, 0)
    out = nodes.withColumn("section_id", F.last(F.when(heading, F.col("node_id")), ignorenulls=True).over(order))
    return out.withColumn("sec_key", F.when(F.col("section_id").isNotNull(), F.concat(F.lit("s"), "section_id")).otherwise(F.concat(F.lit("p"), "page")))


def _edges(df: DataFrame, stage: int, source: str) -> DataFrame:
    return df.select("doc", "src", "tgt", "relation", "weight", F.lit(source).alias("edge_source"), F.struct(F.lit(stage).alias("stage"), *(F.col(c).cast("long").alias(c) for c in ("o1", "o2", "o3", "o4", "o5"))).alias("seq"))


def multimodal_edges(nodes: DataFrame, links: DataFrame, threshold: float = T.LINK_THRESHOLD) -> DataFrame:
    """refers_to edges of links that reach the threshold and whose ends exist.

    A repeated link keeps its first place and its last weight.
    """
    known = nodes.select("doc", "node_id")
    out = links.where(F.col("s_link") >= threshold).join(known.withColumnRenamed("node_id", "caption_id"), ["doc", "caption_id"], "left_semi").join(known.withColumnRenamed("node_id", "target_id"), ["doc", "target_id"], "left_semi")
    out = out.groupBy("doc", "caption_id", "target_id").agg(F.max_by("s_link", "link_pos").alias("s"), F.min("link_pos").alias("o1"))
    zero = F.lit(0)
    out = out.select("doc", F.col("caption_id").alias("src"), F.col("target_id").alias("tgt"), F.lit("refers_to").alias("relation"), r4(F.col("s")).alias("weight"), "o1", zero.alias("o2"), zero.alias("o3"), zero.alias("o4"), zero.alias("o5"))
    return _edges(out, 0, "multimodal")


def _room(existing: DataFrame | None) -> int:
    """Edges that any source has already: that many targets may be skipped."""
    if existing is None:
        return 0
    return existing.groupBy("doc", "src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _without(df: DataFrame, existing: DataFrame | None) -> DataFrame:
    return df if existing is None else df.join(existing.select("doc", "src", "tgt"), ["doc", "src", "tgt"], "left_anti")


def role_edges(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges by role rules, to targets of the same section and page, or else of the same page.

    Three targets for each source and rule in node order, five for definitions; an edge that exists is
    skipped and does not count.
    """
    rules = F.broadcast(T.rule_table(nodes.sparkSession))
    room = _room(existing)
    useful = nodes.where(~F.col("is_noise"))
    src = useful.join(rules, useful["role"] == rules["src_role"]).select("doc", "page", "sec_key", F.col("node_id").alias("src"), F.col("node_seq").alias("src_seq"), F.col("role_confidence").alias("src_rc"), "rule_no", F.col("tgt_role").alias("role"), "relation", "cap")
    first = F.min("node_seq").over(W.partitionBy("doc", "role", "sec_key", "page"))
    tgt = useful.select("doc", "page", "sec_key", "role", F.col("node_id").alias("tgt"), F.col("node_seq").alias("tgt_seq"), F.col("role_confidence").alias("tgt_rc"), first.alias("bucket_seq"))
    most = T.DEFINITION_EDGES + room
    in_key = tgt.withColumn("k", F.row_number().over(W.partitionBy("doc", "role", "sec_key", "page").orderBy("tgt_seq"))).where(F.col("k") <= most).drop("k")
    in_page = tgt.withColumn("k", F.row_number().over(W.partitionBy("doc", "role", "page").orderBy("bucket_seq", "tgt_seq"))).where(F.col("k") <= most).drop("k")
    near = src.join(in_key, ["doc", "role", "sec_key", "page"])
    lone = src.join(in_key.select("doc", "role", "sec_key", "page").distinct(), ["doc", "role", "sec_key", "page"], "left_anti")
    far = lone.join(in_page.drop("sec_key"), ["doc", "role", "page"])
    out = _without(near.unionByName(far.select(near.columns)), existing)
    order = W.partitionBy("doc", "src", "rule_no").orderBy("bucket_seq", "tgt_seq")
    out = out.withColumn("k", F.row_number().over(order)).where("k <= cap")
    weight = F.greatest(r4(F.when(F.col("tgt_rc") > 0, (F.col("src_rc") + F.col("tgt_rc")) / 2).otherwise(F.col("src_rc"))), F.lit(0.1))
    zero = F.lit(0)
    out = out.select("doc", "src", "tgt", "relation", weight.alias("weight"), F.col("rule_no").alias("o1"), F.col("src_seq").alias("o2"), F.col("bucket_seq").alias("o3"), F.col("tgt_seq").alias("o4"), zero.alias("o5"))
    return _edges(out, 1, "semantic_role")


def co_section_edges(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Each definition to the first three others of its section."""
    room = _room(existing)
    own = nodes.where((F.col("role") == "Definition") & ~F.col("is_noise"))
    group = W.partitionBy("doc", "sec_key")
    own = own.select("doc", "sec_key", "node_id", "node_seq", "role_confidence", F.min("node_seq").over(group).alias("group_seq"), F.row_number().over(group.orderBy("node_seq")).alias("k"))
    tgt = own.where(F.col("k") <= T.CO_SECTION_EDGES + 1 + room).select("doc", "sec_key", F.col("node_id").alias("tgt"), F.col("node_seq").alias("tgt_seq"))
    out = own.withColumnRenamed("node_id", "src").join(tgt, ["doc", "sec_key"]).where("src <> tgt")
    out = _without(out, existing).withColumn("k", F.row_number().over(W.partitionBy("doc", "src").orderBy("tgt_seq"))).where(F.col("k") <= T.CO_SECTION_EDGES)
    zero = F.lit(0)
    weight = r4(F.greatest("role_confidence", F.lit(0.1)))
    out = out.select("doc", "src", "tgt", F.lit("co_section").alias("relation"), weight.alias("weight"), F.col("group_seq").alias("o1"), F.col("node_seq").alias("o2"), F.col("tgt_seq").alias("o3"), zero.alias("o4"), zero.alias("o5"))
    return _edges(out, 2, "co_section")


def contains_edges(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A section's heading to everything in it that is no title; an abstract contains itself."""
    zero = F.lit(0)
    out = nodes.where("section_id IS NOT NULL AND region_class <> 'title'").select("doc", F.col("section_id").alias("src"), F.col("node_id").alias("tgt"), F.lit("contains").alias("relation"), F.lit(1.0).alias("weight"), F.col("node_seq").alias("o1"), zero.alias("o2"), zero.alias("o3"), zero.alias("o4"), zero.alias("o5"))
    return _edges(_without(out, existing), 3, "section")


def build_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """All edges of all documents with ``edge_seq``, from 1 in each document.

    Each stage reads the edges before it twice, so they are written as they come.
    """
    edges = saved(multimodal_edges(nodes, links), "edges")
    for stage in (role_edges, co_section_edges, contains_edges):
        edges = edges.unionByName(saved(stage(nodes, edges), "edges"))
    return edges.withColumn("edge_seq", F.row_number().over(W.partitionBy("doc").orderBy("seq"))).drop("seq")


# Queries over the graph.


def reachable(edges: DataFrame, starts: DataFrame, relation: str, hops: int) -> DataFrame:
    """(doc, start, node_id, hop): nodes within some hops along one relation, without the start.

    One join for each hop, each anti-joined with what was seen before.
    """
    out_edges = edges.where(F.col("relation") == relation).select("doc", F.col("src").alias("at"), F.col("tgt").alias("node_id"))
    seen = front = starts.select("doc", F.col("node_id").alias("start"), "node_id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        step = front.select("doc", "start", F.col("node_id").alias("at")).join(out_edges, ["doc", "at"]).select("doc", "start", "node_id").distinct()
        front = step.join(seen, ["doc", "start", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def section_siblings(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    own = nodes.join(starts.select("doc", "node_id"), ["doc", "node_id"], "left_semi").where("section_id IS NOT NULL").select("doc", "section_id", F.col("node_id").alias("start"))
    return own.join(nodes.select("doc", "section_id", "node_id"), ["doc", "section_id"]).where("start <> node_id").select("doc", "start", "node_id")


def node_texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of wanted nodes, empty for unknown ones."""
    return wanted.select("node_id").join(nodes.select("node_id", "text"), "node_id", "left").select("node_id", F.coalesce("text", F.lit("")).alias("text"))


def induced_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of which both ends are among each query's nodes: chosen has (query_id, node_id)."""
    a = chosen.select("query_id", F.col("node_id").alias("src")).distinct()
    b = chosen.select("query_id", F.col("node_id").alias("tgt")).distinct()
    return edges.join(a, "src").join(b, ["query_id", "tgt"])


def explain_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A line for each edge: type[id] --relation--> type[id], ids cut to eight characters."""
    kind = nodes.select("node_id", "region_class")
    s, t = kind.toDF("src", "src_type"), kind.toDF("tgt", "tgt_type")
    name = lambda x: F.concat(F.col(f"{x}_type"), F.lit("["), F.substring(F.col(x).cast("string"), 1, 8), F.lit("]"))
    return edges.join(s, "src").join(t, "tgt").withColumn("explanation", F.concat(name("src"), F.lit(" --"), "relation", F.lit("--> "), name("tgt")))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("doc", F.col("src").alias("node_id")).unionByName(edges.select("doc", F.col("tgt").alias("node_id")))
    return nodes.select("doc", "node_id").join(ends, ["doc", "node_id"], "left_anti")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each document: nodes, edges, isolated nodes and the density of a directed graph."""
    n = nodes.groupBy("doc").agg(F.count("*").alias("n_nodes"), F.count_if(~F.col("is_noise")).alias("n_useful"))
    e = edges.groupBy("doc").agg(F.count("*").alias("n_edges"))
    i = isolated(nodes, edges).groupBy("doc").agg(F.count("*").alias("n_isolated"))
    out = n.join(e, "doc", "left").join(i, "doc", "left").na.fill(0)
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return out.withColumn("density", r4(F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0)))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_source", "relation").agg(F.count("*").alias("n"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Warnings of each document: no edges, more than 30 % isolated, more than 1000 edges, ends that don't exist."""
    known = nodes.select("doc", "node_id")
    ends = edges.select("doc", F.explode(F.array("src", "tgt")).alias("node_id"))
    loose = ends.join(known, ["doc", "node_id"], "left_anti").groupBy("doc").agg(F.count("*").alias("n_dangling"))
    out = summary(nodes, edges).join(loose, "doc", "left").na.fill(0)
    return out.select("doc", (F.col("n_edges") == 0).alias("no_edges"), (F.col("n_isolated") > 0.3 * F.col("n_nodes")).alias("many_isolated"), (F.col("n_edges") > 1000).alias("many_edges"), (F.col("n_dangling") > 0).alias("dangling"))


# Links between captions and figures or tables.


def typed_references(text: Column) -> Column:
    """Figure and table references of a text as array<struct<kind, num>>."""
    kinds, numbers = F.regexp_extract_all(text, F.lit(T.TYPED_REFERENCE), F.lit(1)), F.regexp_extract_all(text, F.lit(T.TYPED_REFERENCE), F.lit(2))
    pairs = F.transform(F.arrays_zip(kinds.alias("k"), numbers.alias("n")), lambda x: F.struct(F.when(F.lower(x["k"]).startswith("fig"), "figure").otherwise("table").alias("kind"), x["n"].cast("int").alias("num")))
    return F.coalesce(pairs, F.array().cast("array<struct<kind:string,num:int>>"))


def link_captions(regions: DataFrame, weight: float = T.REFERENCE_WEIGHT, top_k: int = T.LINKS_PER_CAPTION) -> DataFrame:
    """Each caption's best figures and tables of its document.

    The score is made of a reference part (1 on the same page, 0.3 elsewhere, where the caption names the
    target's kind) and the cosine of both vectors.
    """
    kind = F.when(F.col("region_class").isin(*T.FIGURE_CLASSES), "figure").otherwise("table")
    cap = regions.where("region_class = 'caption'").select("doc", F.col("node_id").alias("caption_id"), F.col("page").alias("cp"), typed_references(F.col("text")).alias("refs"), F.col("embedding").alias("ce"), F.col("node_seq").alias("cs"))
    tgt = regions.where(F.col("region_class").isin(*T.FIGURE_CLASSES, *T.TABLE_CLASSES)).select("doc", F.col("node_id").alias("target_id"), F.col("page").alias("tp"), kind.alias("tk"), F.col("embedding").alias("te"), F.col("node_seq").alias("ts"))
    named = F.exists("refs", lambda r: r["kind"] == F.col("tk"))
    packed = dict(regions.dtypes)["embedding"] == "binary"
    s_ref = F.when(named & (F.col("cp") == F.col("tp")), 1.0).when(named, 0.3).otherwise(0.0)
    n = F.sqrt(dot(F.col("ce"), F.col("ce"))) * F.sqrt(dot(F.col("te"), F.col("te")))
    s_emb = ((cosines(F.col("ce"), F.col("te")) if packed else F.when(n > 0, dot(F.col("ce"), F.col("te")) / n).otherwise(0.0)) + 1) / 2
    both = cap.join(tgt, "doc").withColumn("r", s_ref).withColumn("e", s_emb)
    both = both.select("doc", "caption_id", "target_id", "cs", "ts", r4(F.col("r")).alias("s_ref"), r4(F.col("e")).alias("s_emb"), r4(weight * F.col("r") + (1 - weight) * F.col("e")).alias("s_link"))
    rank = F.row_number().over(W.partitionBy("doc", "caption_id").orderBy(F.col("s_link").desc(), "ts"))
    out = both.withColumn("link_rank", rank).where(F.col("link_rank") <= top_k)
    return out.select("doc", "caption_id", "target_id", "s_ref", "s_emb", "s_link", "link_rank", (F.col("cs") * 1000 + F.col("link_rank")).alias("link_pos"))
