"""Documents as JSON, graphs as GraphML or node and link tables, indexes as Parquet.

All readers give defaults for what a file lacks; broken JSON gives no rows.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tables as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
STYLE = "struct<font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,color:int>"
TEXT_BLOCK = f"struct<block_id:string,text:string,bbox:{BOX},page_index:int,style:{STYLE},block_type:string,extraction_method:string,confidence:double,raw_block_no:int>"
FIGURE_BLOCK = f"struct<block_id:string,bbox:{BOX},page_index:int,image_path:string,caption:string>"
EXTRACTION = f"doc_id string, source_path string, total_pages int, pages array<struct<page_index:int,width:double,height:double,text_blocks:array<{TEXT_BLOCK}>,figure_blocks:array<{FIGURE_BLOCK}>,extraction_method:string,ocr_triggered:boolean>>"
REGION = f"struct<region_id:string,region_class:string,bbox:{BOX},page_index:int,confidence:double,backend:string,text_content:string,source_block_ids:array<string>>"
LAYOUT = f"doc_id string, source_path string, total_pages int, pages array<struct<page_index:int,width:double,height:double,backend:string,regions:array<{REGION}>>>"
SEMANTIC_REGION = f"struct<region_id:string,region_class:string,text_content:string,bbox:{BOX},page_index:int,scholarly_role:string,role_confidence:double,confidence:double,backend:string,source_block_ids:array<string>>"
LINK = "struct<caption_id:string,target_id:string,s_ref:double,s_emb:double,s_link:double,matched_refs:array<struct<kind:string,num:int>>>"
SEMANTIC = f"doc_id string, semantic_regions array<{SEMANTIC_REGION}>, multimodal_links array<{LINK}>"


ALIGNMENT = "doc_id long, alignments array<struct<page_index:int,block_pos:int,block_id:string,region_id:string,region_class:string,score:double,flagged:boolean>>, unassigned array<string>"


def _read(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files of one document each or, with ``lines``, of one in each line, as write_json() makes them."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def read_extraction(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _read(spark, path, EXTRACTION, lines)


def text_blocks(extraction: DataFrame) -> DataFrame:
    """One row per text block with its page's size; block_pos counts a page's blocks."""
    p = extraction.select("doc_id", F.explode("pages").alias("p"))
    b = p.select("doc_id", F.col("p.page_index"), F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.posexplode("p.text_blocks").alias("block_pos", "b"))
    style = F.col("b.style")
    return b.select("doc_id", "page_index", "block_pos", "page_width", "page_height", F.col("b.block_id"), F.coalesce("b.text", F.lit("")).alias("text"), F.col("b.bbox"), style["font_size"].alias("font_size"), F.coalesce(style["is_bold"], F.lit(False)).alias("is_bold"), F.coalesce("b.block_type", F.lit("text")).alias("block_type"), F.coalesce("b.extraction_method", F.lit("embedded")).alias("extraction_method"), F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"))


def figure_blocks(extraction: DataFrame) -> DataFrame:
    p = extraction.select("doc_id", F.explode("pages").alias("p"))
    b = p.select("doc_id", F.col("p.page_index"), F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.posexplode("p.figure_blocks").alias("block_pos", "b"))
    return b.select("doc_id", "page_index", "block_pos", "page_width", "page_height", "b.block_id", "b.bbox", "b.image_path", "b.caption")


def read_layout(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _read(spark, path, LAYOUT, lines)


def regions(layout: DataFrame) -> DataFrame:
    p = layout.select("doc_id", F.explode("pages").alias("p"))
    r = p.select("doc_id", F.col("p.page_index").alias("page"), F.col("p.width").alias("page_width"), F.posexplode("p.regions").alias("region_pos", "r"))
    d = lambda c, v: F.coalesce(f"r.{c}", F.lit(v)).alias(c)
    return r.select("doc_id", F.coalesce("r.page_index", "page").alias("page_index"), "page_width", "region_pos", F.col("r.region_id"), d("region_class", "unknown"), F.col("r.bbox"), d("confidence", 1.0), d("backend", "heuristic"), F.col("r.text_content"), F.coalesce("r.source_block_ids", F.array().cast("array<string>")).alias("source_block_ids"))


def read_semantic(spark: SparkSession, path: str, required: bool = False, lines: bool = False) -> DataFrame:
    """With ``required``, documents without regions are an error, as an index can't be made of them."""
    out = _read(spark, path, SEMANTIC, lines)
    if required and not out.where(F.size(F.coalesce("semantic_regions", F.array())) > 0).head(1):
        raise ValueError("no semantic regions")
    return out


def semantic_nodes(semantic: DataFrame) -> DataFrame:
    """Graph nodes of semantic documents."""
    r = semantic.select(F.col("doc_id").alias("doc"), F.posexplode("semantic_regions").alias("node_seq", "r"))
    return r.select("doc", "node_seq", F.col("r.region_id").alias("node_id"), F.coalesce("r.region_class", F.lit("")).alias("region_class"), F.coalesce("r.text_content", F.lit("")).alias("text"), F.coalesce("r.page_index", F.lit(0)).alias("page"), F.coalesce("r.bbox.y0", F.lit(0.0)).alias("y0"), F.coalesce("r.scholarly_role", F.lit("N/A")).alias("role"), F.coalesce("r.role_confidence", F.lit(0.0)).alias("role_confidence"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"))


def semantic_links(semantic: DataFrame) -> DataFrame:
    x = semantic.select(F.col("doc_id").alias("doc"), F.posexplode("multimodal_links").alias("link_pos", "l"))
    return x.select("doc", "link_pos", "l.caption_id", "l.target_id", "l.s_ref", "l.s_emb", "l.s_link", "l.matched_refs")


def page_blocks(extraction: DataFrame, page_index: int) -> DataFrame:
    """Text blocks of one page of each document, the first that has this number."""
    first = extraction.select("doc_id", F.filter("pages", lambda p: p["page_index"] == page_index).alias("pages"))
    return text_blocks(first.withColumn("pages", F.slice("pages", 1, 1)))


def evaluation_nodes(semantic: DataFrame, most: int = 300) -> DataFrame:
    """(doc, node_id, role, text): what an evaluation needs of semantic documents, texts cut."""
    r = semantic.select(F.col("doc_id").alias("doc"), F.explode("semantic_regions").alias("r"))
    return r.select("doc", F.coalesce("r.region_id", F.lit("")).alias("node_id"), F.coalesce("r.scholarly_role", F.lit("N/A")).alias("role"), F.substring(F.coalesce("r.text_content", F.lit("")), 1, most).alias("text"))


def _pages(rows: DataFrame, item: Column, name: str, order: str) -> DataFrame:
    per_page = rows.groupBy("doc_id", "page_index").agg(F.first("page_width").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))), lambda x: x["v"]).alias(name))
    return per_page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "width", name))).alias("pages")).withColumn("total_pages", F.size("pages"))


def layout_documents(region_rows: DataFrame, order: str = "region_pos") -> DataFrame:
    """Regions put together to one document per row, ready to be written as JSON."""
    item = F.struct("region_id", "region_class", "bbox", "page_index", "confidence", "backend", "text_content", "source_block_ids")
    return _pages(region_rows, item, "regions", order)


def extraction_documents(blocks: DataFrame, figures: DataFrame | None = None, threshold: int = T.OCR_CHARS) -> DataFrame:
    """Text and figure blocks put together to one document per row, ready to be written as JSON.

    blocks: doc_id, page_index, block_pos, block_id, text, bbox, page_width, page_height and, where known, style,
    block_type, extraction_method, confidence and raw_block_no.
    """
    have = lambda c, t, v=None: (F.col(c) if c in blocks.columns else F.lit(v)).cast(t).alias(c)
    style = F.struct(F.lit(None).cast("string").alias("font_name"), *(have(c, t) for c, t in (("font_size", "double"), ("is_bold", "boolean"), ("is_italic", "boolean"))), F.lit(None).cast("int").alias("color"))
    style = F.col("style") if "style" in blocks.columns else style
    text = F.struct(F.col("block_id").cast("string").alias("block_id"), "text", "bbox", "page_index", style.alias("style"), have("block_type", "string", "text"), have("extraction_method", "string", "embedded"), have("confidence", "double", 1.0), have("raw_block_no", "int", 0))
    rows = blocks.select("doc_id", "page_index", "block_pos", "page_width", "page_height", text.alias("t"), F.lit(None).cast(FIGURE_BLOCK).alias("f"))
    if figures is not None:
        f = F.struct(F.col("block_id").cast("string").alias("block_id"), "bbox", "page_index", F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("caption"))
        rows = rows.unionByName(figures.select("doc_id", "page_index", "block_pos", "page_width", "page_height", F.lit(None).cast(TEXT_BLOCK).alias("t"), f.alias("f")))
    ordered = lambda c: F.transform(F.filter("all", lambda x: x[c].isNotNull()), lambda x: x[c])
    page = rows.groupBy("doc_id", "page_index").agg(F.first("page_width").alias("width"), F.first("page_height").alias("height"), F.array_sort(F.collect_list(F.struct("block_pos", "t", "f"))).alias("all"))
    page = page.select("doc_id", "page_index", "width", "height", ordered("t").alias("text_blocks"), ordered("f").alias("figure_blocks"))
    chars = F.aggregate("text_blocks", F.lit(0), lambda n, b: n + F.length(b["text"]))
    page = page.withColumn("ocr_triggered", chars < threshold).withColumn("extraction_method", F.when(F.col("ocr_triggered"), "ocr").otherwise("embedded"))
    item = F.struct("page_index", "width", "height", "text_blocks", "figure_blocks", "extraction_method", "ocr_triggered")
    return page.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("pages")).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("source_path"), F.size("pages").alias("total_pages"), "pages")


def semantic_documents(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Regions with roles, and links, put together to one document per row; vectors are left out.

    nodes: doc, node_seq, node_id, region_class, text, page, role, role_confidence, confidence, and a box or its y0.
    """
    have = lambda c, o: F.col(c) if c in nodes.columns else o
    zero = F.lit(0.0)
    box = have("bbox", F.struct(zero.alias("x0"), F.col("y0").alias("y0"), zero.alias("x1"), F.col("y0").alias("y1")))
    item = F.struct(F.col("node_id").cast("string").alias("region_id"), "region_class", F.col("text").alias("text_content"), box.alias("bbox"), F.col("page").alias("page_index"), F.col("role").alias("scholarly_role"), "role_confidence", "confidence", have("backend", F.lit("heuristic")).alias("backend"), have("source_block_ids", F.array().cast("array<string>")).alias("source_block_ids"))
    listed = lambda order, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("v")))), lambda y: y["v"])
    out = nodes.groupBy("doc").agg(listed("node_seq", item).alias("semantic_regions"))
    none = F.array().cast(f"array<{LINK}>")
    if links is None:
        out = out.withColumn("multimodal_links", none)
    else:
        refs = F.col("matched_refs") if "matched_refs" in links.columns else F.lit(None).cast("array<struct<kind:string,num:int>>")
        link = F.struct(F.col("caption_id").cast("string").alias("caption_id"), F.col("target_id").cast("string").alias("target_id"), "s_ref", "s_emb", "s_link", refs.alias("matched_refs"))
        out = out.join(links.groupBy("doc").agg(listed("link_pos", link).alias("multimodal_links")), "doc", "left").withColumn("multimodal_links", F.coalesce("multimodal_links", none))
    return out.select(F.col("doc").cast("string").alias("doc_id"), "semantic_regions", "multimodal_links")


def report_documents(per_query: DataFrame, reports: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row: means by system and k, rows by query, and the difference of the systems."""
    means = reports.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("k", *(c for c in reports.columns if c not in ("system", "k"))))).alias("by_k"))
    rows = per_query.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("query_id", "k", *(c for c in per_query.columns if c not in ("system", "query_id", "k"))))).alias("per_query"))
    systems = means.join(rows, "system").agg(F.array_sort(F.collect_list(F.struct("system", "by_k", "per_query"))).alias("systems"))
    return systems.crossJoin(deltas.agg(F.array_sort(F.collect_list(F.struct("k", *(c for c in deltas.columns if c != "k")))).alias("delta")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def alignment_documents(alignment: DataFrame, unassigned: DataFrame) -> DataFrame:
    a = alignment.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "block_pos", "block_id", "region_id", "region_class", "score", "flagged"))).alias("alignments"))
    u = unassigned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("block_id").cast("string"))).alias("unassigned"))
    none = F.array().cast("array<struct<page_index:int,block_pos:int,block_id:string,region_id:string,region_class:string,score:double,flagged:boolean>>")
    return a.join(u, "doc_id", "full").select("doc_id", F.coalesce("alignments", none).alias("alignments"), F.coalesce("unassigned", F.array().cast("array<string>")).alias("unassigned"))


def write_index(index: DataFrame, path: str, kind: str = "exact", centroids: np.ndarray | None = None, folders: bool = True) -> None:
    """The index with its kind, and its lists' centroids if it has any; lists are partitions of the table, or without
    ``folders`` a column like others."""
    out = index.withColumn("index_kind", F.lit(kind))
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("list") if folders and "list" in out.columns else writer).parquet(f"{path}/rows")
    rows = [(k, c.tolist()) for k, c in enumerate(centroids if centroids is not None else [])]
    index.sparkSession.createDataFrame(rows, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray | None]:
    """The index and its centroids (None for an exact one); it is an error if either part is missing."""
    rows = spark.read.parquet(f"{path}/rows")
    got = sorted((r["list"], r["centroid"]) for r in spark.read.parquet(f"{path}/centroids").collect())
    return rows, np.array([c for _, c in got]) if got else None


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


NODE_LINK = (
    "doc string, directed boolean, multigraph boolean, nodes array<struct<id:string,type:string,role:string,page:int,text:string,confidence:double,role_confidence:double,bbox_y0:double,section_id:string,is_noise:boolean,seq:long>>, "
    "links array<struct<source:string,target:string,relation:string,weight:double,edge_source:string,seq:long>>"
)


def node_link_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each document's graph as one row of nodes and links, ready to be written as JSON."""
    text = lambda c: F.col(c).cast("string")
    n = F.struct(F.col("node_seq").cast("long").alias("seq"), text("node_id").alias("id"), F.col("region_class").alias("type"), "role", F.col("page").cast("int").alias("page"), "text", "confidence", "role_confidence", F.col("y0").alias("bbox_y0"), text("section_id").alias("section_id"), "is_noise")
    e = F.struct(F.col("edge_seq").cast("long").alias("seq"), text("src").alias("source"), text("tgt").alias("target"), "relation", "weight", "edge_source")
    out = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(n)).alias("nodes"))
    links = edges.groupBy("doc").agg(F.array_sort(F.collect_list(e)).alias("links"))
    out = out.join(links, "doc", "left")
    return out.select(text("doc").alias("doc"), F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", F.coalesce("links", F.array().cast("array<struct<seq:long,source:string,target:string,relation:string,weight:double,edge_source:string>>")).alias("links"))


def read_node_link(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of such files, with defaults for what a node lacks."""
    docs = _read(spark, path, NODE_LINK, lines)
    n = docs.select("doc", F.posexplode("nodes").alias("pos", "n"))
    d = lambda c, v, name: F.coalesce(f"n.{c}", F.lit(v)).alias(name)
    nodes = n.select("doc", F.col("n.id").alias("node_id"), d("type", "", "region_class"), d("role", "N/A", "role"), d("page", 0, "page"), d("text", "", "text"), d("confidence", 1.0, "confidence"), d("role_confidence", 0.0, "role_confidence"), d("bbox_y0", 0.0, "y0"), F.col("n.section_id"), d("is_noise", False, "is_noise"), F.coalesce("n.seq", F.col("pos").cast("long")).alias("node_seq"))
    e = docs.select("doc", F.posexplode("links").alias("pos", "l"))
    edges = e.select("doc", F.col("l.source").alias("src"), F.col("l.target").alias("tgt"), "l.relation", F.coalesce("l.weight", F.lit(1.0)).alias("weight"), F.coalesce("l.edge_source", F.lit("")).alias("edge_source"), F.coalesce("l.seq", F.col("pos").cast("long")).alias("edge_seq"))
    return nodes, edges


def _plain(v) -> str:
    return "" if v is None else json.dumps([x.asDict() if hasattr(x, "asDict") else x for x in v]) if isinstance(v, (list, tuple)) else str(v)


def graphml(nodes: DataFrame, edges: DataFrame, doc, node_columns: list[str], edge_columns: list[str], most: int = 100_000) -> str:
    """One document's graph as GraphML; a document of more than ``most`` nodes or edges is an error."""
    n = nodes.where(F.col("doc") == doc).orderBy("node_seq").select("node_id", *node_columns).limit(most + 1).collect()
    e = edges.where(F.col("doc") == doc).orderBy("edge_seq").select("src", "tgt", *edge_columns).limit(most + 1).collect()
    if len(n) > most or len(e) > most:
        raise ValueError("the document's graph is too large for one file")
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'  <key id="{f}_{c}" for="{f}" attr.name="{c}" attr.type="string"/>' for f, cs in (("node", node_columns), ("edge", edge_columns)) for c in cs]
    out.append('  <graph edgedefault="directed">')
    data = lambda f, r, cs: "".join(f'<data key="{f}_{c}">{escape(_plain(r[c]))}</data>' for c in cs)
    out += [f"    <node id={quoteattr(str(r.node_id))}>{data('node', r, node_columns)}</node>" for r in n]
    out += [f"    <edge source={quoteattr(str(r.src))} target={quoteattr(str(r.tgt))}>{data('edge', r, edge_columns)}</edge>" for r in e]
    return "\n".join([*out, "  </graph>", "</graphml>"])
