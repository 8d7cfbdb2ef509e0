"""Domain tables from the star-schema test tables, by arithmetic that any engine repeats.

Nodes stand for layout regions: a document has 100 of them on two pages, with classes, roles and
positions from the id. Texts come from the documents table, vectors from the embeddings table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions.scalar import box

CLASSES = ("title", "abstract", "header", "footer", "caption", "figure", "table", "list", "paragraph", "reference")
LABEL_ROLES = ("Definition", "Method", "Result", "Observation", "Dataset", "N/A")
PAGE_W, PAGE_H = 640.0, 842.0
#: What a block's text begins with, by the first number that divides doc_id * 7 + its line.
PREFIXES = ((23, "Table 3. "), (29, "Figure 1: "), (31, "[12] "), (37, "2. "), (41, "- "), (43, "∑∫αβ∑∫αβ∑∫αβ∑∫αβ "))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int") + 1)


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, T.INDEX_CHARS).alias("text"))
    v = F.col("vec_id")
    kind = _pick(CLASSES, v % 10)
    kind = F.when((kind == "title") & (v % 20 != 0), "paragraph").when((kind == "abstract") & (v % 50 != 21), "paragraph").otherwise(kind)
    role = F.when(F.col("region_class").isin("figure", "table"), "N/A").otherwise(_pick(LABEL_ROLES, F.col("label") % 6))
    out = e.join(d, "vec_id", "left").withColumn("region_class", kind)
    return out.select(
        v.alias("node_id"),
        _div(v, 100).alias("doc"),
        _div(v % 100, 50).cast("int").alias("page"),
        (((v * 37) % 80) * 10.0).alias("y0"),
        "region_class",
        role.alias("role"),
        (((v * 7919) % 10000) / 10000.0).alias("role_confidence"),
        F.when(F.col("region_class") == "figure", 0.95).otherwise(0.8).alias("confidence"),
        "text",
        "embedding",
        v.alias("node_seq"),
    )


def links_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose captions name a figure or a table, as (doc, region_id, ..., text, region_pos)."""
    v = F.col("node_id")
    said = F.concat(F.when(v % 20 < 10, "Figure ").otherwise("Table "), (v % 3).cast("string"), F.lit(". Text"))
    return nodes(spark, sf_dir).withColumn("text", F.when(F.col("region_class") == "caption", said).otherwise(F.col("text")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text block for each line of a document, twelve to a page in two columns."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where("text <> ''")
    turn = F.col("doc_id") * 7 + F.col("pos")
    said = F.lit("")
    for n, words in reversed(PREFIXES):  # so that every rule finds something
        said = F.when(turn % n == 0, words).otherwise(said)
    d = d.withColumn("text", F.concat(said, "text"))
    n, k, row = F.length("text"), F.col("pos") % 2, F.col("pos") % 12
    x0, y0 = 20.0 + 290.0 * k, 30.0 + 62.0 * row
    b = box(x0, y0, x0 + F.least(F.lit(250.0), 4.0 * n), y0 + 12.0 * (1 + F.floor(n / 60)))
    return d.select(
        "doc_id",
        F.floor(F.col("pos") / 12).cast("int").alias("page_index"),
        F.col("pos").cast("int").alias("block_pos"),
        F.concat_ws("-", "doc_id", "pos").alias("block_id"),
        "text",
        b.alias("bbox"),
        (9.0 + n % 5).alias("font_size"),
        (n % 7 == 0).alias("is_bold"),
        F.lit(PAGE_W).alias("page_width"),
        F.lit(PAGE_H).alias("page_height"),
    )


def detections(regions: DataFrame) -> DataFrame:
    """A second detector's regions: every third one missing, the others moved a little and often only paragraphs."""
    j = ((F.col("doc_id") * 31 + F.col("region_pos") * 17) % 11 - 5).cast("double")
    b = F.col("bbox")
    kind = F.when((F.col("doc_id") + F.col("region_pos")) % 2 == 0, "paragraph").otherwise(F.col("region_class"))
    return regions.where((F.col("doc_id") + F.col("region_pos")) % 3 != 0).select(
        "doc_id", "page_index", "region_pos", F.concat(F.lit("m"), "region_id").alias("region_id"), kind.alias("region_class"), box(b["x0"] + j, b["y0"] + j, b["x1"] + j, b["y1"] + j).alias("bbox"), F.lit(0.9).alias("confidence"), F.lit("detector").alias("backend"), F.lit(None).cast("string").alias("text_content"), F.array().cast("array<string>").alias("source_block_ids")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 50 as a query, with one of the fixed questions; every other one asks for its own role."""
    v = F.col("vec_id")
    role = _pick(LABEL_ROLES, F.col("label") % 6)
    text = _pick(tuple(q[0] for q in T.EVAL_QUERIES), _div(v, 50) % len(T.EVAL_QUERIES))
    return read(spark, sf_dir, "embeddings").where(v % 50 == 0).select(v.alias("query_id"), text.alias("query"), F.col("embedding").alias("qvec"), F.when((v % 100 == 0) & (role != "N/A"), role).alias("role_filter"))
