"""Text blocks of pages: filters, spans, styles, equations, page totals and OCR words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.scalar import area, char_share, md5_id, strip


def span_text(spans: Column) -> Column:
    """Stripped spans that hold anything, joined by single blanks."""
    return strip(F.array_join(F.filter(F.transform(spans, lambda s: strip(s["text"])), lambda t: t != ""), " "))


def dominant_style(spans: Column) -> Column:
    """The style of the span with the longest text, the first of equals; flag bits give bold and italic."""
    best = F.aggregate(spans, F.lit(None).cast("struct<text:string,font:string,size:double,flags:int,color:int>"), lambda a, s: F.when(a.isNull() | (F.length(s["text"]) > F.length(a["text"])), s).otherwise(a))
    return F.when(F.size(spans) > 0, F.struct(best["font"].alias("font_name"), best["size"].alias("font_size"), (best["flags"].bitwiseAND(16) != 0).alias("is_bold"), (best["flags"].bitwiseAND(2) != 0).alias("is_italic"), best["color"].alias("color")))


def guess_type(text: Column) -> Column:
    return F.when(char_share(text, T.EQUATION_CHARS) > T.EQUATION_SHARE, "equation").otherwise("text")


def block_id(doc: Column, page: Column, number: Column) -> Column:
    return md5_id(doc, "::p", page, "::b", F.coalesce(number, F.lit(0)))


def figure_id(doc: Column, strategy: str, page: Column, seq: Column) -> Column:
    return md5_id(doc, f"::fig::{strategy}::p", page, "::s", seq)


def doc_id_of(path: Column) -> Column:
    """A document's id from its file name: other signs than letters, digits, - and _ become _, 40 characters at most."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), 1, 40)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def extract(raw: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text blocks of raw page blocks (type 0) of enough area whose spans hold any text.

    raw: doc_id, page_index, type, number, bbox, spans array<struct<text, font, size, flags, color>>.
    """
    out = raw.where((F.col("type") == 0) & (area(F.col("bbox")) >= T.MIN_BLOCK_AREA)).withColumn("text", span_text(F.col("spans"))).where("text <> ''")
    return out.select(doc, "page_index", block_id(F.col(doc), F.col("page_index"), F.col("number")).alias("block_id"), "text", "bbox", dominant_style(F.col("spans")).alias("style"), guess_type(F.col("text")).alias("block_type"), F.lit("embedded").alias("extraction_method"), F.lit(1.0).alias("confidence"), F.coalesce("number", F.lit(0)).alias("raw_block_no"))


def raster_figures(raw: DataFrame, doc: str = "doc_id") -> DataFrame:
    out = raw.where((F.col("type") == 1) & (area(F.col("bbox")) >= T.MIN_BLOCK_AREA))
    return out.select(doc, "page_index", block_id(F.col(doc), F.col("page_index"), F.col("number")).alias("block_id"), "bbox", F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("caption"))


def page_stats(blocks: DataFrame, pages: DataFrame | None = None, threshold: int = T.OCR_CHARS) -> DataFrame:
    """Characters and blocks of each page, and whether it has too few characters and goes to OCR.

    ``pages`` adds pages without any block.
    """
    keys = ["doc_id", "page_index"]
    out = blocks.groupBy(*keys).agg(F.sum(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("n_blocks"))
    if pages is not None:
        out = pages.select(*keys).join(out, keys, "left").na.fill(0, ["n_chars", "n_blocks"])
    out = out.withColumn("ocr_triggered", F.col("n_chars") < threshold)
    return out.withColumn("method", F.when(F.col("ocr_triggered"), "ocr").otherwise("embedded"))


def document_stats(pages: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    out = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_blocks").alias("n_blocks"), F.count_if("ocr_triggered").alias("n_ocr_pages"))
    out = out.withColumn("n_embedded_pages", F.col("n_pages") - F.col("n_ocr_pages"))
    if figures is not None:
        out = out.join(figures.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_figures")), "doc_id", "left").na.fill(0, ["n_figures"])
    return out


def group_ocr_words(words: DataFrame) -> DataFrame:
    """Blocks of recognised words: (doc_id, page_index, block_num, text, confidence, bbox).

    words: doc_id, page_index, block_num, word_no, text, conf, left, top, width, height in pixels and the
    scale to points. Blank words and those with a negative confidence go.
    """
    use = words.where((strip(F.col("text")) != "") & (F.col("conf") >= 0))
    s = F.col("scale")
    return use.groupBy("doc_id", "page_index", "block_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.avg("conf").alias("confidence"),
        F.struct(F.min(F.col("left") * s).alias("x0"), F.min(F.col("top") * s).alias("y0"), F.max((F.col("left") + F.col("width")) * s).alias("x1"), F.max((F.col("top") + F.col("height")) * s).alias("y1")).alias("bbox"),
    )
