"""Layout classes of blocks: page context, then one ordered CASE; and the spatial joins of regions.

Everything is local to a page, so all joins are equi-joins on (doc_id, page_index).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tables as T
from ..functions.scalar import BLANKS, char_share, iou, md5_id, overlap_score, r4, strip, width

PAGE = ("doc_id", "page_index")
DIGITS = "0123456789"


def page_median_font(blocks: DataFrame) -> DataFrame:
    """The upper median of a page's font sizes, 11 where there is none."""
    sizes = F.sort_array(F.collect_list("font_size"))
    return blocks.groupBy(*PAGE).agg(sizes.alias("s")).select(*PAGE, F.coalesce(F.try_element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")), F.lit(11.0)).alias("median_font"))


def page_context(blocks: DataFrame) -> DataFrame:
    """Adds median_font and near_table_caption, from all blocks of the page at once.

    The page's sizes and captions are arrays of a window, so that blocks are shuffled once, by page, and never
    multiply; whatever else needs the page (a position in it) finds them there.
    """
    b, page = F.col("bbox"), W.partitionBy(*PAGE)
    said = strip(F.col("text"))
    caption = F.when(_begins(said, "tT") & said.rlike(T.TABLE_CAPTION), F.struct(b["y0"].alias("y0"), b["y1"].alias("y1")))
    out = blocks.select("*", F.sort_array(F.collect_list("font_size").over(page)).alias("_sizes"), F.collect_list(caption).over(page).alias("_caps"))
    middle = F.try_element_at("_sizes", (F.floor(F.size("_sizes") / 2) + 1).cast("int"))
    near = F.exists("_caps", lambda c: (b["y0"] > c["y0"]) & (b["y0"] - c["y1"] < 40))
    return out.withColumn("median_font", F.coalesce(middle, F.lit(11.0))).withColumn("near_table_caption", F.coalesce(near, F.lit(False))).drop("_sizes", "_caps")


def near_table_caption(blocks: DataFrame) -> DataFrame:
    """Blocks that begin below a table's caption, at most 40 points under it."""
    return page_context(blocks).drop("median_font")


def _begins(text: Column, letters: str) -> Column:
    """Whether the first letter is one of these: a cheap look before a pattern that only fits at the start."""
    return F.left(text, F.lit(1)).isin(*letters)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")


def is_table(text: Column, near_caption: Column) -> Column:
    def data_row(line: Column) -> Column:
        tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
        return (F.size(tokens) >= 3) & F.exists(tokens, lambda t: t.rlike(T.NUMERIC_TOKEN)) & F.forall(tokens, lambda t: F.length(t) <= 15)

    lines = _lines(text)
    grid = F.size(F.filter(lines, lambda x: x.rlike(T.TABLE_ROW)))
    several = text.contains("\n")  # most blocks are one line, which can't have two rows
    return text.rlike(r"\S") & ((several & ((grid >= 2) | (F.size(F.filter(lines, data_row)) >= 2))) | near_caption)


def is_reference(text: Column, bold: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    return (_begins(text, "[" + BLANKS) & text.rlike(T.REFERENCE_BRACKET)) | (_begins(text, DIGITS) & text.rlike(T.REFERENCE_NUMBERED) & ~(bold & (words <= 8)))


def is_list(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    bullets = F.size(F.filter(lines, lambda x: x.rlike(T.BULLET)))
    return F.when(text.contains("\n"), bullets >= 2).otherwise(_begins(text, BLANKS + "-•◦▪▸*" + DIGITS) & text.rlike(T.BULLET))


def classify(blocks: DataFrame) -> DataFrame:
    """Adds region_class. Blocks have text, bbox, font_size, is_bold, page_height, page_index, and the page's context."""
    blocks = blocks.withColumn("_text", strip(F.col("text")))  # once, not in each rule
    text, b, h = F.col("_text"), F.col("bbox"), F.col("page_height")
    median, page = F.col("median_font"), F.col("page_index")
    size = F.when(F.coalesce("font_size", F.lit(0.0)) == 0, median).otherwise(F.col("font_size"))
    bold = F.coalesce("is_bold", F.lit(False))
    short, numbered = F.length(text) < 150, _begins(text, "IVX" + DIGITS) & text.rlike(T.SECTION_NUMBER)
    heading = short & ((bold & numbered) | (bold & (size >= median * 1.15)) | ((size >= median * 1.20) & numbered))
    out = (
        F.when(bold & (size >= median * 1.4) & (b["y0"] < h * 0.40) & (page <= 1) & short, "title")
        .when(b["y1"] <= h * 0.09, "header")
        .when((b["y0"] >= h - h * 0.10) | ((b["y0"] >= h * 0.85) & text.rlike(T.PAGE_NUMBER) & (width(b) <= 50)), "footer")
        .when(_begins(text, "fFtTaA") & text.rlike(T.CAPTION), "caption")
        .when(char_share(text, T.MATH_CHARS) > 0.06, "equation")
        .when((page <= 1) & _begins(text, "aA") & text.rlike(T.ABSTRACT), "abstract")
        .when(heading, "title")
        .when(is_table(text, F.col("near_table_caption")), "table")
        .when(is_reference(text, bold), "reference")
        .when(F.lower(F.left(text, F.lit(9))).startswith("algorithm") & (F.length(text) > 30), "algorithm")
        .when(is_list(text), "list")
        .otherwise("paragraph")
    )
    return blocks.withColumn("region_class", out).drop("_text")


def region_id(doc: Column, page: Column, seq: Column, source: str = "layout") -> Column:
    return md5_id(doc, f"::{source}::p", page, "::r", seq)


def detect(blocks: DataFrame, figures: DataFrame | None = None, by_document: bool = False) -> DataFrame:
    """Regions of all pages: classified blocks in their order, then figures. Blocks are shuffled once, by page, or by
    document where later steps of the same plan need all of a document.

    The order of reading is a step of its own (pages.reading_order).
    """
    late = F.lit(0).alias("late")
    rows = blocks.select(*PAGE, F.col("block_pos").alias("pos"), late, "text", "bbox", "font_size", "is_bold", F.col("block_id").cast("string").alias("block_id"), "page_width", "page_height")
    if figures is not None:  # they have no text or size, so the page's median and captions are those of its blocks
        rows = rows.unionByName(figures.select(*PAGE, F.col("block_pos").alias("pos"), F.lit(1).alias("late"), "bbox", F.col("block_id").cast("string").alias("block_id"), "page_width", "page_height"), allowMissingColumns=True)
    rows = page_context(rows.repartition("doc_id") if by_document else rows).withColumn("region_pos", F.row_number().over(W.partitionBy(*PAGE).orderBy("late", "pos")) - 1)
    figure = F.col("late") == 1
    rows = classify(rows).withColumn("region_class", F.when(figure, "figure").otherwise(F.col("region_class")))
    return rows.select(
        *PAGE,
        "region_class",
        "bbox",
        F.when(figure, 0.95).otherwise(0.8).alias("confidence"),
        F.col("text").alias("text_content"),
        F.array("block_id").alias("source_block_ids"),
        "page_width",
        "page_height",
        "region_pos",
        region_id(F.col("doc_id"), F.col("page_index"), F.col("region_pos")).alias("region_id"),
        F.lit("heuristic").alias("backend"),
    )


def class_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region_class").agg(F.count(F.lit(1)).alias("n"))


BACKENDS = ("auto", "heuristic", "external")


def resolve_backend(backend: str, detector=None) -> str:
    """``auto`` is the external detector where one is given and the rules where none is. Other names, and an external
    backend without a detector, are errors."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}: one of {', '.join(BACKENDS)}")
    if backend == "external" and detector is None:
        raise ValueError("the external backend needs a detector")
    return "heuristic" if backend == "heuristic" or detector is None else "external"


def detect_with(blocks: DataFrame, backend: str = "auto", detector: Callable[[Iterator], Iterator] | None = None, pages: DataFrame | None = None, threshold: float = 0.5, figures: DataFrame | None = None) -> DataFrame:
    """Regions by rules, or fused with those of an external detector (a function of Arrow batches of pages).

    The detector gives doc_id, page_index, region_pos, region_class, x0..y1 and confidence; rows below the
    threshold go. A page on which it finds nothing has the regions by rules.
    """
    rules = detect(blocks, figures)
    if resolve_backend(backend, detector) == "heuristic":
        return rules
    found = pages.mapInArrow(detector, "doc_id long, page_index int, region_pos int, region_class string, x0 double, y0 double, x1 double, y1 double, confidence double").where(F.col("confidence") >= threshold)
    found = found.select("*", F.struct("x0", "y0", "x1", "y1").alias("bbox"), region_id(F.col("doc_id"), F.col("page_index"), F.col("region_pos"), "ml").alias("region_id"), F.lit("external").alias("backend"), F.lit(None).cast("string").alias("text_content"), F.array().cast("array<string>").alias("source_block_ids"))
    return fuse(found, rules)


def fuse(detected: DataFrame, rules: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Detected regions with the text of their best match by rules, and all rule regions nobody matched.

    The more specific class wins: where that is the rules', the confidence is the mean of both. One rule
    region can serve several detected ones. (y0, x0) orders a page's fused regions.
    """
    keys = list(PAGE)
    rank = F.create_map(*(F.lit(x) for kv in T.SPECIFICITY.items() for x in kv))
    special = lambda c: F.coalesce(rank[F.col(c)], F.lit(0))
    d = detected.select(*keys, F.col("region_pos").alias("d_pos"), F.col("region_id").alias("d_id"), F.col("region_class").alias("d_class"), F.col("bbox").alias("d_box"), F.col("confidence").alias("d_conf"), F.col("backend").alias("d_backend"), F.col("text_content").alias("d_text"), F.col("source_block_ids").alias("d_ids"))
    r = rules.select(*keys, F.col("region_pos").alias("r_pos"), F.col("region_class").alias("r_class"), F.col("bbox").alias("r_box"), F.col("confidence").alias("r_conf"), F.col("text_content").alias("r_text"), F.col("source_block_ids").alias("r_ids"))
    pairs = d.join(r, keys).withColumn("iou", iou(F.col("d_box"), F.col("r_box"))).where(F.col("iou") >= threshold)
    best = pairs.withColumn("k", F.row_number().over(W.partitionBy(*keys, "d_pos").orderBy(F.col("iou").desc(), "r_pos"))).where("k = 1")
    best = best.select(*keys, "d_pos", "r_pos", "r_class", "r_conf", "r_text", "r_ids")
    out = d.join(best, [*keys, "d_pos"], "left")
    matched, finer = F.col("r_pos").isNotNull(), special("r_class") > special("d_class")
    fused = out.select(
        *keys,
        F.col("d_id").alias("region_id"),
        F.when(matched & finer, F.col("r_class")).otherwise(F.col("d_class")).alias("region_class"),
        F.col("d_box").alias("bbox"),
        F.when(matched & finer, (F.col("d_conf") + F.col("r_conf")) / 2).otherwise(F.col("d_conf")).alias("confidence"),
        F.when(matched, "hybrid").otherwise(F.col("d_backend")).alias("backend"),
        F.when(matched, F.col("r_text")).otherwise(F.col("d_text")).alias("text_content"),
        F.when(matched, F.col("r_ids")).otherwise(F.col("d_ids")).alias("source_block_ids"),
        F.lit(0).alias("late"),
        F.col("d_pos").alias("pos"),
    )
    lone = rules.join(best.select(*keys, F.col("r_pos").alias("region_pos")).distinct(), [*keys, "region_pos"], "left_anti")
    lone = lone.select(*keys, "region_id", "region_class", "bbox", "confidence", "backend", "text_content", "source_block_ids", F.lit(1).alias("late"), F.col("region_pos").alias("pos"))
    order = W.partitionBy(*keys).orderBy(F.col("bbox.y0"), F.col("bbox.x0"), "late", "pos")
    return fused.unionByName(lone).withColumn("region_pos", F.row_number().over(order) - 1).drop("late", "pos")


def align(blocks: DataFrame, regions: DataFrame, least: float = 0.3) -> DataFrame:
    """Each block's best region of its page, if the page has any.

    (doc_id, page_index, block_id, block_pos, region_id, region_class, score, flagged): the earliest of equals;
    below ``least`` the block is flagged, without a region, and keeps its best score. Blocks of pages
    without regions have no row here; see unassigned().
    """
    keys = list(PAGE)
    r = regions.select(*keys, "region_id", "region_class", "region_pos", F.col("bbox").alias("r_box"))
    pairs = blocks.select(*keys, "block_id", "block_pos", "bbox").join(r, keys).withColumn("score", overlap_score(F.col("bbox"), F.col("r_box")))
    best = pairs.withColumn("k", F.row_number().over(W.partitionBy(*keys, "block_pos").orderBy(F.col("score").desc(), "region_pos"))).where("k = 1")
    good = (F.col("score") >= least) & (F.col("score") > 0)
    return best.select(*keys, "block_id", "block_pos", F.when(good, F.col("region_id")).otherwise("").alias("region_id"), F.when(good, F.col("region_class")).otherwise("unknown").alias("region_class"), r4(F.col("score")).alias("score"), (~good).alias("flagged"))


def unassigned(blocks: DataFrame, alignment: DataFrame) -> DataFrame:
    """Blocks without a region: flagged ones, and all of pages without any region."""
    keys = [*PAGE, "block_pos"]
    return blocks.select(*keys, "block_id").join(alignment.where(~F.col("flagged")), keys, "left_anti")


def enrich(regions: DataFrame, blocks: DataFrame, alignment: DataFrame) -> DataFrame:
    """Regions with the text of their first aligned block where they have none, and all aligned block ids."""
    keys = list(PAGE)
    own = alignment.where(~F.col("flagged")).select(*keys, "block_pos", "region_id").join(blocks.select(*keys, "block_pos", "block_id", "text"), [*keys, "block_pos"])
    add = own.groupBy(*keys, "region_id").agg(F.min_by("text", "block_pos").alias("first_text"), F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "block_id"))), lambda x: x["block_id"].cast("string")).alias("new_ids"))
    out = regions.join(add, [*keys, "region_id"], "left")
    empty = F.coalesce("text_content", F.lit("")) == ""
    return out.withColumn("text_content", F.when(empty, F.coalesce("first_text", "text_content")).otherwise(F.col("text_content"))).withColumn("source_block_ids", F.array_union("source_block_ids", F.coalesce("new_ids", F.array().cast("array<string>")))).drop("first_text", "new_ids")


def alignment_stats(blocks: DataFrame, alignment: DataFrame) -> DataFrame:
    """Of each document: aligned rows (flagged ones too), flagged and unassigned blocks."""
    a = alignment.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_aligned"), F.count_if("flagged").alias("n_flagged"))
    u = unassigned(blocks, alignment).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unassigned"))
    return blocks.select("doc_id").distinct().join(a, "doc_id", "left").join(u, "doc_id", "left").na.fill(0)


def score_band(score: Column, flagged: Column) -> Column:
    return F.when(flagged, "red").when(score >= 0.7, "green").when(score >= 0.45, "amber").otherwise("red")


def text_gaps(blocks: DataFrame, existing: DataFrame | None = None, least: float = 40.0) -> DataFrame:
    """Empty bands of full page width between the texts of a page: likely figures.

    A band that comes within 10 points of a known figure is left out. ``seq`` counts a page's bands.
    """
    keys = list(PAGE)
    b = F.col("bbox")
    above = W.partitionBy(*keys).orderBy(b["y0"], "block_pos").rowsBetween(W.unboundedPreceding, -1)
    gap = blocks.select(*keys, "block_pos", "page_width", b["y0"].alias("bottom"), F.coalesce(F.max(b["y1"]).over(above), F.lit(0.0)).alias("top"))
    gap = gap.where((F.col("bottom") - F.col("top") >= least) & (F.col("page_width") >= 100.0))
    if existing is not None:
        e = existing.select(*keys, F.col("bbox").alias("e")).groupBy(*keys).agg(F.collect_list("e").alias("es"))
        gap = gap.join(e, keys, "left")
        near = F.exists("es", lambda x: (F.lit(-10.0) < x["x1"]) & (F.col("page_width") + 10.0 > x["x0"]) & (F.col("top") - 10.0 < x["y1"]) & (F.col("bottom") + 10.0 > x["y0"]))
        gap = gap.where(~F.coalesce(near, F.lit(False))).drop("es")
    seq = F.row_number().over(W.partitionBy(*keys).orderBy("bottom", "block_pos")) - 1
    out = gap.withColumn("seq", seq)
    return out.select(*keys, "seq", md5_id(F.col("doc_id"), "::fig::gap::p", F.col("page_index"), "::s", F.col("seq")).alias("block_id"), F.struct(F.lit(0.0).alias("x0"), F.col("top").alias("y0"), F.col("page_width").alias("x1"), F.col("bottom").alias("y1")).alias("bbox"))
