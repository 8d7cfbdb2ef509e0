"""Registered queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import tables as T
from .functions.scalar import cosine, iou, md5_id, overlap_score, r4
from .operators import analytics as A, blocks as B, evaluate as E, graph as G, layout as L, pages as P, prompt as Q, retrieval as R, semantic as S, vector as V
from .plans import pipeline as C
from .sources import derive as D, external as X, json_io as J
from .sources.staging import saved, tables_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def joined(column: str, name: str | None = None):
    """An array as text, so that every engine compares it alike."""
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(name or column)


class World:
    """The derived tables of one directory, made when they are first asked for and written once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def nodes(self) -> DataFrame:
        return saved(G.assign_sections(G.distinct_nodes(D.nodes(self.spark, self.d)), F.col("region_class").isin("title", "abstract")), "nodes")

    @cached_property
    def links(self) -> DataFrame:
        return G.link_captions(D.links_input(self.spark, self.d))

    @cached_property
    def index(self) -> DataFrame:
        return saved(V.build_index(self.nodes), "index")

    @cached_property
    def edges(self) -> DataFrame:
        return saved(G.build_edges(self.nodes, self.links), "edges")

    @cached_property
    def queries(self) -> DataFrame:
        return D.queries(self.spark, self.d)

    @cached_property
    def everyone(self) -> DataFrame:
        return self.queries.withColumn("role_filter", F.lit(None).cast("string"))

    def found(self, **kw) -> R.Retrieval:
        return R.retrieve(self.index, self.nodes, self.edges, self.queries, **kw)


HIT = ("query_id", "node_id", "role", "rank")


def _seeds(df: DataFrame) -> DataFrame:
    return df.select(*HIT, r4(F.col("score")).alias("score"))


@query
def vector_topk(spark, d):
    w = World(spark, d)
    return _seeds(V.search(w.index, w.everyone, exclude_noise=False))


@query
def vector_topk_role_filter(spark, d):
    w = World(spark, d)
    return _seeds(V.search(w.index, w.queries))


@query
def vector_topk_batch(spark, d):
    w = World(spark, d)
    return _seeds(V.search(w.index, w.everyone, top_k=10))


@query
def index_admission(spark, d):
    return V.admit(World(spark, d).nodes).select("node_id", "role", F.length("text").cast("long").alias("n_chars"))


@query
def index_role_histogram(spark, d):
    return V.summary(World(spark, d).index)


@query
def index_validate(spark, d):
    w = World(spark, d)
    return V.validate(w.index, w.nodes)


@query
def ivf_topk(spark, d):
    w = World(spark, d)
    clustered, centroids = V.cluster(w.index, V.index_type(max(w.index.count(), T.EXACT_ROWS + 1))[1])
    return _seeds(V.search(clustered, w.everyone, centroids=centroids))


@query
def graph_nodes(spark, d):
    return World(spark, d).nodes.select("doc", "node_id", "page", "y0", "region_class", "role", "role_confidence", "is_noise", F.length("text").cast("long").alias("n_chars"))


@query
def section_assignment(spark, d):
    return World(spark, d).nodes.select("doc", "node_id", "section_id", "sec_key")


EDGE = ("doc", "src", "tgt", "relation", "weight", "edge_source")


@query
def multimodal_edges(spark, d):
    w = World(spark, d)
    return G.multimodal_edges(w.nodes, w.links).select(*EDGE)


@query
def role_edges(spark, d):
    return G.role_edges(World(spark, d).nodes).select(*EDGE)


@query
def co_section_edges(spark, d):
    return G.co_section_edges(World(spark, d).nodes).select(*EDGE)


@query
def contains_edges(spark, d):
    return G.contains_edges(World(spark, d).nodes).select(*EDGE)


@query
def graph_edges_all(spark, d):
    return World(spark, d).edges.select(*EDGE, "edge_seq")


@query
def graph_edge_counts(spark, d):
    return G.edge_counts(World(spark, d).edges)


@query
def bfs_relation_k2(spark, d):
    w = World(spark, d)
    starts = w.nodes.where("role = 'Definition' AND NOT is_noise").select("doc", "node_id")
    return G.reachable(w.edges, starts, "co_section", 2)


@query
def section_siblings(spark, d):
    w = World(spark, d)
    return G.section_siblings(w.nodes, w.nodes)


@query
def node_texts(spark, d):
    w = World(spark, d)
    ids = D.read(spark, d, "embeddings").where("vec_id % 50 = 0")
    wanted = ids.selectExpr("vec_id AS node_id").unionByName(ids.selectExpr("-1 - vec_id AS node_id"))  # and as many that no node has
    return G.node_texts(w.nodes, wanted).select("node_id", F.length("text").cast("long").alias("n_chars"))


@query
def graph_summary(spark, d):
    w = World(spark, d)
    return G.summary(w.nodes, w.edges)


@query
def graph_isolates(spark, d):
    w = World(spark, d)
    return G.isolated(w.nodes, w.edges)


@query
def graph_validate(spark, d):
    w = World(spark, d)
    return G.validate(w.nodes, w.edges)


@query
def intent_classify(spark, d):
    bank = E.query_bank(spark).select("query_id", "query").unionByName(D.queries(spark, d).select(F.col("query_id") + 1000, "query").toDF("query_id", "query"))
    return R.classify_intent(bank).select("query_id", "intent", "intent_conf")


@query
def intent_role_fallback(spark, d):
    w = World(spark, d)
    blank = R.classify_intent(w.queries.withColumn("query", F.when(F.col("query_id") % 100 == 0, F.lit("Tell me more")).otherwise(F.col("query"))))
    return R.settle_intent(blank, V.search(w.index, w.everyone)).select("query_id", "intent", "intent_conf", "intent_used", "intent_source")


@query
def graph_expand(spark, d):
    return World(spark, d).found().hits


RANKED = ("query_id", "node_id", "role", "origin", "similarity", "graph_score", "final_score", "final_rank")


@query
def hybrid_rank(spark, d):
    w = World(spark, d)
    r = R.retrieve(w.index, w.nodes, w.edges, w.everyone)
    return r.ranked.select(*RANKED, joined("relation_path"))


@query
def hybrid_rank_role_soft(spark, d):
    return World(spark, d).found().ranked.select(*RANKED)


@query
def hybrid_provenance(spark, d):
    return World(spark, d).found().provenance().select("query_id", "intent_used", "intent_source", joined("seed_ids"), joined("expanded_ids"), joined("relations"), F.col("n_final").cast("long").alias("n_final"))


@query
def hybrid_v3_rank_decay(spark, d):
    return World(spark, d).found(version=3).ranked.select(*RANKED)


@query
def observation_rescue(spark, d):
    w = World(spark, d)
    return R.rescue(w.index, w.everyone, V.search(w.index, w.everyone)).select(*HIT, "origin")


@query
def induced_subgraph(spark, d):
    return World(spark, d).found().subgraph.select("query_id", "src", "tgt", "relation", "weight")


@query
def edge_explanations(spark, d):
    w = World(spark, d)
    return G.explain_edges(w.found().subgraph, w.nodes).select("query_id", "src", "tgt", "explanation")


def _evaluation(spark, d):
    w = World(spark, d)
    q = w.queries.select("query_id", F.array((F.col("query_id") + 1), (F.col("query_id") + 50)).alias("relevant_ids"), F.array_compact(F.array("role_filter")).alias("relevant_roles"), F.concat(F.lit("q"), F.col("query_id") % 3).alias("description"))
    v = E.ranked_list(V.search(w.index, w.everyone, top_k=10), "vector")
    h = E.ranked_list(R.retrieve(w.index, w.nodes, w.edges, w.everyone).ranked, "hybrid", "final_rank")
    return q, E.metrics(E.mark_hits(v.unionByName(h), q), q)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r4(F.col(c) + 10.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def eval_per_query(spark, d):
    return _rounded(_evaluation(spark, d)[1])


@query
def eval_report(spark, d):
    return _rounded(E.report(_evaluation(spark, d)[1]))


@query
def eval_delta(spark, d):
    return _rounded(E.delta(E.report(_evaluation(spark, d)[1])))


@query
def eval_breakdown(spark, d):
    q, m = _evaluation(spark, d)
    return _rounded(E.breakdown(m, q))


@query
def eval_autolabel(spark, d):
    return E.label_queries(World(spark, d).nodes).select("query", joined("relevant_ids"), joined("relevant_roles"), "description")


@query
def metric_cases(spark, d):
    cases = [(0, "10100"), (1, "10101"), (2, "1000"), (3, "010"), (4, "000"), (5, "001"), (6, "111")]
    rows = [(k, i + 1, i + 1, "R" if c == "1" else "X") for k, s in cases for i, c in enumerate(s)]
    hits = spark.createDataFrame(rows, "query_id long, node_id long, rank int, role string").withColumn("system", F.lit("list"))
    q = spark.createDataFrame([(k, [1, 2, 3], ["R"]) for k, _ in cases], "query_id long, relevant_ids array<long>, relevant_roles array<string>").withColumn("relevant_ids", F.transform("relevant_ids", lambda x: x + 100))
    return _rounded(E.metrics(E.mark_hits(hits, q), q, (1, 3, 5)))


def _spans(spark, d):
    """Raw page blocks from documents: a block for each line, a span for each third of its characters."""
    b = D.blocks(spark, d)
    n = F.length("text")
    third = F.ceil(n / 3).cast("int")
    part = lambda k: F.struct(F.substr("text", k * third + 1, third).alias("text"), F.concat(F.lit("Font"), F.lit("ABC"[k])).alias("font"), (9.0 + (n + k) % 5).alias("size"), ((n * (k + 3)) % 32).cast("int").alias("flags"), F.lit(0).alias("color"))
    return b.select("doc_id", "page_index", F.when(F.col("block_pos") % 9 == 8, 1).otherwise(0).alias("type"), F.col("block_pos").alias("number"), "bbox", F.array(part(0), part(1), part(2)).alias("spans"))


@query
def blocks_extract(spark, d):
    return B.extract(_spans(spark, d)).select("doc_id", "page_index", "block_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "block_type", F.col("raw_block_no").cast("long").alias("raw_block_no"))


@query
def dominant_style(spark, d):
    return B.extract(_spans(spark, d)).select("block_id", "style.font_name", "style.font_size", "style.is_bold", "style.is_italic")


@query
def raster_figures(spark, d):
    return B.raster_figures(_spans(spark, d)).select("doc_id", "page_index", "block_id")


@query
def page_stats(spark, d):
    return B.page_stats(D.blocks(spark, d)).select("doc_id", "page_index", "n_chars", "n_blocks", "ocr_triggered", "method")


@query
def document_stats(spark, d):
    return B.document_stats(B.page_stats(D.blocks(spark, d)))


@query
def equation_guess(spark, d):
    return D.blocks(spark, d).select("block_id", B.guess_type(F.col("text")).alias("block_type"))


@query
def block_ids(spark, d):
    return D.blocks(spark, d).select("block_id", B.block_id(F.col("doc_id"), F.col("page_index"), F.col("block_pos")).alias("hash_id"), L.region_id(F.col("doc_id"), F.col("page_index"), F.col("block_pos")).alias("region_id"), B.figure_id(F.col("doc_id"), "vector", F.col("page_index"), F.col("block_pos")).alias("figure_id"))


@query
def ocr_word_group(spark, d):
    w = D.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("word_no", "text"))
    k = F.col("word_no")
    w = w.select("doc_id", F.floor(k / 60).cast("int").alias("page_index"), F.floor(k / 12).cast("int").alias("block_num"), "word_no", "text", ((k * 37) % 101 - 5).cast("double").alias("conf"), (k % 12 * 40.0).alias("left"), (F.floor(k / 12) * 20.0).alias("top"), F.lit(36.0).alias("width"), F.lit(18.0).alias("height"), F.lit(0.48).alias("scale"))
    g = B.group_ocr_words(w)
    return g.select("doc_id", "page_index", "block_num", F.md5(F.col("text").cast("binary")).alias("text_md5"), r4(F.col("confidence")).alias("confidence"), *(r4(F.col(f"bbox.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query
def scaled_boxes(spark, d):
    from .functions.scalar import scale_box

    b = scale_box(F.col("bbox"), F.lit(1240.0), F.lit(1754.0), F.col("page_width"), F.col("page_height"))
    return D.blocks(spark, d).select("block_id", *(r4(b[c]).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query
def page_upper_median(spark, d):
    return L.page_median_font(D.blocks(spark, d))


@query
def near_table_caption(spark, d):
    return L.near_table_caption(D.blocks(spark, d)).select("block_id", "near_table_caption")


@query
def layout_classify(spark, d):
    return L.detect(D.blocks(spark, d)).select("doc_id", "page_index", F.col("region_pos").cast("long").alias("region_pos"), "region_id", "region_class")


@query
def layout_stats(spark, d):
    return L.class_counts(L.detect(D.blocks(spark, d)))


def _fusion(spark, d):
    rules = saved(L.detect(D.blocks(spark, d)), "regions")
    return L.fuse(D.detections(rules), rules)


@query
def fuse_regions(spark, d):
    return _fusion(spark, d).select("doc_id", "page_index", F.col("region_pos").cast("long").alias("region_pos"), "region_id", "region_class", r4(F.col("confidence")).alias("confidence"), "backend")


def _two(spark, d):
    blocks = D.blocks(spark, d)
    return blocks, saved(D.detections(L.detect(blocks)), "regions")


@query
def iou_pairs(spark, d):
    blocks, regions = _two(spark, d)
    r = regions.select("doc_id", "page_index", "region_id", F.col("bbox").alias("r"))
    pairs = blocks.select("doc_id", "page_index", "block_id", "bbox").join(r, ["doc_id", "page_index"]).withColumn("i", iou(F.col("bbox"), F.col("r"))).where("i > 0")
    return pairs.select("block_id", "region_id", r4(F.col("i")).alias("iou"), r4(overlap_score(F.col("bbox"), F.col("r"))).alias("score"))


@query
def align_blocks(spark, d):
    return L.align(*_two(spark, d)).select("block_id", "region_id", "region_class", "score", "flagged")


@query
def align_unassigned(spark, d):
    blocks, regions = _two(spark, d)
    return L.unassigned(blocks, L.align(blocks, regions)).select("block_id")


@query
def align_enrich(spark, d):
    blocks, regions = _two(spark, d)
    return L.enrich(regions, blocks, L.align(blocks, regions)).select("region_id", F.md5(F.coalesce("text_content", F.lit("")).cast("binary")).alias("text_md5"), joined("source_block_ids"))


@query
def alignment_stats(spark, d):
    blocks, regions = _two(spark, d)
    return L.alignment_stats(blocks, L.align(blocks, regions))


@query
def score_bands(spark, d):
    return L.align(*_two(spark, d)).select(L.score_band(F.col("score"), F.col("flagged")).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query
def textgap_figures(spark, d):
    blocks = D.blocks(spark, d).where("block_pos % 5 <> 2")
    known = D.blocks(spark, d).where("block_pos % 5 = 2")
    g = L.text_gaps(blocks, known)
    return g.select("doc_id", "page_index", F.col("seq").cast("long").alias("seq"), "block_id", "bbox.y0", "bbox.y1")


@query
def reading_order(spark, d):
    return P.reading_order(L.detect(D.blocks(spark, d)))


def _drawings(spark, d):
    b = F.col("bbox")
    k = (F.col("block_pos") * 13 % 7).cast("double")
    moved = F.struct((b["x0"] + 40 * k).alias("x0"), (b["y0"] + 5 * k).alias("y0"), (b["x1"] + 40 * k).alias("x1"), (b["y1"] + 30 * k).alias("y1"))
    return D.blocks(spark, d).where("block_pos % 3 = 0").select("doc_id", "page_index", F.col("block_pos").alias("draw_pos"), moved.alias("bbox"), "page_width", "page_height")


@query
def vector_figure_clusters(spark, d):
    return P.figure_clusters(_drawings(spark, d), D.blocks(spark, d).where("block_pos % 3 <> 0"))


@query
def figure_dedup(spark, d):
    v = P.figure_clusters(_drawings(spark, d), D.blocks(spark, d).where("block_pos % 3 <> 0"))
    v = v.select("doc_id", "page_index", F.lit("vector").alias("strategy"), F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "block_id")).cast("int").alias("seq"), "block_id", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    g = L.text_gaps(D.blocks(spark, d)).select("doc_id", "page_index", F.lit("gap").alias("strategy"), F.col("seq").cast("int").alias("seq"), "block_id", "bbox")
    return P.dedup_figures(v.unionByName(g))


@query
def typed_refs(spark, d):
    t = D.links_input(spark, d).where("region_class = 'caption'").select("node_id", F.concat("text", F.lit(" see Tables 4 and Figs. 5, tab 6; prefig 7")).alias("t"))
    refs = G.typed_references(F.col("t"))
    return t.select("node_id", F.array_join(F.transform(refs, lambda r: F.concat(r["kind"], F.lit(":"), r["num"])), ",").alias("refs"))


@query
def link_captions(spark, d):
    return World(spark, d).links.select("doc", "caption_id", "target_id", "s_ref", "s_emb", "s_link", F.col("link_rank").cast("long").alias("link_rank"))


@query
def vector_cosine(spark, d):
    e = D.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")), "a").select("a", r4(cosine(F.col("x"), F.col("y")) + 1).alias("cosine_plus_1"))


@query
def role_classify(spark, d):
    regions = D.blocks(spark, d).select("block_id", "text", F.lit("paragraph").alias("region_class"))
    return S.RoleModel(spark).classify(S.encode(regions)).select("block_id", "scholarly_role", "role_confidence")


@query
def prompt_passages(spark, d):
    return Q.passages(World(spark, d).found().ranked).select("query_id", F.col("passage_no").cast("long").alias("passage_no"), "node_id", F.md5(F.col("passage").cast("binary")).alias("passage_md5"))


@query
def prompt_edges(spark, d):
    w = World(spark, d)
    return Q.prompt_edges(w.found().subgraph, w.nodes).select("query_id", F.col("edge_no").cast("long").alias("edge_no"), "line")


@query
def prompt_text(spark, d):
    w = World(spark, d)
    r = w.found()
    return Q.assemble(r.queries, Q.passages(r.ranked), Q.prompt_edges(r.subgraph, w.nodes)).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


@query
def parse_answer(spark, d):
    said = D.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("t"))
    k = F.col("doc_id") % 4
    t = F.col("t")
    text = F.when(k == 0, F.concat(F.lit("x\n## Answer\n"), t, F.lit("\n## evidence \n1. "), t, F.lit("\n## Graph Reasoning\n- a"))).when(k == 1, F.concat(F.lit("##Answer\nfirst\n## ANSWER\n"), t)).when(k == 2, t).otherwise(F.concat(F.lit("## Graph Reasoning\n"), t))
    out = Q.parse(said.select("doc_id", text.alias("response")))
    return out.select("doc_id", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("answer", "evidence", "reasoning")))


@query
def generated_answers(spark, d):
    w = World(spark, d)
    r = w.found()
    p = Q.assemble(r.queries, Q.passages(r.ranked), Q.prompt_edges(r.subgraph, w.nodes))
    return Q.parse(Q.generate(p)).select("query_id", "answer", "evidence", "reasoning", "error")


@query
def class_histogram(spark, d):
    return A.class_histogram(World(spark, d).nodes)


@query
def role_share(spark, d):
    return A.role_share(World(spark, d).nodes)


@query
def region_filter(spark, d):
    return A.region_filter(World(spark, d).nodes, ["paragraph", "list"], ["Method", "Result"]).select("node_id", "region_class", "role", F.md5(A.shorten(F.col("text"), 60, html=True).cast("binary")).alias("text_md5"))


@query
def pipeline_counters(spark, d):
    w = World(spark, d)
    return A.counters(w.nodes, w.edges, w.index)


@query
def edge_percent(spark, d):
    return A.edge_percent(World(spark, d).edges)


@query
def node_ids(spark, d):
    return World(spark, d).nodes.select("node_id", md5_id(F.col("doc"), "::layout::p", F.col("page"), "::r", F.col("node_seq")).alias("hash_id"))


# Overrides, empty results and checks of the engine.


def _wished(spark, d):
    """The queries with an intent given to two of three: each in turn, and one that is unknown."""
    names = ("method", "result", "dataset", "figure", "definition", "observation", "none such")
    turn = (F.col("query_id") / 50).cast("long")
    return World(spark, d).everyone.withColumn("intent_override", F.when(turn % 3 != 2, F.element_at(F.array(*map(F.lit, names)), (turn % len(names)).cast("int") + 1)))


@query
def hybrid_override(spark, d):
    w = World(spark, d)
    r = R.retrieve(w.index, w.nodes, w.edges, _wished(spark, d))
    return r.ranked.join(r.queries.select("query_id", "intent_used", "intent_source"), "query_id").select(*RANKED, "intent_used", "intent_source")


@query
def hybrid_no_seeds(spark, d):
    """An index without rows: every query has an answer, and it is empty."""
    w = World(spark, d)
    r = R.retrieve(w.index.where("false"), w.nodes, w.edges, w.everyone)
    return r.provenance().select("query_id", "intent_used", "intent_source", joined("seed_ids"), joined("expanded_ids"), joined("relations"), F.col("n_final").cast("long").alias("n_final"))


@query
def engine_validate(spark, d):
    w = World(spark, d)
    checks = R.validate(w.index, w.edges, T.ALPHA)
    wrong = R.validate(w.index.where("false"), w.edges.where("false"), 1.5)
    return spark.createDataFrame([("built", *checks.values()), ("empty", *wrong.values())], "state string, has_index boolean, has_graph boolean, alpha_in_range boolean")


@query
def top_texts(spark, d):
    return World(spark, d).found().top_texts(3).select("query_id", F.col("final_rank").cast("long").alias("final_rank"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def nodes_by_role(spark, d):
    return World(spark, d).found().by_role("Method").select("query_id", "node_id", F.col("final_rank").cast("long").alias("final_rank"))


# Headings by their text, figures among the regions.


@query
def section_titles(spark, d):
    """Sections by the rule of the operator: titles of many shapes, abstracts of any text."""
    heads = ("1. Introduction", "2.1 Related Work", "Results & Discussion", "lower case", "X", "Numbers 5: yes", "Ends with a stop.", " Padded ")
    nodes = G.distinct_nodes(D.nodes(spark, d))
    said = F.element_at(F.array(*map(F.lit, heads)), ((F.col("node_id") / 20).cast("int") % len(heads)) + 1)
    out = G.assign_sections(nodes.withColumn("text", F.when(F.col("region_class") == "title", said).otherwise(F.col("text"))))
    return out.select("doc", "node_id", "section_id", "sec_key")


def _figures(spark, d):
    """Every ninth block of a document is a picture."""
    b = D.blocks(spark, d)
    picture = F.col("block_pos") % 9 == 8
    return b.where(~picture), b.where(picture)


@query
def layout_figures(spark, d):
    blocks, figures = _figures(spark, d)
    out = L.detect(blocks, figures)
    return out.select("doc_id", "page_index", F.col("region_pos").cast("long").alias("region_pos"), "region_id", "region_class", r4(F.col("confidence")).alias("confidence"), F.col("text_content").isNull().alias("no_text"))


@query
def page_regions(spark, d):
    """Regions of blocks and figures in the order of reading."""
    return C.regions_of(*_figures(spark, d)).select("doc_id", "page_index", "region_pos", "reading_pos", "region_class")


# Files: written and read back.


def _folder(spark) -> str:
    from uuid import uuid4

    return f"{tables_folder(spark)}/files-{uuid4().hex}"


def _number(column: str):
    return F.col(column).cast("long").alias(column)


@query
def extraction_json(spark, d):
    blocks, figures = _figures(spark, d)
    path = _folder(spark)
    J.write_json(J.extraction_documents(blocks, figures), path)
    got = J.read_extraction(spark, path, lines=True)
    text = J.text_blocks(got).select(_number("doc_id"), "page_index", "block_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), r4(F.col("bbox.y0")).alias("y0"), "font_size", "is_bold", "block_type")
    pictures = J.figure_blocks(got).select(_number("doc_id"), "page_index", "block_id", F.lit(None).cast("string").alias("text_md5"), r4(F.col("bbox.y0")).alias("y0"), F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("boolean").alias("is_bold"), F.lit("figure").alias("block_type"))
    return text.unionByName(pictures)


@query
def first_page_blocks(spark, d):
    path = _folder(spark)
    J.write_json(J.extraction_documents(D.blocks(spark, d)), path)
    return J.page_blocks(J.read_extraction(spark, path, lines=True), 0).select(_number("doc_id"), "page_index", "block_id")


@query
def layout_json(spark, d):
    path = _folder(spark)
    J.write_json(J.layout_documents(L.detect(D.blocks(spark, d))), path)
    out = J.regions(J.read_layout(spark, path, lines=True))
    return out.select(_number("doc_id"), "page_index", F.col("region_pos").cast("long").alias("region_pos"), "region_id", "region_class", "backend", r4(F.col("confidence")).alias("confidence"), joined("source_block_ids"))


def _semantic(spark, d):
    w, path = World(spark, d), _folder(spark)
    J.write_json(J.semantic_documents(w.nodes, w.links), path)
    return J.read_semantic(spark, path, required=True, lines=True)


@query
def semantic_json(spark, d):
    return J.semantic_nodes(_semantic(spark, d)).select(_number("doc"), _number("node_id"), "page", "y0", "region_class", "role", "role_confidence", F.length("text").cast("long").alias("n_chars"))


@query
def semantic_json_links(spark, d):
    return J.semantic_links(_semantic(spark, d)).select(_number("doc"), _number("caption_id"), _number("target_id"), "s_ref", "s_emb", "s_link")


@query
def evaluation_nodes(spark, d):
    return J.evaluation_nodes(_semantic(spark, d)).select(_number("doc"), _number("node_id"), "role", F.length("text").cast("long").alias("n_chars"))


@query
def alignment_json(spark, d):
    blocks, regions = _two(spark, d)
    found, path = saved(L.align(blocks, regions), "aligned"), _folder(spark)
    J.write_json(J.alignment_documents(found, L.unassigned(blocks, found)), path)
    back = spark.read.schema(J.ALIGNMENT).json(path)
    return back.select("doc_id", F.size("alignments").cast("long").alias("n_aligned"), F.md5(F.array_join(F.transform("alignments", lambda a: F.concat_ws(":", a["block_id"], a["region_id"], a["flagged"].cast("string"))), ",").cast("binary")).alias("aligned_md5"), F.md5(F.array_join("unassigned", ",").cast("binary")).alias("unassigned_md5"))


@query
def node_link_json(spark, d):
    w, path = World(spark, d), _folder(spark)
    J.write_json(J.node_link_documents(w.nodes, w.edges), path)
    nodes, edges = J.read_node_link(spark, path, lines=True)
    n = nodes.groupBy("doc").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_noise").alias("n_noise"), F.sum(F.length("text")).alias("n_chars"))
    return edges.select(_number("doc"), _number("src"), _number("tgt"), "relation", "weight", "edge_source", "edge_seq").join(n.select(_number("doc"), "n_nodes", "n_noise", "n_chars"), "doc")


@query
def report_json(spark, d):
    m = saved(_evaluation(spark, d)[1], "metrics")
    path = _folder(spark)
    J.write_json(J.report_documents(m, E.report(m), E.delta(E.report(m))), path)
    back = spark.read.json(path).select(F.explode("systems").alias("s"))
    return back.select("s.system", F.explode("s.by_k").alias("k")).select("system", F.col("k.k").cast("int").alias("k"), _ten("k.mean_precision").alias("mean_precision"), _ten("k.mean_ndcg").alias("mean_ndcg"), F.col("k.n_queries").alias("n_queries"))


def _ten(column: str):
    return r4(F.col(column) + 10.0)


@query
def form_figures(spark, d):
    """Form objects with boxes of many sizes, with too few numbers and without any."""
    b = F.col("bbox")
    numbers = F.concat_ws(" ", b["x0"].cast("int"), b["y0"].cast("int"), b["x1"].cast("int"), b["y1"].cast("int"))
    said = F.when(F.col("block_pos") % 4 == 3, "<< /Type /XObject >>").when(F.col("block_pos") % 4 == 2, F.concat(F.lit("<< /BBox [ "), b["x0"].cast("int"), F.lit(" 7 ] >>"))).otherwise(F.concat(F.lit("<< /Subtype /Form /BBox ["), numbers, F.lit("] >>")))
    objects = D.blocks(spark, d).select("doc_id", "page_index", F.col("block_pos").alias("seq"), said.alias("dictionary"))
    return X.form_figures(objects).select("doc_id", "page_index", "block_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query
def pdf_names(spark, d):
    """Which of some file names are PDFs, and the documents' ids that they give."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit("/data/a b/"), F.col("page_id"), F.when(k == 0, " é-x.pdf").when(k == 1, ".PDF").when(k == 2, ".txt").when(k == 3, F.concat(F.lit("."), F.repeat(F.lit("long"), 12), F.lit(".pdf"))).otherwise("pdf"))
    return D.read(spark, d, "pages").select("page_id", B.is_pdf(name).alias("is_pdf"), B.doc_id_of(name).alias("doc"))


@query
def shortened_texts(spark, d):
    t = F.col("text")
    cuts = [F.md5(A.shorten(t, n, html=n < 200).cast("binary")).alias(f"md5_{n}") for n in (60, 120, 200, 300)]
    return D.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *cuts)


@query
def compare_systems(spark, d):
    """Vector search against the hybrid engine; a third system fails and has empty lists. Latencies are not shown."""
    w = World(spark, d)
    q = w.everyone.withColumn("relevant_ids", F.array(F.col("query_id") + 1, F.col("query_id") + 50)).withColumn("relevant_roles", F.array().cast("array<string>"))

    def broken(queries):
        raise RuntimeError("no such system")

    found = E.compare(q, {"vector": lambda x: V.search(w.index, x, top_k=10), "hybrid": lambda x: R.retrieve(w.index, w.nodes, w.edges, x).ranked.withColumn("rank", F.col("final_rank")), "broken": broken})
    return _rounded(found.reports.drop("mean_latency_ms")).withColumn("failed", F.col("system").isin(*found.errors))


@query
def blocks_to_answers(spark, d):
    """The whole way: blocks, regions, roles, links, graph, index, and answers to the fixed questions."""
    corpus = C.build_from_blocks(D.blocks(spark, d), f"{tables_folder(spark)}/corpus-{_folder(spark)[-32:]}")
    return corpus.ask(E.query_bank(spark).select("query_id", "query")).select("query_id", "answer", "evidence", "reasoning", "error")
