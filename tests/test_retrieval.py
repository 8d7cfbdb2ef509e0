"""Search, graph caps, expansion, scores, prompts, answers and metrics on small inputs."""

import math
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import packed, tables as T
from quire.functions.scalar import char_share, strip
from quire.operators import evaluate as E, graph as G, prompt as Q, retrieval as R, semantic as S, vector as V
from quire.plans import pipeline as P
from quire.sources import derive as D, json_io as J


def test_filter_comes_after_the_fetch(spark):
    """The wanted role stands behind more rows than are fetched, so nothing is found."""
    rows = [(k, 0, "Method" if k < 40 else "Result", [1.0, 0.001 * k], f"text {k}", "paragraph", False) for k in range(50)]
    index = spark.createDataFrame(rows, "node_id long, page int, role string, embedding array<float>, text string, region_class string, is_noise boolean")
    index = index.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    q = spark.createDataFrame([(1, [1.0, 0.0], "Result"), (2, [1.0, 0.0], "Method"), (3, [1.0, 0.0], None)], "query_id long, qvec array<double>, role_filter string")
    got = V.search(index, q).groupBy("query_id").agg(F.array_sort(F.collect_list("node_id")).alias("n")).collect()
    assert {r.query_id for r in got} == {2, 3}
    assert all(len(r.n) == 5 for r in got)


def test_lists_find_most_rows(spark, small):
    w = V.build_index(G.distinct_nodes(D.nodes(spark, small)))
    q = D.queries(spark, small).withColumn("role_filter", F.lit(None).cast("string"))
    exact = {(r.query_id, r.node_id) for r in V.search(w, q).collect()}
    rows, centroids = V.cluster(w, 4)
    near = {(r.query_id, r.node_id) for r in V.search(rows, q, centroids=centroids).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_more_lists_than_probes_find_all_rows(spark, spread):
    """With 16 lists, four of them read first, no neighbour is lost, be the lists far apart or one cloud."""
    rng = random.Random(7)
    middle = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(16)]
    vectors = [[m + rng.gauss(0, spread) for m in middle[k % 16]] for k in range(640)]
    rows = [(k, 0, "Method", v, f"text {k}", "paragraph", False) for k, v in enumerate(vectors)]
    index = V.build_index(spark.createDataFrame(rows, "node_id long, page int, role string, embedding array<double>, text string, region_class string, is_noise boolean"))
    q = spark.createDataFrame([(k, [x + rng.gauss(0, 0.5) for x in vectors[k]], None) for k in range(0, 640, 16)] + [(1, [0.0] * 12, None)], "query_id long, qvec array<double>, role_filter string")
    find = lambda *a, **kw: {(r.query_id, r.node_id, r.rank) for r in V.search(*a, top_k=30, **kw).collect()}
    lists, centroids = V.cluster(index, T.MAX_LISTS)
    assert T.PROBES < len(centroids)
    assert find(lists, q, centroids=centroids) == find(index, q)


def node_rows(rng, n):
    kinds = ["title", "paragraph", "paragraph", "caption", "figure", "abstract", "header"]
    roles = ["Definition", "Method", "Result", "Observation", "Dataset", "N/A"]
    return [(1, k, rng.randrange(2), float(rng.randrange(900)), rng.choice(kinds), rng.choice(roles), rng.choice([0.0, 0.25, 0.5]), "t", k) for k in range(n)]


NODE = "doc long, node_id long, page int, y0 double, region_class string, role string, role_confidence double, text string, node_seq long"
RULES = {"Method": [("Result", "produces"), ("Observation", "produces")], "Definition": [("Method", "used_in"), ("Result", "defines"), ("Observation", "defines")], "Dataset": [("Result", "evaluated_on"), ("Method", "evaluated_by")], "Result": [("Observation", "supports")]}


def plain_edges(rows):
    """Role, section and definition edges one by one."""
    noise = lambda r: r[4] == "header" or r[5] == "N/A"
    section, current = {}, None
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[8])):
        if r[4] in ("title", "abstract"):
            current = r[1]
        section[r[1]] = current
    key = {r[1]: (("s", section[r[1]]) if section[r[1]] is not None else ("p", r[2])) for r in rows}
    edges = {}
    for role, targets in RULES.items():
        for want, relation in targets:
            by = {}
            for r in rows:
                if r[5] == want and not noise(r):
                    by.setdefault((key[r[1]], r[2]), []).append(r)
            for s in rows:
                if s[5] != role or noise(s):
                    continue
                found = by.get((key[s[1]], s[2])) or [x for (_, p), xs in by.items() if p == s[2] for x in xs]
                for x in found[: 5 if role == "Definition" else 3]:
                    w = (s[6] + x[6]) / 2 if x[6] > 0 else s[6]
                    edges[s[1], x[1]] = (relation, max(math.floor(w * 1e4 + 0.5) / 1e4, 0.1))
    groups = {}
    for r in rows:
        if r[5] == "Definition" and not noise(r):
            groups.setdefault(key[r[1]], []).append(r)
    for g in groups.values():
        for s in g:
            for x in [x for x in g if x is not s and (s[1], x[1]) not in edges][:3]:
                edges[s[1], x[1]] = ("co_section", max(s[6], 0.1))
    for r in rows:
        if section[r[1]] is not None and r[4] != "title":
            edges.setdefault((section[r[1]], r[1]), ("contains", 1.0))
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_against_a_plain_version(spark, seed):
    rows = node_rows(random.Random(seed), 60)
    nodes = G.assign_sections(G.distinct_nodes(spark.createDataFrame(rows, NODE)), F.col("region_class").isin("title", "abstract"))
    none = spark.createDataFrame([], "doc long, caption_id long, target_id long, s_link double, link_pos long")
    got = {(r.src, r.tgt): (r.relation, r.weight) for r in G.build_edges(nodes, none).collect()}
    short = lambda edges: {k: (v[0], round(v[1], 9)) for k, v in edges.items()}
    assert short(got) == short(plain_edges(rows))


def test_repeated_link_keeps_first_place_and_last_weight(spark):
    nodes = G.distinct_nodes(spark.createDataFrame([(1, k, 0, 0.0, "caption", "Method", 0.5, "t", k) for k in range(3)], NODE))
    links = spark.createDataFrame([(1, 0, 1, 0.9, 1), (1, 0, 2, 0.5, 2), (1, 0, 1, 0.4, 3), (1, 0, 9, 0.9, 4), (1, 1, 2, 0.1, 5)], "doc long, caption_id long, target_id long, s_link double, link_pos long")
    got = [(r.src, r.tgt, r.weight) for r in G.multimodal_edges(nodes, links).orderBy("seq").collect()]
    assert got == [(0, 1, 0.4), (0, 2, 0.5)]


def test_expansion_caps(spark):
    seeds = spark.createDataFrame([(1, s, 1 + s, "Method", 0.5) for s in range(3)], "query_id long, node_id long, rank int, role string, score double")
    edges = spark.createDataFrame([(1, s, 100 + 10 * s + k, "produces", 0.5, s * 10 + k) for s in range(3) for k in range(5)] + [(1, 0, 1, "produces", 1.0, 99), (1, 0, 777, "produces", 0.05, 98)], "doc long, src long, tgt long, relation string, weight double, edge_seq long")
    q = spark.createDataFrame([(1, "method")], "query_id long, intent_used string")
    got = [(r.seed_id, r.node_id) for r in R.expand(q, seeds, edges).orderBy("hit_pos").collect()]
    assert got == [(0, 100), (0, 101), (0, 102), (1, 110)]


def test_intents(spark):
    q = spark.createDataFrame([(1, "What method do they propose?"), (2, "Tell me more"), (3, "method dataset"), (4, "Which figure is shown in table 2?")], "query_id long, query string")
    got = {r.query_id: (r.intent, r.intent_conf) for r in R.classify_intent(q).collect()}
    assert got[1] == ("method", pytest.approx(0.182)) and got[2] == ("general", 0.0)
    assert got[3][0] in ("dataset", "general") and got[4][0] == "figure"


def test_merge_scores(spark):
    seeds = spark.createDataFrame([(1, 10, 1, "Method", 0.9)], "query_id long, node_id long, rank int, role string, score double")
    hits = spark.createDataFrame([(1, 10, 20, 0.5, "produces", 1), (1, 10, 20, 0.8, "used_in", 2)], "query_id long, seed_id long, node_id long, weighted double, relation string, hit_pos int")
    nodes = spark.createDataFrame([(k, 1, "Method", 0, "paragraph", 1, "t") for k in (10, 20)], "node_id long, doc long, role string, page int, region_class string, section_id long, text string")
    got = {r.node_id: r for r in R.merge(seeds, hits, nodes).collect()}
    assert got[10].final_score == pytest.approx(0.62) and got[20].final_score == pytest.approx(0.32)
    assert got[20].relation_path == ["produces", "used_in"] and got[20].final_rank == 2


def test_parser(spark):
    texts = ["## Answer\na\n## Evidence\nb\n## Graph Reasoning\nc", "## answer\nfirst\n## Answer\nlast", "no headings ", "## Graph Reasoning\nonly", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, response string")
    got = {r.query_id: (r.answer, r.evidence, r.reasoning) for r in Q.parse(df).collect()}
    assert got == {0: ("a", "b", "c"), 1: ("last", "", ""), 2: ("no headings", "", ""), 3: ("## Graph Reasoning\nonly", "", "only"), 4: ("", "", ""), 5: ("", "", "")}


def test_long_passages_are_marked(spark):
    row = [(1, 5, 1, "Method", 2, "paragraph", "x" * 351, 0.5, "seed"), (1, 6, 2, "N/A", 2, "paragraph", "y", 0.9, "seed"), (1, 7, 3, "Result", 2, "header", "y", 0.9, "seed")]
    df = spark.createDataFrame(row, "query_id long, node_id long, final_rank int, role string, page int, region_class string, text string, final_score double, origin string")
    got = Q.passages(df).collect()
    assert [r.evidence for r in got] == ["x" * 350 + " …"]
    assert got[0].passage.startswith("[P1 | Role: Method | Page: 2 | Node: 5 | Score: 0.500]\n")


def test_generator_is_tried_again(spark):
    prompts = spark.createDataFrame([(1, "p")], "query_id long, prompt string")

    def broken(rules, prompt):
        raise RuntimeError("no service")

    assert Q.generate(prompts, broken).first().error == "no service"
    assert "## Answer" in Q.generate(prompts).first().response


@pytest.mark.parametrize("hits,relevant,k,expected", [("10100", 1, 5, (0.4, 2.0)), ("10101", 3, 5, (0.6, 1.0)), ("1000", 2, 1, (1.0, 0.5))])
def test_precision_and_recall(spark, hits, relevant, k, expected):
    rows = [("s", 1, i, "R" if h == "1" else "X", i + 1) for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "system string, query_id long, node_id long, role string, rank int")
    q = spark.createDataFrame([(1, list(range(100, 100 + relevant)), ["R"])], "query_id long, relevant_ids array<long>, relevant_roles array<string>")
    got = E.metrics(E.mark_hits(df, q), q, (k,)).first()
    assert (got.precision, got.recall) == pytest.approx(expected)


@pytest.mark.parametrize("hits,rr,ndcg", [("010", 0.5, 1 / math.log2(3)), ("100", 1.0, 1.0), ("000", 0.0, 0.0), ("001", 1 / 3, 0.5), ("111", 1.0, 1.0)])
def test_reciprocal_rank_and_ndcg(spark, hits, rr, ndcg):
    rows = [("s", 1, i, "R" if h == "1" else "X", i + 1) for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "system string, query_id long, node_id long, role string, rank int")
    q = spark.createDataFrame([(1, [99], ["R"])], "query_id long, relevant_ids array<long>, relevant_roles array<string>")
    got = E.metrics(E.mark_hits(df, q), q, (3,)).first()
    assert (got.rr, got.ndcg) == pytest.approx((rr, ndcg))


def test_typed_references(spark):
    df = spark.createDataFrame([(1, "Fig. 3 and Table 2"), (2, None), (3, "none"), (4, "config 5, Figures 7")], "k long, t string")
    got = {r.k: [(x.kind, x.num) for x in r.refs] for r in df.select("k", G.typed_references(F.col("t")).alias("refs")).collect()}
    assert got == {1: [("figure", 3), ("table", 2)], 2: [], 3: [], 4: [("figure", 7)]}


def test_roles_of_the_corpus_itself(spark):
    rows = [(k, t, "paragraph") for k, (t, _) in enumerate(S.CORPUS)] + [(98, "", "paragraph"), (99, "x", "figure")]
    got = {r.k: (r.scholarly_role, r.role_confidence) for r in S.RoleModel(spark).classify(S.encode(spark.createDataFrame(rows, "k long, text string, region_class string"))).collect()}
    assert got[98] == ("N/A", 0.0) and got[99] == ("N/A", 0.0)
    assert sum(got[k][0] == r for k, (_, r) in enumerate(S.CORPUS)) >= 24
    assert all(0 < got[k][1] <= 1 for k in range(len(S.CORPUS)))


def test_build_and_ask(spark, small, tmp_path):
    corpus = P.build(D.nodes(spark, small), str(tmp_path / "corpus"), G.link_captions(D.links_input(spark, small)), F.col("region_class").isin("title", "abstract"))
    assert corpus.validate() == {"index": True, "graph": True, "alpha": True}
    got = corpus.ask(D.queries(spark, small)).collect()
    assert got and all(r.answer and r.error is None for r in got)
    alone = corpus.retrieve(D.queries(spark, small), settings=P.Settings(mode="vector"))
    assert alone.ranked.where("origin = 'expansion'").count() == 0
    nodes, edges = corpus.nodes, corpus.edges
    xml = J.graphml(nodes, edges, 0, ["region_class", "role"], ["relation", "weight"])
    assert xml.count("<node ") == nodes.where("doc = 0").count() and xml.count("<edge ") == edges.where("doc = 0").count()


def test_json_round_trip(spark, tmp_path):
    box = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}
    doc = {"doc_id": "d", "pages": [{"page_index": 0, "width": 595.0, "height": 842.0, "text_blocks": [{"block_id": "b", "text": "héllo", "bbox": box, "page_index": 0}], "figure_blocks": []}]}
    import json

    (tmp_path / "x.json").write_text(json.dumps(doc))
    got = J.text_blocks(J.read_extraction(spark, str(tmp_path / "x.json"))).collect()
    assert [(r.block_id, r.text, r.block_type, r.confidence) for r in got] == [("b", "héllo", "text", 1.0)]
    (tmp_path / "broken.json").write_text("{")
    assert J.text_blocks(J.read_extraction(spark, str(tmp_path / "broken.json"))).count() == 0
    with pytest.raises(ValueError):
        J.read_semantic(spark, str(tmp_path / "broken.json"), required=True)


def test_index_round_trip(spark, small, tmp_path):
    index = V.build_index(G.distinct_nodes(D.nodes(spark, small)))
    J.write_index(index, str(tmp_path / "index"))
    rows, none = J.read_index(spark, str(tmp_path / "index"))
    assert rows.count() == index.count() and none is None
    clustered, centroids = V.cluster(index, 5)
    J.write_index(clustered, str(tmp_path / "lists"), "ivf", centroids)
    rows, got = J.read_index(spark, str(tmp_path / "lists"))
    assert (got == centroids).all() and rows.count() == index.count()
    q = D.queries(spark, small).withColumn("role_filter", F.lit(None).cast("string"))
    find = lambda *a, **kw: {(r.query_id, r.node_id, r.rank) for r in V.search(*a, **kw).collect()}
    assert find(rows, q, centroids=got) == find(index, q)
    shutil.rmtree(tmp_path / "lists" / "centroids")
    with pytest.raises(Exception):
        J.read_index(spark, str(tmp_path / "lists"))


def test_roles_of_all_blocks(spark, small):
    from quire.queries import QUERIES

    ids = lambda df: sorted(r.block_id for r in df.select("block_id").collect())
    assert ids(QUERIES["role_classify"](spark, small)) == ids(D.blocks(spark, small))


def test_from_blocks_to_answers(spark, small, tmp_path, monkeypatch):
    """Text ids, figures, a clustered index with stored centroids, and questions without vectors."""
    blocks = D.blocks(spark, small).where("doc_id < 40")
    picture = F.col("block_pos") % 9 == 8
    monkeypatch.setattr(T, "EXACT_ROWS", 50)
    corpus = P.build_from_blocks(blocks.where(~picture), str(tmp_path / "corpus"), blocks.where(picture))
    assert corpus.kind == "ivf" and len(corpus.centroids) == T.MAX_LISTS and corpus.size == corpus.index.count() > 50
    assert corpus.nodes.count() == blocks.count() and corpus.nodes.select("text_id").distinct().count() == blocks.count()
    bank = E.query_bank(spark).select("query_id", "query")
    found = corpus.retrieve(bank)
    exact = V.search(corpus.index, P.encode_queries(bank).withColumn("role_filter", F.lit(None).cast("string")))
    ids = lambda df: {(r.query_id, r.node_id) for r in df.select("query_id", "node_id").collect()}
    assert ids(found.seeds) == ids(exact)
    assert ids(found.top_nodes(2)) <= ids(found.ranked) and found.top_nodes(1).count() == bank.count()
    answers = corpus.ask(bank).collect()
    assert len(answers) == bank.count() and all(r.answer and r.error is None for r in answers)
    with pytest.raises(ValueError):
        P.build(corpus.nodes.withColumn("node_id", F.col("text_id")), str(tmp_path / "x"), links=corpus.edges)
    written = J.semantic_documents(corpus.nodes)
    assert "embedding" not in written.schema.simpleString()
    J.write_json(written, str(tmp_path / "semantic"))
    back = J.semantic_nodes(J.read_semantic(spark, str(tmp_path / "semantic"), required=True, lines=True))
    assert back.count() == corpus.nodes.count()


def test_wrappers_are_overrides(spark, small, tmp_path):
    corpus = P.build(D.nodes(spark, small), str(tmp_path / "corpus"), G.link_captions(D.links_input(spark, small)), F.col("region_class").isin("title", "abstract"))
    q = D.queries(spark, small).drop("role_filter")
    rows = lambda r: sorted(tuple(x) for x in r.ranked.select("query_id", "node_id", "final_rank", "final_score").collect())
    for name, wrapper in (("figure", R.retrieve_figure), ("definition", R.retrieve_definition)):
        one = wrapper(corpus.index, corpus.nodes, corpus.edges, q)
        other = R.retrieve(corpus.index, corpus.nodes, corpus.edges, q.withColumn("intent_override", F.lit(name)))
        assert rows(one) == rows(other) and {r.intent_source for r in one.queries.collect()} == {"override"}


def test_comparison_goes_on_after_an_error(spark):
    q = spark.createDataFrame([(1, [10], ["R"]), (2, [], [])], "query_id long, relevant_ids array<long>, relevant_roles array<string>")

    def broken(queries):
        raise RuntimeError("no index")

    good = lambda queries: queries.select("query_id", (F.col("query_id") * 10).alias("node_id"), F.lit("X").alias("role"), F.lit(1).alias("rank"))
    found = E.compare(q, {"good": good, "broken": broken})
    assert found.errors == {"broken": "no index"}
    got = {(r.system, r.k): r for r in found.reports.collect()}
    assert got["good", 5].mean_rr == 0.5 and got["broken", 5].mean_rr == 0 and got["broken", 10].n_queries == 2
    assert all(r.mean_latency_ms >= 0 for r in got.values())


def test_answers_in_pieces(spark):
    prompts = spark.createDataFrame([(1, "a b"), (2, "bad")], "query_id long, prompt string")

    def words(rules, prompt, temperature=0.1):
        for w in prompt.split():
            if w == "bad":
                raise RuntimeError("cut off")
            yield f"{w}@{temperature}"

    got = sorted(tuple(r) for r in Q.stream(prompts, words, temperature=0.7).collect())
    assert got == [(1, 0, "a@0.7", None), (1, 1, "b@0.7", None), (2, 0, "", "cut off")]
    hot = lambda rules, prompt, temperature=0.1: str(temperature)
    assert {r.response for r in Q.generate(prompts, hot, temperature=0.9).collect()} == {"0.9"} and {r.response for r in Q.generate(prompts, hot).collect()} == {"0.1"}


def test_roles_by_a_plain_softmax(spark, small):
    import numpy as np

    rows = [(r.block_id, r.text) for r in D.blocks(spark, small).where("doc_id < 20").collect()]
    model = S.RoleModel(spark)
    got = {r.block_id: (r.scholarly_role, r.role_confidence) for r in model.classify(S.encode(spark.createDataFrame([(*r, "paragraph") for r in rows], "block_id string, text string, region_class string"))).collect()}
    z = S.hashed_vectors([t for _, t in rows]).astype(float) @ model.weights.T + model.bias
    for (block, text), row in zip(rows, z):
        p = np.exp(row - row.max()) / np.exp(row - row.max()).sum()
        role, confidence = got[block]
        assert confidence == (pytest.approx(p.max(), abs=1e-4) if text.strip() else 0.0)
        assert not text.strip() or p[model.roles.index(role)] == pytest.approx(p.max(), abs=1e-9)
    # At the optimum, the gradient of the mean loss with its penalty is 0.
    x, y = S.hashed_vectors([t for t, _ in S.CORPUS]).astype(float), np.array([model.roles.index(r) for _, r in S.CORPUS])
    e = np.exp(x @ model.weights.T + model.bias)
    e = e / e.sum(axis=1, keepdims=True) - np.eye(len(model.roles))[y]
    assert np.abs(e.T @ x / len(y) + model.weights / len(y)).max() < 1e-3


def plain_vectors(texts, dim=S.DIM):
    out = np.zeros((len(texts), dim), np.float32)
    for k, text in enumerate(texts):
        for word in text.lower().split():
            marked = f"<{word}>"
            for part in (word, *(marked[i : i + 3] for i in range(len(marked) - 2))):
                h = zlib.crc32(part.encode())
                out[k, h % dim] += 1.0 if h >> 31 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def test_words_are_hashed_all_at_once():
    chars = [*range(128), *range(0xA0, 0x250), 0x85, 0x130, 0x3A3, 0x2028, 0x3000, 0x4E00, 0x1F600]
    pick = np.random.default_rng(3)
    texts = ["", " ", "a", "<a>", "x" * 300 + " " + "y" * 64 + " " + "z" * 65, "ΑΣ é", "日本語 😀x"]
    texts += ["".join(chr(chars[k]) for k in pick.integers(0, len(chars), pick.integers(0, 200))) for _ in range(700)]
    assert (S.hashed_vectors(texts) == plain_vectors(texts)).all() and S.hashed_vectors([]).shape == (0, S.DIM)


def test_packed_vectors_come_back():
    whole, long, floats = plain_vectors(["a bc", "", "some more words", "a a"]), plain_vectors(["", "ab " * 200]), np.random.default_rng(1).normal(size=(3, S.DIM)).astype(np.float32)
    for v in (whole, long, floats, np.concatenate([whole, floats]), floats.astype(float) / 3):
        column = packed.pack(v)
        assert (packed.unpack(column) == v).all() and (packed.unpack(column.slice(1)) == v[1:]).all()
    assert len(packed.unpack(packed.pack(whole[:0]))) == 0
    assert [len(x) for x in packed.pack(whole).to_pylist()] == [S.DIM + 1] * 4
    assert [len(x) for x in packed.pack(plain_vectors(["ab " * 200 + "c"])).to_pylist()] == [2 * S.DIM + 1]


def test_a_corpus_is_dealt_once_and_stored_small(spark, small, tmp_path, monkeypatch):
    """Texts are shuffled once until nodes are written, vectors take a byte or two a place, and the index has no texts."""
    monkeypatch.setattr(T, "EXACT_ROWS", 50)
    monkeypatch.setattr(T, "LIST_ROWS", 60)
    blocks = D.blocks(spark, small)
    nodes = G.assign_sections(G.distinct_nodes(P.numbered(P.region_nodes(P.regions_of(blocks)))))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 3 and plan.count("Exchange") == 3
    corpus = P.build_from_blocks(blocks, str(tmp_path / "corpus"))
    assert corpus.kind == "ivf" and "text" not in corpus.index.columns and "list" in corpus.index.columns
    rows = corpus.nodes.join(blocks.select(F.col("block_id"), F.col("text").alias("whole")), F.col("source_block_ids")[0] == F.col("block_id")).select("whole", "embedding", "role", "region_class").collect()
    assert len(rows) == blocks.count() and sum(len(r.embedding) for r in rows) < 1.1 * len(rows) * (S.DIM + 1)
    got = packed.unpack(pa.array([r.embedding for r in rows], pa.binary()))
    assert (got == plain_vectors([r.whole if r.whole.strip() else S.EMPTY for r in rows])).all()
    q = P.encode_queries(E.query_bank(spark).select("query_id", "query")).withColumn("role_filter", F.lit(None).cast("string"))
    ids = lambda df: {(r.query_id, r.node_id, r.rank) for r in df.collect()}
    assert ids(V.search(corpus.index, q, centroids=corpus.centroids)) == ids(V.search(corpus.index, q))
    model = S.RoleModel(spark)
    told = model.classify(S.encode(spark.createDataFrame([(r.whole, r.region_class) for r in rows], "text string, region_class string"))).collect()
    assert sorted((r.text, r.scholarly_role) for r in told) == sorted((r.whole, r.role) for r in rows)


def test_blank_ends_and_shares(spark):
    texts = ["", " a ", "a ", "a  ", " \t\n\x0b\f\ra b\r\n", "a \x85", "\xa0a\xa0", "\x1ca", "±a", "é±", "abc"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select(strip(F.col("t")).alias("a"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("b"), char_share(F.col("t"), T.MATH_CHARS).alias("s"), "t").collect()
    assert all(r.a == r.b for r in got)
    assert [r.s for r in got if r.t is not None] == [sum(c in T.MATH_CHARS for c in t) / max(len(t), 1) for t in texts]
