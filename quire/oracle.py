"""SQL that another engine runs over the same tables, for each registered query that SQL can express."""

from __future__ import annotations

from functools import reduce

from .functions import tables as T
from .sources.derive import CLASSES, LABEL_ROLES, PREFIXES


def r4(x: str) -> str:
    return f"(floor(({x}) * 1e4 + 0.5) / 1e4)"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def names(xs) -> str:
    return "(" + ", ".join(map(text, xs)) + ")"


def case(x: str, pairs, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + f" ELSE {other} END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_class = case("vec_id % 10", [(k, text(c)) for k, c in enumerate(CLASSES) if k > 1], "'paragraph'")
_role = case("label % 6", [(k, text(r)) for k, r in enumerate(LABEL_ROLES[:-1])], "'N/A'")
_dot = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_noise = "(region_class IN ('header', 'footer') OR role = 'N/A')"
_refs = rf"'(?i)(?:^|[^\p{{L}}\p{{N}}_])(fig(?:ure)?s?|tab(?:le)?s?)\.?\s*(\d+)'"

# Tables that build on those before them; a query names the last it needs.
CTE: dict[str, str] = {
    "n0": f"""SELECT vec_id, label, embedding, CASE WHEN vec_id % 20 = 0 THEN 'title' WHEN vec_id % 50 = 21 THEN 'abstract'
        WHEN vec_id % 10 < 2 THEN 'paragraph' ELSE {_class} END AS region_class FROM embeddings""",
    "raw": f"""SELECT vec_id AS node_id, vec_id // 100 AS doc, cast((vec_id % 100) // 50 AS INT) AS page, ((vec_id * 37) % 80) * 10.0::DOUBLE AS y0,
        region_class, CASE WHEN region_class IN ('figure', 'table') THEN 'N/A' ELSE {_role} END AS role,
        ((vec_id * 7919) % 10000) / 10000.0::DOUBLE AS role_confidence, CASE WHEN region_class = 'figure' THEN 0.95 ELSE 0.8 END AS confidence,
        substring(d.text, 1, {T.INDEX_CHARS}) AS text, embedding, vec_id AS node_seq FROM n0 LEFT JOIN documents d ON d.doc_id = n0.vec_id""",
    "nodes": f"""SELECT *, CASE WHEN section_id IS NOT NULL THEN 's' || section_id ELSE 'p' || page END AS sec_key FROM (
        SELECT * REPLACE (coalesce(text, '') AS text), {_noise} AS is_noise, last_value(CASE WHEN region_class IN ('title', 'abstract') THEN node_id END IGNORE NULLS)
        OVER (PARTITION BY doc ORDER BY page, y0, node_seq ROWS UNBOUNDED PRECEDING) AS section_id FROM raw)""",
    "idx": f"""SELECT * REPLACE (list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')})) AS embedding) FROM nodes
        WHERE NOT is_noise AND length({strip('text')}) >= {T.INDEX_MIN_CHARS}""",
    "q": f"""SELECT vec_id AS query_id, {case('(vec_id // 50) % 8', [(k, text(x[0])) for k, x in enumerate(T.EVAL_QUERIES)], 'NULL')} AS query,
        list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')})) AS qvec,
        CASE WHEN vec_id % 100 = 0 AND {_role} <> 'N/A' THEN {_role} END AS role_filter FROM embeddings WHERE vec_id % 50 = 0""",
    "sim": """SELECT query_id, role_filter, node_id, role, list_dot_product(embedding, qvec) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY floor(list_dot_product(embedding, qvec) * 1e9 + 0.5) DESC, node_id) AS raw_rank FROM q, idx""",
    "seeds": """SELECT query_id, node_id, role, score, raw_rank AS rank FROM sim WHERE raw_rank <= 5""",
    # Links of captions and all edges.
    "cap": f"""SELECT doc, node_id AS caption_id, page AS cp, embedding AS ce, node_seq AS cs, CASE WHEN node_id % 20 < 10 THEN 'figure' ELSE 'table' END AS kind
        FROM raw WHERE region_class = 'caption'""",
    "sl": f"""SELECT cap.doc, caption_id, node_id AS target_id, cs, node_seq AS ts,
        CASE WHEN kind = region_class AND cp = page THEN 1.0 WHEN kind = region_class THEN 0.3 ELSE 0.0 END::DOUBLE AS r,
        ({_dot('ce', 'embedding')} / (sqrt({_dot('ce', 'ce')}) * sqrt({_dot('embedding', 'embedding')})) + 1) / 2 AS e
        FROM cap JOIN raw USING (doc) WHERE region_class IN ('figure', 'table')""",
    "links": f"""SELECT doc, caption_id, target_id, {r4('r')} AS s_ref, {r4('e')} AS s_emb, s_link, link_rank, cs * 1000 + link_rank AS link_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY doc, caption_id ORDER BY s_link DESC, ts) AS link_rank FROM (
        SELECT *, {r4('0.7::DOUBLE * r + (1 - 0.7::DOUBLE) * e')} AS s_link FROM sl)) WHERE link_rank <= 3""",
    "mm": f"""SELECT doc, caption_id AS src, target_id AS tgt, 'refers_to' AS relation, {r4('s_link')} AS weight, 'multimodal' AS edge_source,
        0 AS stage, link_pos AS o1, 0 AS o2, 0 AS o3, 0 AS o4 FROM links WHERE s_link >= 0.3""",
    "rules": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {text(s)}, {text(t)}, {text(r)}, {T.DEFINITION_EDGES if s == 'Definition' else T.ROLE_EDGES})" for k, (s, t, r) in enumerate(T.ROLE_RULES)) + ") v(rule_no, src_role, tgt_role, relation, cap)",
    "src": """SELECT n.doc, n.page, n.sec_key, n.node_id AS src, n.node_seq AS src_seq, n.role_confidence AS src_rc, r.rule_no, r.tgt_role, r.relation, r.cap
        FROM nodes n JOIN rules r ON n.role = r.src_role WHERE NOT n.is_noise""",
    "tgt": """SELECT doc, page, sec_key, role, node_id AS tgt, node_seq AS tgt_seq, role_confidence AS tgt_rc,
        min(node_seq) OVER (PARTITION BY doc, role, sec_key, page) AS bucket_seq FROM nodes WHERE NOT is_noise""",
    "near": "SELECT src.*, tgt, tgt_seq, tgt_rc, bucket_seq FROM src JOIN tgt ON src.doc = tgt.doc AND src.page = tgt.page AND src.sec_key = tgt.sec_key AND tgt.role = src.tgt_role",
    "far": """SELECT src.*, tgt, tgt_seq, tgt_rc, bucket_seq FROM src JOIN tgt ON src.doc = tgt.doc AND src.page = tgt.page AND tgt.role = src.tgt_role
        WHERE NOT EXISTS (SELECT 1 FROM near x WHERE x.src = src.src AND x.rule_no = src.rule_no)""",
    "re": f"""SELECT doc, src, tgt, relation, greatest({r4('CASE WHEN tgt_rc > 0 THEN (src_rc + tgt_rc) / 2 ELSE src_rc END')}, 0.1::DOUBLE) AS weight,
        'semantic_role' AS edge_source, 1 AS stage, rule_no AS o1, src_seq AS o2, bucket_seq AS o3, tgt_seq AS o4 FROM (
        SELECT *, row_number() OVER (PARTITION BY doc, src, rule_no ORDER BY bucket_seq, tgt_seq) AS k FROM (SELECT * FROM near UNION ALL SELECT * FROM far)) WHERE k <= cap""",
    "defs": "SELECT *, min(node_seq) OVER (PARTITION BY doc, sec_key) AS group_seq FROM nodes WHERE role = 'Definition' AND NOT is_noise",
    "co": f"""SELECT doc, src, tgt, 'co_section' AS relation, {r4('greatest(rc, 0.1::DOUBLE)')} AS weight, 'co_section' AS edge_source, 2 AS stage, group_seq AS o1, src_seq AS o2, tgt_seq AS o3, 0 AS o4 FROM (
        SELECT a.doc, a.node_id AS src, a.node_seq AS src_seq, a.role_confidence AS rc, a.group_seq, b.node_id AS tgt, b.node_seq AS tgt_seq,
        row_number() OVER (PARTITION BY a.doc, a.node_id ORDER BY b.node_seq) AS k FROM defs a JOIN defs b ON a.doc = b.doc AND a.sec_key = b.sec_key AND a.node_id <> b.node_id) WHERE k <= 3""",
    "ct0": "SELECT doc, section_id AS src, node_id AS tgt, 'contains' AS relation, 1.0::DOUBLE AS weight, 'section' AS edge_source, 3 AS stage, node_seq AS o1, 0 AS o2, 0 AS o3, 0 AS o4 FROM nodes WHERE section_id IS NOT NULL AND region_class <> 'title'",
    "e0": "SELECT * FROM mm UNION ALL SELECT * FROM re UNION ALL SELECT * FROM co",
    "edges": """SELECT doc, src, tgt, relation, weight, edge_source, row_number() OVER (PARTITION BY doc ORDER BY stage, o1, o2, o3, o4) AS edge_seq FROM (
        SELECT * FROM e0 UNION ALL SELECT * FROM ct0 WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.doc = ct0.doc AND e0.src = ct0.src AND e0.tgt = ct0.tgt))""",
}


def intents(patterns) -> str:
    count = lambda ps: " + ".join(f"regexp_matches(lower(query), {text(p)})::INT" for p in ps)
    hits = ", ".join(f"{count(ps)} AS h{k}" for k, ps in enumerate(patterns.values()))
    n = len(patterns)
    best = "greatest(" + ", ".join(f"h{k}" for k in range(n)) + ")"
    ties = " + ".join(f"(h{k} = best)::INT" for k in range(n))
    first = "CASE " + " ".join(f"WHEN h{k} = best THEN {text(i)}" for k, i in enumerate(patterns)) + " END"
    size = "CASE " + " ".join(f"WHEN h{k} = best THEN {len(ps)}" for k, ps in enumerate(patterns.values())) + " END"
    return f"""SELECT query_id, CASE WHEN best = 0 OR {ties} > 1 THEN 'general' ELSE {first} END AS intent,
        CASE WHEN best = 0 THEN 0.0::DOUBLE ELSE floor(least(1.0, best::DOUBLE / {size}) * 1e3 + 0.5) / 1e3 END AS intent_conf
        FROM (SELECT *, {best} AS best FROM (SELECT query_id, {hits} FROM qs))"""


def _follows() -> str:
    rows = [(i, d, r, T.RELATION_WEIGHTS.get(r, T.OTHER_RELATION)) for d, t in enumerate((T.INTENT_OUT, T.INTENT_IN)) for i, rs in t.items() for r in rs]
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(i)}, {d}, {text(r)}, {m}::DOUBLE)" for i, d, r, m in rows) + ") v(intent, direction, relation, multiplier)"


_used = f"CASE WHEN intent_conf < {T.WEAK_INTENT} AND main_role IS NOT NULL THEN lower(main_role) ELSE intent END"
SETTLE = {
    "main": """SELECT query_id, role AS main_role FROM (SELECT query_id, role, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS k
        FROM seeds WHERE role <> 'N/A' GROUP BY query_id, role) WHERE k = 1""",
    "used": f"""SELECT i.*, {_used} AS intent_used, CASE WHEN intent_conf < {T.WEAK_INTENT} AND main_role IS NOT NULL THEN 'role' ELSE 'classifier' END AS intent_source
        FROM intent i LEFT JOIN main USING (query_id)""",
}


def expansion() -> dict[str, str]:
    return {
        "qs": "SELECT * FROM q",
        "intent": intents(T.INTENT_PATTERNS),
        **SETTLE,
        "follows": _follows(),
        "way": "SELECT 0 AS direction, src AS seed_id, tgt AS node_id, relation, weight, edge_seq FROM edges UNION ALL SELECT 1, tgt, src, relation, weight, edge_seq FROM edges",
        "h0": f"""SELECT s.query_id, s.node_id AS seed_id, s.rank AS seed_rank, w.node_id, w.direction, w.relation, w.edge_seq, {r4('w.weight * f.multiplier')} AS weighted
        FROM seeds s JOIN used u USING (query_id) JOIN follows f ON f.intent = u.intent_used JOIN way w ON w.seed_id = s.node_id AND w.direction = f.direction AND w.relation = f.relation
        WHERE {r4('w.weight * f.multiplier')} >= {T.MIN_GRAPH_SCORE} AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.node_id = w.node_id)""",
        "h1": "SELECT *, row_number() OVER (PARTITION BY query_id, seed_id ORDER BY direction, edge_seq) AS k FROM h0",
        "hits": """SELECT query_id, seed_id, node_id, weighted, CASE WHEN direction = 1 THEN '←' ELSE '' END || relation AS relation, hit_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, direction, edge_seq) AS hit_pos FROM h1 WHERE k <= 3) WHERE hit_pos <= 4""",
    }


def ranking(alpha: float, bonus: str, rounded: bool, last: str = "none", final_k: int = T.FINAL_K) -> dict[str, str]:
    base = f"{alpha}::DOUBLE * score + (1 - {alpha}::DOUBLE) * g"
    base = r4(base) if rounded else f"({base})"
    other = {"none": "0", "role": "CASE WHEN role_filter IS NOT NULL AND role <> role_filter THEN 1 ELSE 0 END"}[last]
    return {
        "rows0": f"""SELECT query_id, node_id, {r4('score')} AS score, 0.0::DOUBLE AS g, true AS is_seed, rank AS pos, '' AS relation_path, origin FROM seeds1 UNION ALL
        SELECT query_id, node_id, 0.0, max(weighted), false, min(hit_pos), string_agg(relation, ',' ORDER BY hit_pos), 'expansion' FROM hits GROUP BY query_id, node_id""",
        "rows1": f"SELECT *, {r4(base + f' + CASE WHEN is_seed THEN {bonus} ELSE 0.0 END')} AS final_score FROM rows0",
        "rows2": "SELECT r.*, n.doc, n.role, n.page, n.region_class, n.text, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, is_seed DESC, pos) AS first_rank FROM rows1 r JOIN nodes n USING (node_id)",
        "ranked": f"""SELECT * FROM (SELECT rows2.*, row_number() OVER (PARTITION BY query_id ORDER BY {other}, first_rank) AS final_rank FROM rows2 JOIN q USING (query_id)) WHERE final_rank <= {final_k}""",
    }


SEEDS1 = {"seeds1": "SELECT *, 'seed' AS origin FROM seeds"}
SUBGRAPH = {"sub": "SELECT a.query_id, e.* FROM edges e JOIN ranked a ON a.node_id = e.src JOIN ranked b ON b.node_id = e.tgt AND b.query_id = a.query_id"}


def with_(upto: str | None, final: str, extra: dict[str, str] | None = None) -> str:
    """A query over the tables up to one of CTE, then others."""
    chosen: dict[str, str] = {}
    for k, v in CTE.items():
        if upto is None:
            break
        chosen[k] = v
        if k == upto:
            break
    chosen |= extra or {}
    return ("WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in chosen.items()) + "\n" if chosen else "") + final


def hybrid(final: str, last: str = "none", extra: dict[str, str] | None = None) -> str:
    return with_("edges", final, {**expansion(), **SEEDS1, **ranking(T.ALPHA, str(T.SEED_BONUS), True, last), **SUBGRAPH, **(extra or {})})


EDGE = "doc, src, tgt, relation, weight, edge_source"
HIT = f"query_id, node_id, role, rank, {r4('score')} AS score"
FILTERED = """SELECT * FROM (SELECT query_id, node_id, role, score, row_number() OVER (PARTITION BY query_id ORDER BY raw_rank) AS rank
    FROM sim WHERE raw_rank <= 30 AND (role_filter IS NULL OR role = role_filter)) WHERE rank <= 5"""
RANKED = "query_id, node_id, role, origin, score AS similarity, g AS graph_score, final_score, final_rank"
RESCUE = {
    "lone": "SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM seeds WHERE role = 'Observation')",
    "res": """SELECT * FROM (SELECT query_id, node_id, role, score, row_number() OVER (PARTITION BY query_id ORDER BY raw_rank) AS rank
        FROM sim JOIN lone USING (query_id) WHERE raw_rank <= 18 AND role = 'Observation') WHERE rank <= 3""",
    "seeds1": """SELECT query_id, node_id, role, score, rank, 'seed' AS origin FROM seeds UNION ALL SELECT query_id, node_id, role, score,
        coalesce((SELECT max(rank) FROM seeds s WHERE s.query_id = res.query_id), 0) + row_number() OVER (PARTITION BY query_id ORDER BY rank), 'rescue'
        FROM res WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = res.query_id AND s.node_id = res.node_id)""",
}


def v3() -> str:
    e = expansion()
    e["intent"] = intents(T.INTENT_PATTERNS_V3)
    # From here on, the rescued rows are seeds too.
    chain: dict[str, str] = {**RESCUE, "s3": "SELECT * FROM seeds1"}
    for k, v in e.items():
        chain[k] = v.replace("FROM seeds ", "FROM s3 ")
    return with_("edges", f"SELECT {RANKED} FROM ranked", {**chain, **ranking(T.ALPHA_V3, f"{r4(f'{T.BONUS_V3}::DOUBLE * pow({T.DECAY_V3}::DOUBLE, pos - 1)')}", False, "role")})


# Evaluation.
def _eval(final: str) -> str:
    more = {
        "eq": "SELECT query_id, [query_id + 1, query_id + 50] AS ids, role_filter AS wanted, 'q' || (query_id % 3) AS description, 2 AS n_relevant FROM q",
        "lists": """SELECT 'vector' AS system, query_id, node_id, role, raw_rank AS rank FROM sim WHERE raw_rank <= 10 UNION ALL
        SELECT 'hybrid', query_id, node_id, role, final_rank FROM ranked""",
        "marked": "SELECT l.*, (list_contains(ids, node_id) OR coalesce(role = wanted, false)) AS hit FROM lists l JOIN eq USING (query_id)",
        "ks": "SELECT unnest([5, 10]) AS k",
        "own": """SELECT system, query_id, k, count(*) FILTER (WHERE hit AND rank <= k) AS n, coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE hit AND rank <= k), 0) AS dcg,
        min(rank) FILTER (WHERE hit) AS first FROM marked, ks GROUP BY ALL""",
        "per": """SELECT s.system, eq.query_id, ks.k, coalesce(n, 0) / ks.k::DOUBLE AS precision, coalesce(n, 0) / n_relevant::DOUBLE AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr,
        CASE WHEN coalesce(n, 0) > 0 THEN dcg / (SELECT sum(1 / log2(i + 1.0)) FROM unnest(range(1, n + 1)) t(i)) ELSE 0 END AS ndcg, (coalesce(n, 0) > 0)::INT::DOUBLE AS hit_rate
        FROM eq CROSS JOIN (SELECT unnest(['vector', 'hybrid']) AS system) s CROSS JOIN ks LEFT JOIN own ON own.system = s.system AND own.query_id = eq.query_id AND own.k = ks.k""",
        "rep": "SELECT system, k, avg(precision) AS mp, avg(recall) AS mr, avg(rr) AS mrr, avg(ndcg) AS mn, avg(hit_rate) AS mh, count(*) AS n_queries FROM per GROUP BY ALL",
    }
    return hybrid(final, extra=more)


_ten = lambda x: r4(f"{x} + 10.0")

# Blocks and regions.
_prefix = "CASE " + " ".join(f"WHEN (doc_id * 7 + pos) % {n} = 0 THEN {text(w)}" for n, w in PREFIXES) + " ELSE '' END"


def _share(x: str, chars: str) -> str:
    return f"(CASE WHEN length({x}) > 0 THEN (length({x}) - length(translate({x}, {text(chars)}, ''))) / length({x})::DOUBLE ELSE 0 END)"


def _iou(a: str, b: str) -> tuple[str, str, str]:
    area = lambda p: f"(greatest(0, {p}x1 - {p}x0) * greatest(0, {p}y1 - {p}y0))"
    inter = f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"
    union = f"({area(a)} + {area(b)} - {inter})"
    iou = f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"
    return iou, f"(CASE WHEN {area(a)} > 0 THEN {inter} / {area(a)} ELSE 0 END)", inter


IOU, INSIDE, _ = _iou("b.", "r.")
SMAP = f"(0.6::DOUBLE * {IOU} + (1 - 0.6::DOUBLE) * {INSIDE})"
IOU_DR, _, _ = _iou("d.", "r.")
_rank = "CASE " + "{c} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in T.SPECIFICITY.items()) + " ELSE 0 END"
_row = rf"list_filter(ls, lambda x: regexp_matches(x, {text(T.TABLE_ROW)}))"
_data = rf"list_filter(ls, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda t: t <> '')) >= 3 AND len(list_filter(string_split_regex(x, '\s+'), lambda t: regexp_matches(t, {text(T.NUMERIC_TOKEN)}))) > 0 AND len(list_filter(string_split_regex(x, '\s+'), lambda t: length(t) > 15)) = 0)"
_words = r"len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))"
_m = lambda p: f"regexp_matches(t, {text(p)})"
_md5 = lambda *parts: "substring(md5(" + " || ".join(parts) + "), 1, 12)"
LAYOUT = {
    "lines": "SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)",
    "said": f"SELECT doc_id, pos, {_prefix} || line AS text FROM lines WHERE line <> ''",
    "blocks": """SELECT doc_id, cast(pos // 12 AS INT) AS page_index, pos AS block_pos, doc_id || '-' || pos AS block_id, text, 20.0::DOUBLE + 290 * (pos % 2) AS x0, 30.0::DOUBLE + 62 * (pos % 12) AS y0,
        20.0::DOUBLE + 290 * (pos % 2) + least(250.0::DOUBLE, 4.0::DOUBLE * length(text)) AS x1, 30.0::DOUBLE + 62 * (pos % 12) + 12 * (1 + length(text) // 60) AS y1, 9.0::DOUBLE + length(text) % 5 AS font_size,
        length(text) % 7 = 0 AS is_bold FROM said""",
    "fonts": "SELECT doc_id, page_index, list_sort(list(font_size))[count(*) // 2 + 1] AS median_font FROM blocks GROUP BY ALL",
    "caps": f"SELECT doc_id, page_index, y0 AS cy0, y1 AS cy1 FROM blocks WHERE regexp_matches({strip('text')}, {text(T.TABLE_CAPTION)})",
    "near": "SELECT b.*, EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = b.doc_id AND c.page_index = b.page_index AND b.y0 > cy0 AND b.y0 - cy1 < 40) AS near_table_caption FROM blocks b",
    "ctx": f"SELECT n.*, median_font AS md, {strip('text')} AS t, list_filter(string_split({strip('text')}, chr(10)), lambda x: {strip('x')} <> '') AS ls FROM near n JOIN fonts USING (doc_id, page_index)",
    "regions": f"""SELECT *, {_md5('doc_id', "'::layout::p'", 'page_index', "'::r'", 'region_pos')} AS region_id FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_pos) - 1 AS region_pos, CASE
        WHEN is_bold AND font_size >= md * 1.4::DOUBLE AND y0 < 842 * 0.40::DOUBLE AND page_index <= 1 AND length(t) < 150 THEN 'title'
        WHEN y1 <= 842 * 0.09::DOUBLE THEN 'header'
        WHEN y0 >= 842 - 842 * 0.10::DOUBLE OR (y0 >= 842 * 0.85::DOUBLE AND {_m(T.PAGE_NUMBER)} AND x1 - x0 <= 50) THEN 'footer'
        WHEN {_m(T.CAPTION)} THEN 'caption'
        WHEN {_share('t', T.MATH_CHARS)} > 0.06 THEN 'equation'
        WHEN page_index <= 1 AND {_m(T.ABSTRACT)} THEN 'abstract'
        WHEN length(t) < 150 AND ((is_bold AND {_m(T.SECTION_NUMBER)}) OR (is_bold AND font_size >= md * 1.15::DOUBLE) OR (font_size >= md * 1.20::DOUBLE AND {_m(T.SECTION_NUMBER)})) THEN 'title'
        WHEN len(ls) > 0 AND (len({_row}) >= 2 OR len({_data}) >= 2 OR near_table_caption) THEN 'table'
        WHEN {_m(T.REFERENCE_BRACKET)} OR ({_m(T.REFERENCE_NUMBERED)} AND NOT (is_bold AND {_words} <= 8)) THEN 'reference'
        WHEN lower(t) LIKE 'algorithm%' AND length(t) > 30 THEN 'algorithm'
        WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {text(T.BULLET)}))) >= 2 OR (len(string_split(t, chr(10))) = 1 AND {_m(T.BULLET)}) THEN 'list'
        ELSE 'paragraph' END AS region_class FROM ctx)""",
    "det": """SELECT doc_id, page_index, region_pos, 'm' || region_id AS region_id, CASE WHEN (doc_id + region_pos) % 2 = 0 THEN 'paragraph' ELSE region_class END AS region_class,
        x0 + j AS x0, y0 + j AS y0, x1 + j AS x1, y1 + j AS y1 FROM (SELECT *, (doc_id * 31 + region_pos * 17) % 11 - 5 AS j FROM regions WHERE (doc_id + region_pos) % 3 <> 0)""",
    "scored": f"SELECT b.doc_id, b.page_index, b.block_id, b.block_pos, b.text, r.region_id, r.region_class, r.region_pos, {SMAP} AS s, {IOU} AS i FROM blocks b JOIN det r USING (doc_id, page_index)",
    "al": f"""SELECT doc_id, page_index, block_id, block_pos, text, CASE WHEN s >= 0.3 AND s > 0 THEN region_id ELSE '' END AS region_id, CASE WHEN s >= 0.3 AND s > 0 THEN region_class ELSE 'unknown' END AS region_class,
        {r4('s')} AS score, NOT (s >= 0.3 AND s > 0) AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, block_pos ORDER BY s DESC, region_pos) AS k FROM scored) WHERE k = 1""",
    "una": "SELECT doc_id, block_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.block_id = b.block_id AND NOT flagged)",
    "best": f"""SELECT * FROM (SELECT d.doc_id, d.page_index, d.region_pos AS d_pos, r.region_pos AS r_pos, r.region_class AS r_class, row_number() OVER (PARTITION BY d.doc_id, d.page_index, d.region_pos ORDER BY {IOU_DR} DESC, r.region_pos) AS k
        FROM det d JOIN regions r USING (doc_id, page_index) WHERE {IOU_DR} >= 0.3) WHERE k = 1""",
    "fused": f"""SELECT d.doc_id, d.page_index, d.region_id, CASE WHEN r_pos IS NOT NULL AND {_rank.format(c='r_class')} > {_rank.format(c='d.region_class')} THEN r_class ELSE d.region_class END AS region_class,
        CASE WHEN r_pos IS NOT NULL AND {_rank.format(c='r_class')} > {_rank.format(c='d.region_class')} THEN (0.9::DOUBLE + 0.8::DOUBLE) / 2 ELSE 0.9::DOUBLE END AS confidence,
        CASE WHEN r_pos IS NOT NULL THEN 'hybrid' ELSE 'detector' END AS backend, d.y0, d.x0, 0 AS late, d.region_pos AS pos
        FROM det d LEFT JOIN best ON best.doc_id = d.doc_id AND best.page_index = d.page_index AND best.d_pos = d.region_pos UNION ALL
        SELECT doc_id, page_index, region_id, region_class, 0.8::DOUBLE, 'heuristic', y0, x0, 1, region_pos FROM regions r
        WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.doc_id = r.doc_id AND best.page_index = r.page_index AND best.r_pos = r.region_pos)""",
}


def layout(upto: str, final: str, extra: dict[str, str] | None = None) -> str:
    keys = list(LAYOUT)
    return with_(None, final, {k: LAYOUT[k] for k in keys[: keys.index(upto) + 1]} | (extra or {}))


_cut = lambda k: f"substring(text, cast({k} * n3 + 1 AS BIGINT), n3)"
_flag = lambda k: f"((length(text) * ({k} + 3)) % 32)"
SPANS = {
    "sp": "SELECT *, cast(ceil(length(text) / 3.0::DOUBLE) AS BIGINT) AS n3 FROM blocks WHERE block_pos % 9 <> 8 AND (x1 - x0) * (y1 - y0) >= 10",
}
SPANS["joined"] = f"""SELECT *, {strip("array_to_string(list_filter([" + ", ".join(strip(_cut(k)) for k in range(3)) + "], lambda x: x <> ''), ' ')")} AS txt FROM sp"""
_len = lambda k: f"length({_cut(k)})"
_pick = f"CASE WHEN {_len(0)} >= {_len(1)} AND {_len(0)} >= {_len(2)} THEN 0 WHEN {_len(1)} >= {_len(2)} THEN 1 ELSE 2 END"
OCR = """WITH w AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, ' ') AS ls FROM documents WHERE text IS NOT NULL)),
u AS (SELECT *, ((k * 37) % 101 - 5)::DOUBLE AS conf, (k % 12 * 40)::DOUBLE AS l, (k // 12 * 20)::DOUBLE AS t FROM w)
"""

ORACLE: dict[str, str] = {
    "vector_topk": with_("seeds", f"SELECT {HIT} FROM seeds"),
    "ivf_topk": with_("seeds", f"SELECT {HIT} FROM seeds"),
    "vector_topk_role_filter": with_("sim", f"SELECT {HIT} FROM ({FILTERED})"),
    "vector_topk_batch": with_("sim", f"SELECT query_id, node_id, role, raw_rank AS rank, {r4('score')} AS score FROM sim WHERE raw_rank <= 10"),
    "index_admission": with_("idx", "SELECT node_id, role, length(text) AS n_chars FROM idx"),
    "index_role_histogram": with_("idx", "SELECT role, count(*) AS n FROM idx GROUP BY role"),
    "index_validate": with_("idx", "SELECT count(*) AS n_rows, count(*) > 0 AS built, count(*) = count(DISTINCT node_id) AS ids_match, count(*) > 0 AND count(*) FILTER (WHERE is_noise) < count(*) AS has_useful FROM idx"),
    "graph_nodes": with_("nodes", "SELECT doc, node_id, page, y0, region_class, role, role_confidence, is_noise, length(text) AS n_chars FROM nodes"),
    "section_assignment": with_("nodes", "SELECT doc, node_id, section_id, sec_key FROM nodes"),
    "link_captions": with_("links", "SELECT doc, caption_id, target_id, s_ref, s_emb, s_link, link_rank FROM links"),
    "multimodal_edges": with_("mm", f"SELECT {EDGE} FROM mm"),
    "role_edges": with_("re", f"SELECT {EDGE} FROM re"),
    "co_section_edges": with_("co", f"SELECT {EDGE} FROM co"),
    "contains_edges": with_("ct0", f"SELECT {EDGE} FROM ct0"),
    "graph_edges_all": with_("edges", f"SELECT {EDGE}, edge_seq FROM edges"),
    "graph_edge_counts": with_("edges", "SELECT edge_source, relation, count(*) AS n FROM edges GROUP BY ALL"),
    "bfs_relation_k2": with_("edges", "SELECT doc, start, node_id, min(hop) AS hop FROM walk WHERE node_id <> start GROUP BY ALL", {"walk": """SELECT doc, node_id AS start, node_id, 0 AS hop FROM nodes WHERE role = 'Definition' AND NOT is_noise
        UNION SELECT w.doc, w.start, e.tgt, w.hop + 1 FROM walk w JOIN edges e ON e.doc = w.doc AND e.src = w.node_id AND e.relation = 'co_section' WHERE w.hop < 2"""}),
    "section_siblings": with_("nodes", "SELECT a.doc, a.node_id AS start, b.node_id FROM nodes a JOIN nodes b ON a.doc = b.doc AND a.section_id = b.section_id AND a.node_id <> b.node_id"),
    "node_texts": with_("nodes", "SELECT g.i AS node_id, length(coalesce(n.text, '')) AS n_chars FROM (SELECT vec_id AS i FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT -1 - vec_id FROM embeddings WHERE vec_id % 50 = 0) g LEFT JOIN nodes n ON n.node_id = g.i"),
    "graph_isolates": with_("edges", "SELECT doc, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc = n.doc AND (e.src = n.node_id OR e.tgt = n.node_id))"),
    "graph_summary": with_("edges", f"SELECT doc, n_nodes, n_useful, n_edges, n_isolated, {r4('CASE WHEN n_nodes > 1 THEN n_edges / (n_nodes * (n_nodes - 1))::DOUBLE ELSE 0 END')} AS density FROM sm", {
        "sm": """SELECT n.doc, count(*) AS n_nodes, count(*) FILTER (WHERE NOT is_noise) AS n_useful, (SELECT count(*) FROM edges e WHERE e.doc = n.doc) AS n_edges,
        count(*) FILTER (WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT tgt FROM edges)) AS n_isolated FROM nodes n GROUP BY n.doc"""}),
    "graph_validate": with_("edges", """SELECT n.doc, (SELECT count(*) FROM edges e WHERE e.doc = n.doc) = 0 AS no_edges,
        count(*) FILTER (WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT tgt FROM edges)) > 0.3 * count(*) AS many_isolated,
        (SELECT count(*) FROM edges e WHERE e.doc = n.doc) > 1000 AS many_edges,
        (SELECT count(*) FROM edges e WHERE e.doc = n.doc AND (e.src NOT IN (SELECT node_id FROM nodes) OR e.tgt NOT IN (SELECT node_id FROM nodes))) > 0 AS dangling FROM nodes n GROUP BY n.doc"""),
    "intent_classify": with_(None, "SELECT query_id, intent, intent_conf FROM intent", {"qs": "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {text(x[0])})" for k, x in enumerate(T.EVAL_QUERIES)) + f""") v(query_id, query) UNION ALL
        SELECT vec_id + 1000, {case('(vec_id // 50) % 8', [(k, text(x[0])) for k, x in enumerate(T.EVAL_QUERIES)], 'NULL')} FROM embeddings WHERE vec_id % 50 = 0""", "intent": intents(T.INTENT_PATTERNS)}),
    "intent_role_fallback": with_("seeds", "SELECT query_id, intent, intent_conf, intent_used, intent_source FROM used", {"qs": "SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 'Tell me more' ELSE query END AS query FROM q", "intent": intents(T.INTENT_PATTERNS), **SETTLE}),
    "graph_expand": with_("edges", "SELECT * FROM hits", expansion()),
    "hybrid_rank": hybrid(f"SELECT {RANKED}, relation_path FROM ranked"),
    "hybrid_rank_role_soft": hybrid(f"SELECT {RANKED} FROM ranked", "role"),
    "hybrid_provenance": hybrid("""SELECT query_id, intent_used, intent_source, (SELECT coalesce(string_agg(node_id::VARCHAR, ',' ORDER BY node_id), '') FROM seeds s WHERE s.query_id = u.query_id) AS seed_ids,
        (SELECT coalesce(string_agg(x::VARCHAR, ',' ORDER BY x), '') FROM (SELECT DISTINCT node_id AS x FROM hits h WHERE h.query_id = u.query_id)) AS expanded_ids,
        (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT relation AS x FROM hits h WHERE h.query_id = u.query_id)) AS relations,
        (SELECT count(*) FROM ranked r WHERE r.query_id = u.query_id) AS n_final FROM used u""", "role"),
    "hybrid_v3_rank_decay": v3(),
    "observation_rescue": with_("seeds", "SELECT query_id, node_id, role, rank, origin FROM seeds1", RESCUE),
    "induced_subgraph": hybrid("SELECT query_id, src, tgt, relation, weight FROM sub", "role"),
    "edge_explanations": hybrid("""SELECT query_id, src, tgt, a.region_class || '[' || substring(src::VARCHAR, 1, 8) || '] --' || relation || '--> ' || b.region_class || '[' || substring(tgt::VARCHAR, 1, 8) || ']' AS explanation
        FROM sub JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = tgt""", "role"),
    "eval_per_query": _eval(f"SELECT system, query_id, k, {', '.join(f'{_ten(m)} AS {m}' for m in ('precision', 'recall', 'rr', 'ndcg', 'hit_rate'))} FROM per"),
    "eval_report": _eval(f"SELECT system, k, {_ten('mp')} AS mean_precision, {_ten('mr')} AS mean_recall, {_ten('mrr')} AS mean_rr, {_ten('mn')} AS mean_ndcg, {_ten('mh')} AS mean_hit_rate, n_queries FROM rep"),
    "eval_delta": _eval("SELECT h.k, " + ", ".join(f"{_ten(f'(h.{a} - v.{a})')} AS delta_{b}" for a, b in (("mp", "precision"), ("mr", "recall"), ("mrr", "rr"), ("mn", "ndcg"), ("mh", "hit_rate"))) + " FROM rep h JOIN rep v USING (k) WHERE h.system = 'hybrid' AND v.system = 'vector'"),
    "eval_breakdown": _eval(f"SELECT description, k, {_ten(chr(97) + 'vg(ndcg) FILTER (WHERE system = ' + text('vector') + ')')} AS vector, {_ten('avg(ndcg) FILTER (WHERE system = ' + text('hybrid') + ')')} AS hybrid FROM per JOIN eq USING (query_id) GROUP BY description, k"),
    "eval_autolabel": with_("nodes", f"""SELECT {case('role', [(text(r), text(x)) for r, x in T.ROLE_QUERIES.items()], 'NULL')} AS query, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS relevant_ids, role AS relevant_roles, lower(role) || '_retrieval' AS description
        FROM nodes WHERE role IN {names(T.ROLE_QUERIES)} GROUP BY role"""),
    "class_histogram": with_("nodes", "SELECT region_class, count(*) AS n FROM nodes GROUP BY ALL"),
    "role_share": with_("nodes", f"SELECT role, count(*) AS n, {r4('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()')} AS percent FROM nodes WHERE role <> 'N/A' GROUP BY role"),
    "region_filter": with_("nodes", "SELECT node_id, region_class, role, md5(replace(replace(replace(replace(replace(substring(text, 1, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS text_md5 FROM nodes WHERE region_class IN ('paragraph', 'list') AND role IN ('Method', 'Result')"),
    "pipeline_counters": with_("edges", "SELECT (SELECT count(*) FROM (SELECT DISTINCT doc, page FROM nodes)) AS n_pages, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM idx) AS n_vectors"),
    "edge_percent": with_("edges", "SELECT relation, count(*) AS n, cast(floor(100 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS percent FROM edges GROUP BY relation"),
    "node_ids": with_("nodes", f"SELECT node_id, {_md5('doc', chr(39) + '::layout::p' + chr(39), 'page', chr(39) + '::r' + chr(39), 'node_seq')} AS hash_id FROM nodes"),
    "vector_cosine": f"SELECT a.vec_id AS a, {r4('x / (nx * ny) + 1').replace('x / (nx * ny)', '(' + _dot('a.embedding', 'b.embedding') + ' / (sqrt(' + _dot('a.embedding', 'a.embedding') + ') * sqrt(' + _dot('b.embedding', 'b.embedding') + ')))')} AS cosine_plus_1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "typed_refs": with_("raw", """SELECT node_id, CASE WHEN node_id % 20 < 10 THEN 'figure' ELSE 'table' END || ':' || (node_id % 3) || ',table:4,figure:5,table:6' AS refs FROM raw WHERE region_class = 'caption'"""),
    # Blocks, layout and alignment.
    "page_stats": layout("blocks", "SELECT doc_id, page_index, cast(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_blocks, sum(length(text)) < 50 AS ocr_triggered, CASE WHEN sum(length(text)) < 50 THEN 'ocr' ELSE 'embedded' END AS method FROM blocks GROUP BY ALL"),
    "document_stats": layout("blocks", "SELECT doc_id, count(*) AS n_pages, cast(sum(b) AS BIGINT) AS n_blocks, count(*) FILTER (WHERE c < 50) AS n_ocr_pages, count(*) FILTER (WHERE c >= 50) AS n_embedded_pages FROM (SELECT doc_id, page_index, count(*) AS b, sum(length(text)) AS c FROM blocks GROUP BY ALL) GROUP BY doc_id"),
    "equation_guess": layout("blocks", f"SELECT block_id, CASE WHEN {_share('text', T.EQUATION_CHARS)} > 0.05 THEN 'equation' ELSE 'text' END AS block_type FROM blocks"),
    "block_ids": layout("blocks", f"SELECT block_id, {_md5('doc_id', text('::p'), 'page_index', text('::b'), 'block_pos')} AS hash_id, {_md5('doc_id', text('::layout::p'), 'page_index', text('::r'), 'block_pos')} AS region_id, {_md5('doc_id', text('::fig::vector::p'), 'page_index', text('::s'), 'block_pos')} AS figure_id FROM blocks"),
    "scaled_boxes": layout("blocks", f"SELECT block_id, {r4('x0 * (640.0::DOUBLE / 1240)')} AS x0, {r4('y0 * (842.0::DOUBLE / 1754)')} AS y0, {r4('x1 * (640.0::DOUBLE / 1240)')} AS x1, {r4('y1 * (842.0::DOUBLE / 1754)')} AS y1 FROM blocks"),
    "blocks_extract": layout("blocks", f"SELECT doc_id, page_index, {_md5('doc_id', text('::p'), 'page_index', text('::b'), 'block_pos')} AS block_id, md5(txt) AS text_md5, CASE WHEN {_share('txt', T.EQUATION_CHARS)} > 0.05 THEN 'equation' ELSE 'text' END AS block_type, block_pos AS raw_block_no FROM joined WHERE txt <> ''", SPANS),
    "raster_figures": layout("blocks", f"SELECT doc_id, page_index, {_md5('doc_id', text('::p'), 'page_index', text('::b'), 'block_pos')} AS block_id FROM blocks WHERE block_pos % 9 = 8 AND (x1 - x0) * (y1 - y0) >= 10"),
    "dominant_style": layout("blocks", f"SELECT block_id, 'Font' || substring('ABC', k + 1, 1) AS font_name, 9.0::DOUBLE + (length(text) + k) % 5 AS font_size, ({_flag('k')} // 16) % 2 = 1 AS is_bold, ({_flag('k')} // 2) % 2 = 1 AS is_italic FROM (SELECT {_md5('doc_id', text('::p'), 'page_index', text('::b'), 'block_pos')} AS block_id, text, {_pick} AS k FROM joined WHERE txt <> '')", SPANS),
    "ocr_word_group": OCR + f"SELECT doc_id, cast(k // 60 AS INT) AS page_index, cast(k // 12 AS INT) AS block_num, md5(string_agg(text, ' ' ORDER BY k)) AS text_md5, {r4('avg(conf)')} AS confidence, {r4('min(l * 0.48::DOUBLE)')} AS x0, {r4('min(t * 0.48::DOUBLE)')} AS y0, {r4('max((l + 36) * 0.48::DOUBLE)')} AS x1, {r4('max((t + 18) * 0.48::DOUBLE)')} AS y1 FROM u WHERE {strip('text')} <> '' AND conf >= 0 GROUP BY doc_id, k // 60, k // 12",
    "page_upper_median": layout("fonts", "SELECT * FROM fonts"),
    "near_table_caption": layout("near", "SELECT block_id, near_table_caption FROM near"),
    "layout_classify": layout("regions", "SELECT doc_id, page_index, region_pos, region_id, region_class FROM regions"),
    "layout_stats": layout("regions", "SELECT region_class, count(*) AS n FROM regions GROUP BY ALL"),
    "iou_pairs": layout("scored", f"SELECT block_id, region_id, {r4('i')} AS iou, {r4('s')} AS score FROM scored WHERE i > 0"),
    "align_blocks": layout("al", "SELECT block_id, region_id, region_class, score, flagged FROM al"),
    "align_unassigned": layout("una", "SELECT block_id FROM una"),
    "align_enrich": layout("al", "SELECT h.region_id, md5(coalesce((SELECT min_by(text, block_pos) FROM al WHERE al.region_id = h.region_id AND NOT flagged), '')) AS text_md5, coalesce((SELECT string_agg(block_id, ',' ORDER BY block_pos) FROM al WHERE al.region_id = h.region_id AND NOT flagged), '') AS source_block_ids FROM det h"),
    "alignment_stats": layout("una", "SELECT b.doc_id, (SELECT count(*) FROM al WHERE al.doc_id = b.doc_id) AS n_aligned, (SELECT count(*) FROM al WHERE al.doc_id = b.doc_id AND flagged) AS n_flagged, (SELECT count(*) FROM una WHERE una.doc_id = b.doc_id) AS n_unassigned FROM (SELECT DISTINCT doc_id FROM blocks) b"),
    "score_bands": layout("al", "SELECT CASE WHEN flagged THEN 'red' WHEN score >= 0.7 THEN 'green' WHEN score >= 0.45 THEN 'amber' ELSE 'red' END AS band, count(*) AS n FROM al GROUP BY ALL"),
    "fuse_regions": layout("fused", f"SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, late, pos) - 1 AS region_pos, region_id, region_class, {r4('confidence')} AS confidence, backend FROM fused"),
    "textgap_figures": layout("blocks", f"SELECT doc_id, page_index, seq, {_md5('doc_id', text('::fig::gap::p'), 'page_index', text('::s'), 'seq')} AS block_id, top AS y0, bottom AS y1 FROM g2", {
        "g0": "SELECT doc_id, page_index, block_pos, y0 AS bottom, coalesce(max(y1) OVER (PARTITION BY doc_id, page_index ORDER BY y0, block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM blocks WHERE block_pos % 5 <> 2",
        "g1": "SELECT * FROM g0 WHERE bottom - top >= 40 AND NOT EXISTS (SELECT 1 FROM blocks e WHERE e.block_pos % 5 = 2 AND e.doc_id = g0.doc_id AND e.page_index = g0.page_index AND -10 < e.x1 AND 650 > e.x0 AND top - 10 < e.y1 AND bottom + 10 > e.y0)",
        "g2": "SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY bottom, block_pos) - 1 AS seq FROM g1"}),
}
_prio = case("role", [(text(r), k) for k, r in enumerate(T.ROLE_PRIORITY)], "9")
PROMPT = {
    "pas": f"""SELECT *, '[P' || passage_no || ' | Role: ' || role || ' | Page: ' || page || ' | Node: ' || substring(node_id::VARCHAR, 1, 8) || ' | Score: ' || printf('%.3f', floor(final_score * 1e3 + 0.5) / 1e3) || ']' || chr(10) ||
        {strip('substring(text, 1, 350)')} || CASE WHEN length(text) > 350 THEN ' …' ELSE '' END AS passage FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, {_prio}, final_rank) AS passage_no FROM ranked
        WHERE {strip('text')} <> '' AND region_class NOT IN ('header', 'footer') AND role <> 'N/A') WHERE passage_no <= 6""",
    "pe": f"""SELECT query_id, edge_no, upper(a.region_class[1]) || a.region_class[2:] || '[' || substring(src::VARCHAR, 1, 8) || '] --' || relation || '--> ' || upper(b.region_class[1]) || b.region_class[2:] || '[' || substring(tgt::VARCHAR, 1, 8) || ']' AS line FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN relation IN {names(T.PRIORITY_RELATIONS)} THEN 0 ELSE 1 END, weight DESC, doc, edge_seq) AS edge_no FROM sub) s
        JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = tgt WHERE edge_no <= 12""",
    "asm": """SELECT query_id, '[Context Passages]' || chr(10) || coalesce((SELECT string_agg(passage, chr(10) || chr(10) ORDER BY passage_no) FROM pas WHERE pas.query_id = q.query_id), 'No relevant passages found.') || chr(10) || chr(10) ||
        coalesce('[Graph Relationships]' || chr(10) || (SELECT string_agg('  ' || line, chr(10) ORDER BY edge_no) FROM pe WHERE pe.query_id = q.query_id) || chr(10) || chr(10), '') ||
        '[Question]' || chr(10) || query || chr(10) || chr(10) || '[Required Format]' || chr(10) || 'Respond ONLY using the three-section format:' || chr(10) || '## Answer' || chr(10) || '## Evidence' || chr(10) || '## Graph Reasoning' AS prompt FROM q""",
}
ORACLE["prompt_passages"] = hybrid("SELECT query_id, passage_no, node_id, md5(passage) AS passage_md5 FROM pas", "role", PROMPT)
ORACLE["prompt_edges"] = hybrid("SELECT query_id, edge_no, line FROM pe", "role", PROMPT)
ORACLE["prompt_text"] = hybrid("SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM asm", "role", PROMPT)
ORACLE["parse_answer"] = f"""SELECT doc_id, md5(CASE k WHEN 3 THEN '## Graph Reasoning' || chr(10) || {strip('t')} ELSE {strip('t')} END) AS answer,
    md5(CASE k WHEN 0 THEN {strip("'1. ' || t")} ELSE '' END) AS evidence, md5(CASE k WHEN 0 THEN '- a' WHEN 3 THEN {strip('t')} ELSE '' END) AS reasoning
    FROM (SELECT doc_id, doc_id % 4 AS k, text AS t FROM documents WHERE text IS NOT NULL)"""
ORACLE["generated_answers"] = hybrid("""SELECT query_id, coalesce('The passages ' || (SELECT string_agg('[P' || passage_no || ']', ', ' ORDER BY passage_no) FROM pas WHERE pas.query_id = q.query_id AND passage_no <= 2) || ' bear on this.',
    'The context does not hold enough information.') AS answer, coalesce((SELECT string_agg(passage_no || '. [P' || passage_no || ']', chr(10) ORDER BY passage_no) FROM pas WHERE pas.query_id = q.query_id), '') AS evidence,
    coalesce(ltrim((SELECT string_agg('  ' || line, chr(10) ORDER BY edge_no) FROM pe WHERE pe.query_id = q.query_id)), '') AS reasoning, NULL::VARCHAR AS error FROM q""", "role", PROMPT)
_hit = "substring(s, i, 1) = '1' AND i <= k"
ORACLE["metric_cases"] = f"""WITH c AS (SELECT * FROM (VALUES (0, '10100'), (1, '10101'), (2, '1000'), (3, '010'), (4, '000'), (5, '001'), (6, '111')) v(query_id, s)),
m AS (SELECT query_id, k, (SELECT count(*) FROM range(1, 6) t(i) WHERE {_hit}) AS n, (SELECT coalesce(sum(1 / log2(i + 1.0)), 0) FROM range(1, 6) t(i) WHERE {_hit}) AS dcg, position('1' IN s) AS first FROM c, (SELECT unnest([1, 3, 5]) AS k))
SELECT 'list' AS system, query_id::BIGINT AS query_id, k, {_ten('n / k::DOUBLE')} AS precision, {_ten('n / 3.0::DOUBLE')} AS recall, {_ten('CASE WHEN first > 0 THEN 1.0::DOUBLE / first ELSE 0 END')} AS rr,
    {_ten('CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(j + 1.0)) FROM range(1, n + 1) t(j)) ELSE 0 END')} AS ndcg, {_ten('(n > 0)::INT::DOUBLE')} AS hit_rate FROM m"""

# Overrides, empty results and checks of the engine.
_wish = "CASE WHEN (query_id // 50) % 3 <> 2 THEN " + case("(query_id // 50) % 7", [(k, text(x)) for k, x in enumerate(("method", "result", "dataset", "figure", "definition", "observation"))], "'none such'") + " END"


def override() -> str:
    e = expansion()
    e["used"] = f"""SELECT u.* EXCLUDE (intent_used, intent_source), coalesce({_wish}, intent_used) AS intent_used, CASE WHEN {_wish} IS NOT NULL THEN 'override' ELSE intent_source END AS intent_source FROM ({SETTLE['used']}) u"""
    known = names(T.INTENT_OUT)
    e["h0"] = e["h0"].replace("f.intent = u.intent_used", f"f.intent = CASE WHEN u.intent_used IN {known} THEN u.intent_used ELSE 'general' END")
    return with_("edges", f"SELECT {RANKED}, intent_used, intent_source FROM ranked JOIN used USING (query_id)", {**e, **SEEDS1, **ranking(T.ALPHA, str(T.SEED_BONUS), True)})


ORACLE["hybrid_override"] = override()
ORACLE["hybrid_no_seeds"] = with_("q", "SELECT query_id, intent AS intent_used, 'classifier' AS intent_source, '' AS seed_ids, '' AS expanded_ids, '' AS relations, 0::BIGINT AS n_final FROM intent", {"qs": "SELECT * FROM q", "intent": intents(T.INTENT_PATTERNS)})
ORACLE["engine_validate"] = with_("edges", f"""SELECT 'built' AS state, (SELECT count(*) FROM idx) > 0 AS has_index, (SELECT count(*) FROM edges) > 0 AS has_graph, {T.ALPHA} BETWEEN 0 AND 1 AS alpha_in_range
    UNION ALL SELECT 'empty', false, false, false""")
ORACLE["top_texts"] = hybrid("SELECT query_id, final_rank, md5(text) AS text_md5 FROM ranked WHERE trim(text) <> '' AND final_rank <= 3", "role")
ORACLE["nodes_by_role"] = hybrid("SELECT query_id, node_id, final_rank FROM ranked WHERE role = 'Method'", "role")
_heads = ("1. Introduction", "2.1 Related Work", "Results & Discussion", "lower case", "X", "Numbers 5: yes", "Ends with a stop.", " Padded ")
ORACLE["section_titles"] = with_("raw", """SELECT doc, node_id, section_id, CASE WHEN section_id IS NOT NULL THEN 's' || section_id ELSE 'p' || page END AS sec_key FROM (
    SELECT *, last_value(CASE WHEN region_class = 'abstract' OR (region_class = 'title' AND regexp_matches(trim(said), """ + text(T.SECTION_TITLE) + """)) THEN node_id END IGNORE NULLS)
    OVER (PARTITION BY doc ORDER BY page, y0, node_seq ROWS UNBOUNDED PRECEDING) AS section_id FROM (SELECT *, """ + case("(node_id // 20) % 8", [(k, text(h)) for k, h in enumerate(_heads)], "NULL") + """ AS said FROM raw))""")

# Figures among the regions, and files written and read back.
_blocks8 = {k: (v + " AND pos % 9 <> 8" if k == "said" else v) for k, v in LAYOUT.items()}
_picture = "SELECT doc_id, pos // 12 AS page_index, pos AS block_pos, doc_id || '-' || pos AS block_id, 30.0::DOUBLE + 62 * (pos % 12) AS y0 FROM lines WHERE line <> '' AND pos % 9 = 8"
ORACLE["layout_figures"] = with_(None, f"""SELECT doc_id, cast(page_index AS INT) AS page_index, region_pos, {_md5('doc_id', text('::layout::p'), 'page_index', text('::r'), 'region_pos')} AS region_id, region_class, confidence, no_text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY late, block_pos) - 1 AS region_pos FROM (
    SELECT doc_id, page_index, block_pos, region_class, 0.8::DOUBLE AS confidence, false AS no_text, 0 AS late FROM regions UNION ALL SELECT doc_id, page_index, block_pos, 'figure', 0.95::DOUBLE, true, 1 FROM pictures))""", {**{k: _blocks8[k] for k in list(LAYOUT)[: list(LAYOUT).index("regions") + 1]}, "pictures": _picture})
ORACLE["extraction_json"] = with_(None, f"""SELECT doc_id, page_index, block_id, md5(text) AS text_md5, {r4('y0')} AS y0, font_size, is_bold, 'text' AS block_type FROM blocks
    UNION ALL SELECT doc_id, page_index, block_id, NULL, {r4('y0')}, NULL, NULL, 'figure' FROM pictures""", {**{k: _blocks8[k] for k in ("lines", "said", "blocks")}, "pictures": _picture})
ORACLE["first_page_blocks"] = layout("blocks", "SELECT doc_id, page_index, block_id FROM blocks WHERE page_index = 0")
ORACLE["layout_json"] = layout("regions", "SELECT doc_id, page_index, region_pos, region_id, region_class, 'heuristic' AS backend, 0.8::DOUBLE AS confidence, block_id AS source_block_ids FROM regions")
ORACLE["semantic_json"] = with_("nodes", "SELECT doc, node_id, page, y0, region_class, role, role_confidence, length(text) AS n_chars FROM nodes")
ORACLE["semantic_json_links"] = with_("links", "SELECT doc, caption_id, target_id, s_ref, s_emb, s_link FROM links")
ORACLE["evaluation_nodes"] = with_("nodes", "SELECT doc, node_id, role, length(substring(text, 1, 300)) AS n_chars FROM nodes")
ORACLE["alignment_json"] = layout("una", """SELECT doc_id, coalesce(n, 0) AS n_aligned, md5(coalesce(a, '')) AS aligned_md5, md5(coalesce(u, '')) AS unassigned_md5 FROM
    (SELECT doc_id, count(*) AS n, string_agg(block_id || ':' || region_id || ':' || CASE WHEN flagged THEN 'true' ELSE 'false' END, ',' ORDER BY page_index, block_pos) AS a FROM al GROUP BY doc_id)
    FULL JOIN (SELECT doc_id, string_agg(block_id, ',' ORDER BY block_id) AS u FROM una GROUP BY doc_id) USING (doc_id)""")
ORACLE["node_link_json"] = with_("edges", "SELECT e.doc, src, tgt, relation, weight, edge_source, edge_seq, n_nodes, n_noise, n_chars FROM edges e JOIN (SELECT doc, count(*) AS n_nodes, count(*) FILTER (WHERE is_noise) AS n_noise, cast(sum(length(text)) AS BIGINT) AS n_chars FROM nodes GROUP BY doc) n ON n.doc = e.doc")
ORACLE["report_json"] = _eval(f"SELECT system, k, {_ten('mp')} AS mean_precision, {_ten('mn')} AS mean_ndcg, n_queries FROM rep")
ORACLE["form_figures"] = layout("blocks", f"""SELECT doc_id, page_index, {_md5('doc_id', text('::fig::xobj::p'), 'page_index', text('::s'), 'block_pos')} AS block_id, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1 FROM blocks
    WHERE block_pos % 4 < 2 AND (trunc(x1) - trunc(x0)) * (trunc(y1) - trunc(y0)) >= 2000""")
ORACLE["pdf_names"] = """SELECT page_id, page_id % 5 IN (0, 1, 3) AS is_pdf, substring(CASE page_id % 5 WHEN 0 THEN page_id || '_é-x' WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN page_id::VARCHAR WHEN 3 THEN page_id || '_' || repeat('long', 12) ELSE page_id || 'pdf' END, 1, 40) AS doc FROM pages"""
_html = lambda x: reduce(lambda a, p: f"replace({a}, {text(p[0])}, {text(p[1])})", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), x)
ORACLE["shortened_texts"] = "SELECT doc_id, " + ", ".join(f"md5({_html(f'substring(text, 1, {n})') if n < 200 else f'substring(text, 1, {n})'}) AS md5_{n}" for n in (60, 120, 200, 300)) + " FROM documents WHERE text IS NOT NULL"
_compared = _eval("SELECT system, k, " + ", ".join(f"{_ten(a)} AS mean_{b}" for a, b in (("mp", "precision"), ("mr", "recall"), ("mrr", "rr"), ("mn", "ndcg"), ("mh", "hit_rate"))) + ", n_queries, system = 'broken' AS failed FROM rep")
ORACLE["compare_systems"] = _compared.replace("unnest(['vector', 'hybrid'])", "unnest(['vector', 'hybrid', 'broken'])").replace("role_filter AS wanted", "NULL::VARCHAR AS wanted")

# The test tables' blocks stand in two columns and none spans both, so a page's order follows from its widest left block.
_order = """SELECT {cols}, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN two THEN block_pos % 2 ELSE 0 END, y0) - 1 AS reading_pos FROM (
    SELECT *, count(*) FILTER (WHERE block_pos % 2 = 1) OVER w > 0 AND coalesce(max(x1) FILTER (WHERE block_pos % 2 = 0) OVER w, 0) >= 0.18::DOUBLE * 640 AS two FROM {rows} WINDOW w AS (PARTITION BY doc_id, page_index))"""
ORACLE["reading_order"] = layout("regions", _order.format(cols="doc_id, page_index, region_pos", rows="regions"))
_placed = """SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY late, block_pos) - 1 AS region_pos FROM (
    SELECT a.doc_id, a.page_index, a.block_pos, a.y0, a.x1, coalesce(r.region_class, 'figure') AS region_class, CASE WHEN r.block_id IS NULL THEN 1 ELSE 0 END AS late FROM every a LEFT JOIN regions r ON r.block_id = a.block_id)"""
ORACLE["page_regions"] = with_(None, _order.format(cols="doc_id, page_index, region_pos, region_class", rows="placed"), {
    **{k: _blocks8[k] for k in list(LAYOUT)[: list(LAYOUT).index("regions") + 1]},
    "whole": LAYOUT["said"],
    "every": LAYOUT["blocks"].replace("FROM said", "FROM whole"),
    "placed": _placed,
})
