"""Layout rules, fusion, alignment and reading order on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.scalar import iou
from quire.operators import blocks as B, layout as L, pages as P

W, H = 595.0, 842.0


def page(spark, rows):
    """rows: (text, x0, y0, x1, y1, font_size, bold, page)."""
    data = [(1, r[7], k, f"b{k}", r[0], (float(r[1]), float(r[2]), float(r[3]), float(r[4])), r[5], r[6], W, H) for k, r in enumerate(rows)]
    kind = "doc_id long, page_index int, block_pos int, block_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, is_bold boolean, page_width double, page_height double"
    return spark.createDataFrame(data, kind)


CASES = [
    ("2. Related Work", 12.0, True, 300, 0, "title"),
    ("3. Methodology", 13.5, False, 300, 0, "title"),
    ("IV. EXPERIMENTS", 12.0, True, 300, 0, "title"),
    ("3.2.1 Experimental Setup", 11.5, True, 300, 0, "title"),
    ("1. Introduction", 12.0, True, 300, 0, "title"),
    ("[1] P. Lewis et al., NeurIPS 2020.", 11.0, False, 300, 3, "reference"),
    ("1. Lewis, P., Perez, E. et al. NeurIPS 2020.", 11.0, False, 300, 3, "reference"),
    ("7. Smith, J. A Novel Approach. arXiv:2301.00001, 2023.", 11.0, False, 300, 3, "reference"),
    ("A  B  C\n1  2  3\n4  5  6", 11.0, False, 300, 3, "table"),
    ("Fig. 3: shapes", 11.0, False, 300, 3, "caption"),
    ("Algorithm 1: search", 11.0, False, 300, 3, "caption"),
    ("Abstract", 11.0, False, 300, 0, "abstract"),
    ("Abstract", 11.0, False, 300, 2, "paragraph"),
    ("- one\n- two", 11.0, False, 300, 3, "list"),
    ("∑∫αβ = 1", 11.0, False, 300, 3, "equation"),
    ("algorithm that runs over all the rows of a table", 11.0, False, 300, 3, "algorithm"),
    ("Plain words that say nothing.", 11.0, False, 300, 3, "paragraph"),
    ("Top", 11.0, False, 10, 3, "header"),
    ("17", 11.0, False, 815, 3, "footer"),
]


@pytest.mark.parametrize("text,size,bold,y,number,expected", CASES)
def test_classes(spark, text, size, bold, y, number, expected):
    rows = [(text, 50, y, 90, y + 15, size, bold, number)] + [("filler", 50, 500 + 20 * k, 300, 510 + 20 * k, 11.0, False, number) for k in range(3)]
    got = L.detect(page(spark, rows)).where("region_pos = 0").first()
    assert got.region_class == expected


def test_row_below_a_table_caption(spark):
    rows = [("Table 2: scores", 50, 300, 300, 312, 11.0, False, 3), ("HL-HP  0.4455  0.2871  0.5529", 50, 320, 300, 332, 11.0, False, 3), ("Figure 4: x", 50, 500, 300, 512, 11.0, False, 3), ("Words here.", 50, 520, 300, 532, 11.0, False, 3)]
    got = {r.region_pos: r.region_class for r in L.detect(page(spark, rows)).collect()}
    assert got == {0: "caption", 1: "table", 2: "caption", 3: "paragraph"}


def region(spark, rows):
    kind = "doc_id long, page_index int, region_pos int, region_id string, region_class string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, backend string, text_content string, source_block_ids array<string>"
    return spark.createDataFrame([(1, 0, k, i, c, tuple(map(float, b)), s, g, t, []) for k, (i, c, b, s, g, t) in enumerate(rows)], kind)


def test_fusion(spark):
    ml = region(spark, [("m0", "paragraph", (10, 10, 200, 30), 0.85, "detector", None), ("m1", "title", (0, 300, 200, 320), 0.9, "detector", None)])
    rules = region(spark, [("h0", "caption", (12, 11, 198, 29), 0.80, "heuristic", "Fig. 1"), ("h1", "caption", (0, 700, 200, 720), 0.8, "heuristic", "Fig. 2")])
    got = {r.region_id: r for r in L.fuse(ml, rules).collect()}
    assert set(got) == {"m0", "m1", "h1"}
    assert (got["m0"].region_class, got["m0"].backend, got["m0"].text_content) == ("caption", "hybrid", "Fig. 1")
    assert got["m0"].confidence == pytest.approx(0.825)
    assert got["m1"].backend == "detector"


def test_alignment_ties_and_pages_without_regions(spark):
    rows = [("a", 0, 0, 10, 10, 11.0, False, 0), ("b", 300, 300, 310, 310, 11.0, False, 0), ("c", 0, 0, 10, 10, 11.0, False, 1)]
    blocks = page(spark, rows)
    regions = region(spark, [("r0", "paragraph", (0, 0, 10, 10), 1.0, "x", None), ("r1", "list", (0, 0, 10, 10), 1.0, "x", None)])
    a = L.align(blocks, regions)
    got = {r.block_id: (r.region_id, r.region_class, r.flagged) for r in a.collect()}
    assert got == {"b0": ("r0", "paragraph", False), "b1": ("", "unknown", True)}
    assert {r.block_id for r in L.unassigned(blocks, a).collect()} == {"b1", "b2"}
    assert {r.region_id: r.text_content for r in L.enrich(regions, blocks, a).collect()} == {"r0": "a", "r1": None}


def test_unknown_backend(spark):
    with pytest.raises(ValueError):
        L.detect_with(page(spark, []), "layoutparser")


def test_two_columns_between_full_width_boxes():
    spots = [("title", 20, 10, 575, 40), ("L1", 20, 60, 260, 100), ("R1", 310, 60, 570, 100), ("L2", 20, 110, 260, 150), ("R2", 310, 110, 570, 150), ("section", 20, 200, 575, 220), ("L3", 20, 240, 260, 280), ("R3", 310, 240, 570, 280)]
    boxes = [P.Box(k, *map(float, s[1:])) for k, s in enumerate(spots)]
    assert [spots[k][0] for k in P.order_page(boxes, W)] == ["title", "L1", "L2", "R1", "R2", "section", "L3", "R3"]


def test_no_box_is_lost():
    rng = random.Random(4)
    for _ in range(300):
        boxes = []
        for k in range(rng.randint(0, 25)):
            x, y = rng.uniform(0, 500), rng.uniform(0, 800)
            boxes.append(P.Box(k, x, y, x + rng.uniform(5, 595 - x), y + rng.uniform(5, 200)))
        assert sorted(P.order_page(boxes, W)) == list(range(len(boxes)))


def test_figures():
    assert P.vector_figures([(0, 0, 10, 10)], [], W, H) == []
    two = P.vector_figures([(0, 0, 100, 100), (104, 0, 200, 100), (300, 400, 500, 600)], [], W, H)
    assert [h for _, h in two] == [(0, 0, 200, 100), (300, 400, 500, 600)]
    assert P.vector_figures([(0, 0, 100, 100), (104, 0, 200, 100)], [(0, 0, 200, 100)], W, H) == []
    assert P.keep_distinct([(50, 50, 400, 350), (55, 55, 395, 345), (0, 700, 100, 800)]) == [0, 2]


def test_text_gap(spark):
    rows = [("a", 0, 0, 595, 30, 11.0, False, 0), ("b", 0, 300, 595, 320, 11.0, False, 0)]
    got = L.text_gaps(page(spark, rows)).collect()
    assert [(r.bbox.y0, r.bbox.y1, r.seq) for r in got] == [(30.0, 300.0, 0)]
    known = page(spark, [("x", 0, 30, 595, 300, 11.0, False, 0)])
    assert L.text_gaps(page(spark, rows), known).count() == 0


def test_dominant_style_and_blank_spans(spark):
    raw = spark.createDataFrame(
        [(1, 0, 0, 3, (0.0, 0.0, 100.0, 20.0), [("hi", "FontA", 10.0, 0, 0), ("hello world", "FontB", 12.0, 16, 0)]), (1, 0, 0, 4, (0.0, 0.0, 100.0, 20.0), [("  ", "F", 9.0, 0, 0)]), (1, 0, 0, 5, (0.0, 0.0, 1.0, 1.0), [("small", "F", 9.0, 0, 0)]), (1, 0, 1, 6, (0.0, 0.0, 99.0, 99.0), [])],
        "doc_id long, page_index int, type int, number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, spans array<struct<text:string,font:string,size:double,flags:int,color:int>>",
    )
    got = B.extract(raw).collect()
    assert [(r.text, r.style.font_name, r.style.is_bold, r.raw_block_no) for r in got] == [("hi hello world", "FontB", True, 3)]
    assert B.raster_figures(raw).count() == 1


def test_iou_of_boxes(spark):
    row = spark.range(1).select(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(2.0).alias("y1")).alias("a"), F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(3.0).alias("y1")).alias("b"))
    assert row.select(iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 7)


def test_order_rules_on_random_pages():
    """What must hold on any page: nothing is lost, full-width boxes come top down and split what is clear of them."""
    rng = random.Random(5)
    for _ in range(300):
        boxes = []
        for k in range(rng.randrange(1, 16)):
            x0, y0 = rng.choice([20, 210, 310, 400]) + rng.randrange(10), rng.randrange(800)
            boxes.append(P.Box(k, x0, y0, min(W, x0 + rng.choice([80, 180, 250, 520])), y0 + rng.randrange(5, 60)))
        order = P.order_page(boxes, W)
        assert sorted(order) == sorted(b.key for b in boxes)
        place = {k: i for i, k in enumerate(order)}
        full = sorted((b for b in boxes if b.width / W >= P.FULL), key=lambda b: (b.y0, b.x0))
        if len(boxes) > 1:
            assert [place[f.key] for f in full] == sorted(place[f.key] for f in full)
        rest = [b for b in boxes if b not in full]
        straddles = lambda b: any(b.y0 < f.y0 - P.SLACK and b.y1 > f.y0 + P.SLACK for f in full)
        for b in rest:
            for f in full:
                if b.y1 <= f.y0 and all(g.y1 <= b.y0 or g.y0 >= b.y1 for g in full):
                    assert place[b.key] < place[f.key] or straddles(b)


def test_columns_are_read_one_after_the_other():
    rng = random.Random(6)
    for _ in range(100):
        left = [P.Box(k, 20, y, 270, y + 10) for k, y in enumerate(rng.sample(range(0, 800, 20), 5))]
        right = [P.Box(10 + k, 310, y, 560, y + 10) for k, y in enumerate(rng.sample(range(0, 800, 20), 5))]
        boxes = left + right
        rng.shuffle(boxes)
        want = [b.key for part in (left, right) for b in sorted(part, key=lambda b: b.y0)]
        assert P.order_page(boxes, W) == want


def test_hulls_of_random_drawings():
    """Hulls cover all boxes, none is near another, and boxes far from all others stay alone."""
    rng = random.Random(7)
    inside = lambda b, h: h[0] <= b[0] and h[1] <= b[1] and b[2] <= h[2] and b[3] <= h[3]
    for _ in range(200):
        boxes = []
        for _ in range(rng.randrange(1, 20)):
            x, y = rng.randrange(500), rng.randrange(700)
            boxes.append((float(x), float(y), float(x + rng.randrange(1, 80)), float(y + rng.randrange(1, 80))))
        hulls = P.cluster_boxes(boxes)
        assert all(sum(inside(b, h) for h in hulls) >= 1 for b in boxes)
        assert not any(P.close(a, b, P.NEAR) for i, a in enumerate(hulls) for b in hulls[:i])
        for b in boxes:
            if boxes.count(b) == 1 and not any(P.close(b, h, P.NEAR) for h in hulls if h != b):
                assert any(inside(b, h) for h in hulls)
        corners = {(min(b[0] for b in boxes if inside(b, h)), min(b[1] for b in boxes if inside(b, h)), max(b[2] for b in boxes if inside(b, h)), max(b[3] for b in boxes if inside(b, h))) for h in hulls}
        assert corners == set(hulls)


def test_figures_that_repeat_an_earlier_one():
    rng = random.Random(8)
    for _ in range(200):
        figures = []
        for _ in range(rng.randrange(1, 12)):
            x, y = rng.randrange(100), rng.randrange(100)
            figures.append((float(x), float(y), float(x + rng.randrange(1, 90)), float(y + rng.randrange(1, 90))))
        kept = P.keep_distinct(figures)
        share = lambda a, b: P.common(a, b) / min(P.size(a), P.size(b))
        for k, f in enumerate(figures):
            assert (k in kept) == all(share(f, figures[j]) <= P.SAME for j in kept if j < k)


def test_blocks_of_pages_without_regions(spark):
    blocks = page(spark, [("a", 0, 0, 10, 10, 11.0, False, 0), ("b", 0, 0, 10, 10, 11.0, False, 1)])
    regions = L.detect(blocks).where("page_index = 0")
    found = L.align(blocks, regions)
    assert [r.block_id for r in L.unassigned(blocks, found).collect()] == ["b1"] and found.count() == 1


def test_backends():
    assert L.resolve_backend("auto") == "heuristic" and L.resolve_backend("auto", iter) == "external" and L.resolve_backend("heuristic", iter) == "heuristic"
    for wrong in (("other", None), ("external", None)):
        with pytest.raises(ValueError):
            L.resolve_backend(*wrong)
