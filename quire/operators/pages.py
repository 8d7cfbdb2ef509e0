"""Steps that are sequential inside a page: reading order, drawing clusters and figure deduplication.

Their branches depend on what came before, so a function takes a page as one row with an array of its boxes,
many pages to a batch; a page has at most a few hundred boxes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FULL, WIDE, SLACK = 0.55, 0.48, 1.0
NEAR, MIN_AREA, MIN_SHARE, MAX_TEXT, SAME = 8.0, 2000.0, 0.02, 0.40, 0.70


@dataclass(frozen=True)
class Box:
    key: int
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def width(self) -> float:
        return self.x1 - self.x0


def columns_of(boxes: list[Box], page_width: float, gap: float = 18.0, least_share: float = 0.18, most: int = 4) -> list[tuple[float, float]]:
    """Column ranges that the gaps between merged x-ranges leave; one column where they don't hold."""
    whole = [(0.0, page_width)]
    islands: list[list[float]] = []
    for x0, x1 in sorted((b.x0, b.x1) for b in boxes):
        if islands and x0 <= islands[-1][1] + 8.0:
            islands[-1][1] = max(islands[-1][1], x1)
        else:
            islands.append([x0, x1])
    gaps = [(a[1], b[0]) for a, b in zip(islands, islands[1:]) if b[0] - a[1] >= gap and a[1] > 0.1 * page_width and b[0] < 0.9 * page_width]
    if len(gaps) >= most:
        widest = sorted(range(len(gaps)), key=lambda k: gaps[k][0] - gaps[k][1])[: most - 1]
        gaps = [gaps[k] for k in sorted(widest)]
    edges = [0.0, *(x for g in gaps for x in g), page_width]
    out = list(zip(edges[::2], edges[1::2]))
    return out if len(out) > 1 and all(b - a >= least_share * page_width for a, b in out) else whole


def _column(b: Box, columns: list[tuple[float, float]]) -> int:
    """The column with most of a box's width, or else the nearest centre."""
    share = [max(0.0, min(b.x1, hi) - max(b.x0, lo)) for lo, hi in columns]
    if max(share) > 0:
        return int(np.argmax(share))
    centre = (b.x0 + b.x1) / 2
    return int(np.argmin([abs(centre - (lo + hi) / 2) for lo, hi in columns]))


def band_order(boxes: list[Box], page_width: float, gap: float) -> list[Box]:
    by_place = lambda b: (b.y0, b.x0)
    page = max(page_width, 1.0)
    wide = sorted((b for b in boxes if b.width / page >= WIDE), key=by_place)
    normal = [b for b in boxes if b.width / page < WIDE]
    columns = columns_of(normal, page_width, gap) if len(normal) > 1 else []
    if len(columns) <= 1:
        return sorted(boxes, key=by_place)
    out: list[Box] = []
    for k in range(len(wide) + 1):
        # The part between two wide boxes: from the top of the one before to the bottom of the next.
        lo = wide[k - 1].y0 if k else -np.inf
        hi = wide[k].y1 if k < len(wide) else np.inf
        if k:
            out.append(wide[k - 1])
        part = [b for b in normal if lo <= b.y0 < hi]
        out += sorted(part, key=lambda b: (_column(b, columns), b.y0, b.x0, b.y1))
    return out


def order_page(boxes: list[Box], page_width: float, gap: float = 18.0) -> list[int]:
    """Keys in reading order. Boxes across the page cut it into bands; no box is lost or repeated."""
    if len(boxes) < 2:
        return [b.key for b in boxes]
    full = sorted((b for b in boxes if b.width / max(page_width, 1.0) >= FULL), key=lambda b: (b.y0, b.x0))
    rest = [b for b in boxes if b.width / max(page_width, 1.0) < FULL]
    out: list[Box] = []
    top = -np.inf
    for f in full:
        out += band_order([b for b in rest if b.y0 >= top - SLACK and b.y1 <= f.y0 + SLACK], page_width, gap)
        out.append(f)
        top = f.y1
    out += band_order([b for b in rest if b.y0 >= top - SLACK], page_width, gap)
    keys = list(dict.fromkeys(b.key for b in out))
    # A box that straddles a full-width one fits no band; it comes last rather than being lost.
    lost = sorted((b for b in boxes if b.key not in set(keys)), key=lambda b: (b.y0, b.x0, b.y1))
    return keys + [b.key for b in lost]


def page_orders(regions: DataFrame, gap: float = 15.0) -> DataFrame:
    """(doc_id, page_index, places): each page's region_pos in reading order.

    A page is one row with an array of its boxes, so that a batch holds many pages.
    """
    kind = f"doc_id {regions.schema['doc_id'].dataType.simpleString()}, page_index int, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, lists = batch.columns[2:]
            boxes = list(map(Box, *(c.to_pylist() for c in lists.flatten().flatten())))
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            places = [order_page(boxes[a:b], width, gap) for width, a, b in zip(widths.to_pylist(), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "page_index", "places"])

    boxes = F.sort_array(F.collect_list(F.struct(F.col("region_pos").cast("int").alias("region_pos"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")))
    rows = regions.groupBy("doc_id", "page_index").agg(F.first("page_width").alias("page_width"), boxes.alias("boxes"))
    return rows.select("doc_id", F.col("page_index").cast("int").alias("page_index"), "page_width", "boxes").mapInArrow(run, kind)


def reading_order(regions: DataFrame, gap: float = 15.0) -> DataFrame:
    """(doc_id, page_index, region_pos, reading_pos) of all pages."""
    return page_orders(regions, gap).select("doc_id", "page_index", F.posexplode("places").alias("reading_pos", "region_pos")).select("doc_id", "page_index", "region_pos", "reading_pos")


Rect = tuple[float, float, float, float]


def union(a: Rect, b: Rect) -> Rect:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def size(a: Rect) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def common(a: Rect, b: Rect) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def close(a: Rect, b: Rect, by: float) -> bool:
    return a[0] - by < b[2] and a[2] + by > b[0] and a[1] - by < b[3] and a[3] + by > b[1]


def cluster_boxes(boxes: list[Rect], by: float = NEAR) -> list[Rect]:
    """Hulls of boxes near each other: each joins the first hull it is near, then hulls merge until none is near another."""
    hulls: list[Rect] = []
    for b in boxes:
        k = next((k for k, h in enumerate(hulls) if close(h, b, by)), None)
        if k is None:
            hulls.append(b)
        else:
            hulls[k] = union(hulls[k], b)
    merged = True
    while merged:
        merged, left, out = False, list(hulls), []
        while left:
            own, rest = left[0], []
            for h in left[1:]:
                if close(own, h, by):
                    own, merged = union(own, h), True
                else:
                    rest.append(h)
            out.append(own)
            left = rest
        hulls = out
    return hulls


def vector_figures(boxes: list[Rect], texts: list[Rect], page_width: float, page_height: float) -> list[tuple[int, Rect]]:
    """Hulls of drawings that are large enough and not mostly text, with their number among all hulls."""
    hulls = cluster_boxes([b for b in boxes if size(b) >= 1.0])
    keep = lambda h: size(h) >= MIN_AREA and size(h) / (page_width * page_height) >= MIN_SHARE and sum(common(h, t) for t in texts) / max(size(h), 1.0) <= MAX_TEXT
    return [(k, h) for k, h in enumerate(hulls) if keep(h)]


def _by_page(rows: DataFrame, item: Column, *more: Column) -> DataFrame:
    """One row for each page, with an array of its items, so that a batch holds many pages."""
    return rows.groupBy("doc_id", F.col("page_index").cast("int").alias("page_index")).agg(F.sort_array(F.collect_list(item)).alias("items"), *more)


def _rect(b: dict) -> Rect:
    return b["x0"], b["y0"], b["x1"], b["y1"]


def figure_clusters(drawings: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page_index, block_id, x0..y1) of figures drawn as paths; drawings have draw_pos, bbox and the page's size."""
    kind = "doc_id long, page_index int, block_id string, x0 double, y0 double, x1 double, y1 double"
    box = ("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    d = drawings.select("doc_id", "page_index", F.col("draw_pos").cast("long").alias("pos"), *box, "page_width", "page_height")
    rows = d.unionByName(texts.select("doc_id", "page_index", F.lit(None).cast("long").alias("pos"), *box), allowMissingColumns=True)
    pages = _by_page(rows, F.struct("pos", "x0", "y0", "x1", "y1"), F.max("page_width").alias("w"), F.max("page_height").alias("h")).where("w IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, page, items, w, h in zip(*(c.to_pylist() for c in batch.columns)):
                boxes = [_rect(b) for b in items if b["pos"] is not None]  # in the order of drawing
                found = vector_figures(boxes, [_rect(b) for b in items if b["pos"] is None], w, h)
                out += [(doc, page, hashlib.md5(f"{doc}::fig::vector::p{page}::s{k}".encode()).hexdigest()[:12], *r) for k, r in found]
            types = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "page_index", "block_id", "x0", "y0", "x1", "y1"])

    return pages.select("doc_id", "page_index", "items", "w", "h").mapInArrow(run, kind)


def keep_distinct(figures: list[Rect]) -> list[int]:
    """Places of figures that share no more than 70 % of the smaller area with one kept before."""
    kept: list[int] = []
    for k, f in enumerate(figures):
        if not any(min(size(f), size(figures[j])) > 0 and common(f, figures[j]) / min(size(f), size(figures[j])) > SAME for j in kept):
            kept.append(k)
    return kept


#: The order in which strategies count.
STRATEGIES = ("raster", "vector", "xobject", "gap")


def dedup_figures(figures: DataFrame) -> DataFrame:
    """Figures of all strategies without those that repeat an earlier one: (doc_id, page_index, strategy, seq, block_id)."""

    stage = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    item = F.struct(stage.alias("stage"), F.col("seq").cast("int").alias("seq"), "block_id", "strategy", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, page, items in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(doc, page, items[k]["strategy"], items[k]["seq"], items[k]["block_id"]) for k in keep_distinct([_rect(b) for b in items])]
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "page_index", "strategy", "seq", "block_id"])

    pages = _by_page(figures, item).select("doc_id", "page_index", "items")
    return pages.mapInArrow(run, "doc_id long, page_index int, strategy string, seq int, block_id string")
