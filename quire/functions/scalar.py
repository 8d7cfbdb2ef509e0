"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS, BLANK_ENDS = " \t\n\x0b\f\r", r"^\s+|\s+$"


def r4(x: Column) -> Column:
    """Four decimals, halves upwards; the same in every engine, unlike round()."""
    return F.floor(x * 1e4 + 0.5) / 1e4


def strip(x: Column) -> Column:
    """Without white space at both ends (trim() takes blanks only)."""
    late = x.endswith("\x85") | x.endswith("\u2028") | x.endswith("\u2029")  # "$" is before them, too
    return F.when(late, F.regexp_replace(x, BLANK_ENDS, "")).otherwise(F.btrim(x, F.lit(BLANKS)))


def md5_id(*parts: Column | str) -> Column:
    """The first 12 hex digits of the MD5 of some joined parts."""
    return F.substring(F.md5(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary")), 1, 12)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


# Boxes are structs of x0, y0, x1, y1.


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - b["x0"]) * F.greatest(zero, b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def overlap_score(block: Column, region: Column, share: float = 0.6) -> Column:
    """How well a block fits a region: IoU and containment, weighted."""
    return share * iou(block, region) + (1 - share) * containment(block, region)


def boxes_touch(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return (a["x0"] - tolerance < b["x1"]) & (a["x1"] + tolerance > b["x0"]) & (a["y0"] - tolerance < b["y1"]) & (a["y1"] + tolerance > b["y0"])


def scale_box(b: Column, image_w: Column, image_h: Column, page_w: Column, page_h: Column) -> Column:
    """Pixels to points, each axis by itself."""
    x, y = page_w / image_w, page_h / image_h
    return box(b["x0"] * x, b["y0"] * y, b["x1"] * x, b["y1"] * y)


def char_share(text: Column, chars: str) -> Column:
    """Share of a text's characters that are in ``chars``."""
    n = F.length(text)
    none = F.lit(False) if any(map(str.isascii, chars)) else n == F.octet_length(text)
    return F.when(none, 0.0).when(n > 0, (n - F.length(F.translate(text, chars, ""))) / n).otherwise(0.0)
