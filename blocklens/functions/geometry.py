"""Box arithmetic. A box is a struct<x0,y0,x1,y1> in points with a top-left origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

STAMP_MIN_AREA = 12_000.0
STAMP_MIN_SIDE = 220.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_of(prefix: str = "") -> Column:
    return box(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))


def _pos(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def width(b: Column) -> Column:
    return _pos(b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return _pos(b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return F.abs(b["x1"] - b["x0"]) * F.abs(b["y1"] - b["y0"])


def max_side(b: Column) -> Column:
    return F.greatest(F.abs(b["x1"] - b["x0"]), F.abs(b["y1"] - b["y0"]))


def intersection(a: Column, b: Column) -> Column:
    return (_pos(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
            * _pos(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])))


def iou(a: Column, b: Column, *, eps_in_union: bool = False) -> Column:
    """Intersection over union. ``eps_in_union`` adds 1e-9 to the union (embedded layer)."""
    inter = intersection(a, b)
    union = width(a) * height(a) + width(b) * height(b) - inter
    if eps_in_union:
        return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (union + F.lit(1e-9)))
    return F.when((inter <= 0) | (union <= 1e-9), F.lit(0.0)).otherwise(
        inter / F.when(union > 1e-9, union).otherwise(F.lit(1.0)))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    small = F.least(width(a) * height(a), width(b) * height(b))
    return F.when(small > 1e-6, intersection(a, b) / F.when(small > 1e-6, small).otherwise(F.lit(1.0))
                  ).otherwise(F.lit(0.0))


def center_dist(a: Column, b: Column) -> Column:
    return F.hypot((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2,
                   (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)


def _side_ratio(p: Column, q: Column) -> Column:
    ok = (p > 1e-6) & (q > 1e-6)
    return F.when(ok, F.least(p, q) / F.when(ok, F.greatest(p, q)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def same_ink(a: Column, b: Column) -> Column:
    """Two OCR boxes over the same ink."""
    d = center_dist(a, b)
    lo = lambda s, p, q: F.least(s[p], s[q])
    hi = lambda s, p, q: F.greatest(s[p], s[q])

    def share(p: str, q: str) -> Column:
        inter = _pos(F.least(hi(a, p, q), hi(b, p, q)) - F.greatest(lo(a, p, q), lo(b, p, q)))
        la = F.greatest(F.lit(1e-6), hi(a, p, q) - lo(a, p, q))
        lb = F.greatest(F.lit(1e-6), hi(b, p, q) - lo(b, p, q))
        return inter / F.least(la, lb)

    ox, oy = share("x0", "x1"), share("y0", "y1")
    return (iou(a, b) >= 0.38) | ((d <= 32) & (
        ((ox > 0.4) & (oy > 0.32)) | ((d < 14) & ((ox > 0.15) | (oy > 0.15)))))


def _same_place(a: Column, b: Column, c: dict[str, float]) -> Column:
    i, ov, d = iou(a, b, eps_in_union=True), overlap_of_smaller(a, b), center_dist(a, b)
    rw, rh = _side_ratio(width(a), width(b)), _side_ratio(height(a), height(b))
    return ((i > c["iou"]) | (ov > c["overlap"])
            | ((d < c["near"]) & (rw > c["near_side"]) & (rh > c["near_side"]))
            | ((d < c["far"]) & (ov > c["far_overlap"]) & (rw > c["far_w"]) & (rh > c["far_h"]))
            | ((i > c["weak_iou"]) & (d < c["weak_dist"])))


# Thresholds of the two "same place" rules.
EMBEDDED_RULE = dict(iou=0.32, overlap=0.5, near=20, near_side=0.4, far=32, far_overlap=0.2,
                     far_w=0.18, far_h=0.22, weak_iou=0.1, weak_dist=24)
CROSS_RULE = dict(iou=0.35, overlap=0.52, near=22, near_side=0.45, far=38, far_overlap=0.22,
                  far_w=0.2, far_h=0.25, weak_iou=0.12, weak_dist=28)


def same_embedded_hit(a: Column, b: Column) -> Column:
    return _same_place(a, b, EMBEDDED_RULE)


def same_search_location(a: Column, b: Column) -> Column:
    return _same_place(a, b, CROSS_RULE)


def line_band(y0: Column, y1: Column, c0: Column, c1: Column, n: Column) -> tuple[Column, Column]:
    """Vertical band of the text line that holds characters [c0, c1) in a tall block."""
    h = _pos(y1 - y0)
    est = F.greatest(F.lit(12.0), F.least(F.lit(24.0), h / F.greatest(F.lit(1.0), F.rint(h / F.lit(16.0)))))
    lines = F.greatest(F.lit(1.0), F.least(F.lit(64.0), F.rint(h / est)))
    start = F.greatest(F.lit(0), F.least(c0, n - 1))
    mid = (start + F.greatest(start, F.least(c1, n))) / F.lit(2.0)
    idx = F.greatest(F.lit(0.0), F.least(F.floor(mid / (n / lines)).cast("double"), lines - 1))
    step = h / lines
    whole = (n < 2) | (h < 26.0) | (lines <= 1)
    return (F.when(whole, y0).otherwise(y0 + idx * step),
            F.when(whole, y1).otherwise(y0 + idx * step + step))


def slice_box(b: Column, c0: Column, c1: Column, n: Column) -> Column:
    """Part of a box that holds characters [c0, c1) of its ``n`` characters."""
    n = F.greatest(n, F.lit(1))
    start = F.greatest(F.lit(0), F.least(c0, n))
    end = F.greatest(start, F.least(c1, n))
    w = width(b)
    top, bottom = line_band(b["y0"], b["y1"], start, end, n)
    return box(b["x0"] + w * (start / n), top, b["x0"] + w * (end / n), bottom)


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes."""
    return box(F.array_min(F.transform(boxes, lambda b: b["x0"])),
               F.array_min(F.transform(boxes, lambda b: b["y0"])),
               F.array_max(F.transform(boxes, lambda b: b["x1"])),
               F.array_max(F.transform(boxes, lambda b: b["y1"])))


def pixel_box(left: Column, top: Column, w: Column, h: Column, sx: Column, sy: Column) -> Column:
    return box(left * sx, top * sy, (left + w) * sx, (top + h) * sy)


def polygon_box(poly: Column, sx: Column, sy: Column) -> Column:
    xs = F.transform(poly, lambda p: p["x"])
    ys = F.transform(poly, lambda p: p["y"])
    return box(F.array_min(xs) * sx, F.array_min(ys) * sy, F.array_max(xs) * sx, F.array_max(ys) * sy)


def scale_to_view(b: Column, page_w: Column, page_h: Column, view_w: Column, view_h: Column,
                  *, variant: str = "field") -> Column:
    """Page box to a view: left, top, width, height with a minimum size."""
    sx, sy = view_w / page_w, view_h / page_h
    page_ar = page_w / page_h
    same = F.abs(view_w / view_h - page_ar) / page_ar < 0.02
    fx = F.when(same, (sx + sy) / 2).otherwise(sx)
    fy = F.when(same, (sx + sy) / 2).otherwise(sy)
    min_w, min_h = (1.0, 1.35) if variant == "search" else (2.0, 2.0)
    return F.struct((b["x0"] * fx).alias("left"), (b["y0"] * fy).alias("top"),
                    F.greatest((b["x1"] - b["x0"]) * fx, F.lit(min_w)).alias("width"),
                    F.greatest((b["y1"] - b["y0"]) * fy, F.lit(min_h)).alias("height"))


def stamp_hit(text: Column, b: Column, qn: str) -> Column:
    """A hit that is only a page-sized stamp word equal to the query."""
    if qn not in tx.STAMP_WORDS:
        return F.lit(False)
    t = tx.strip(text)
    return ((F.length(t) <= tx.STAMP_MAX_CHARS) & (tx._norm_native(t) == qn)
            & ((area(b) >= STAMP_MIN_AREA) | (max_side(b) >= STAMP_MIN_SIDE)))
