"""Box algebra over ``struct<x,y,w,h>`` columns (integers, top-left origin)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine classes, and older names with the class that replaced them.
BLOCK_TYPES = [
    "text", "heading", "section_heading", "header", "footer", "page_number", "figure", "table",
    "key_value",
]
LEGACY_TYPES = {
    "title": "heading",
    "section_header": "section_heading",
    "page_header": "header",
    "page_footer": "footer",
    "formula": "text",
    "list_item": "text",
    "footnote": "text",
    "signature": "text",
    "figure_caption": "text",
    "figure_footnote": "text",
    "table_caption": "text",
    "table_footer": "text",
    "table_cell": "table",
    "barcode": "figure",
    "watermark": "text",
}


def fold_type(c: Column) -> Column:
    """Legacy class names folded into the nine."""
    names = F.create_map(*[F.lit(v) for pair in LEGACY_TYPES.items() for v in pair])
    return F.coalesce(F.element_at(names, c), c)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(
        x.cast("int").alias("x"), y.cast("int").alias("y"),
        w.cast("int").alias("w"), h.cast("int").alias("h"),
    )


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return F.when(
        (b["w"] > 0) & (b["h"] > 0), b["w"].cast("bigint") * b["h"]
    ).otherwise(F.lit(0).cast("bigint"))


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w.cast("bigint") * h).otherwise(F.lit(0).cast("bigint"))


def overlap_ratio(a: Column, b: Column, denom: str = "union") -> Column:
    """Intersection as a share of the union, of either area, or of the smaller or larger one."""
    inter = intersection_area(a, b)
    base = {
        "union": lambda: area(a) + area(b) - inter,
        "self": lambda: area(a),
        "other": lambda: area(b),
        "min": lambda: F.least(area(a), area(b)),
        "max": lambda: F.greatest(area(a), area(b)),
    }
    if denom not in base:
        raise ValueError(f"denom must be one of {sorted(base)}, not {denom!r}")
    whole = base[denom]()
    return F.when((inter > 0) & (whole > 0), inter / whole).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    return overlap_ratio(a, b, "union")


def contains(a: Column, b: Column, *, inclusive: bool = True) -> Column:
    """``b`` lies within ``a``, borders allowed to touch unless ``inclusive`` is off."""
    if inclusive:
        return (
            (a["x"] <= b["x"]) & (a["y"] <= b["y"])
            & (right(a) >= right(b)) & (bottom(a) >= bottom(b))
        )
    return (a["x"] < b["x"]) & (a["y"] < b["y"]) & (right(a) > right(b)) & (bottom(a) > bottom(b))


def from_polygon(points: Column) -> Column:
    """Smallest integer box around a flat ``[x0, y0, x1, y1, ...]`` array."""
    xs = F.filter(points, lambda v, i: i % 2 == 0)
    ys = F.filter(points, lambda v, i: i % 2 == 1)
    x0, y0 = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    return box(x0, y0, F.ceil(F.array_max(xs)) - x0, F.ceil(F.array_max(ys)) - y0)


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes; an empty array stops the job."""
    x0 = F.array_min(F.transform(boxes, lambda b: b["x"]))
    y0 = F.array_min(F.transform(boxes, lambda b: b["y"]))
    x1 = F.array_max(F.transform(boxes, right))
    y1 = F.array_max(F.transform(boxes, bottom))
    return F.when(F.size(boxes) > 0, box(x0, y0, x1 - x0, y1 - y0)).otherwise(
        F.raise_error(F.lit("cannot unite an empty list of boxes")).cast(
            "struct<x:int,y:int,w:int,h:int>"
        )
    )


def adjacent(a: Column, b: Column, reach: Column) -> Column:
    """Projections meet on one axis and the gap on the other is below ``reach`` pixels."""
    gap_x = F.greatest(F.lit(0), b["x"] - right(a), a["x"] - right(b))
    gap_y = F.greatest(F.lit(0), b["y"] - bottom(a), a["y"] - bottom(b))
    meet_x = (right(a) >= b["x"]) & (right(b) >= a["x"])
    meet_y = (bottom(a) >= b["y"]) & (bottom(b) >= a["y"])
    return (meet_x & (gap_y < reach)) | (meet_y & (gap_x < reach))


def grid_cells(b: Column, cell: int, reach: Column | int = 0) -> Column:
    """Cells of a square grid that a box, grown by ``reach``, touches."""
    reach = F.lit(reach) if isinstance(reach, int) else reach
    lo = lambda v: F.floor((v - reach) / F.lit(float(cell))).cast("int")
    hi = lambda v: F.floor((v + reach) / F.lit(float(cell))).cast("int")
    xs = F.sequence(lo(b["x"]), F.greatest(lo(b["x"]), hi(right(b))))
    ys = F.sequence(lo(b["y"]), F.greatest(lo(b["y"]), hi(bottom(b))))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(
        cx.alias("cx"), cy.alias("cy")))))
