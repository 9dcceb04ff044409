"""Box algebra over four double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def side(prefix: str | Column, name: str) -> Column:
    """A side of a box: of the struct column of that name, of a struct, or of the row itself."""
    if isinstance(prefix, Column):
        return prefix[name]
    return F.col(f"{prefix}.{name}" if prefix else name)


def width(p: str | Column = "") -> Column:
    return F.greatest(F.lit(0.0), side(p, "x2") - side(p, "x1"))


def height(p: str | Column = "") -> Column:
    return F.greatest(F.lit(0.0), side(p, "y2") - side(p, "y1"))


def area(p: str | Column = "") -> Column:
    return width(p) * height(p)


def cx(p: str | Column = "") -> Column:
    return (side(p, "x1") + side(p, "x2")) / 2.0


def cy(p: str | Column = "") -> Column:
    return (side(p, "y1") + side(p, "y2")) / 2.0


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs; 0 when they do not overlap."""
    w = F.least(side(a, "x2"), side(b, "x2")) - F.greatest(side(a, "x1"), side(b, "x1"))
    h = F.least(side(a, "y2"), side(b, "y2")) - F.greatest(side(a, "y1"), side(b, "y1"))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlap_y(a: str | Column, b: str | Column) -> Column:
    low = F.greatest(side(a, "y1"), side(b, "y1"))
    return F.greatest(F.lit(0.0), F.least(side(a, "y2"), side(b, "y2")) - low)


def ordered_corners(p: str = "") -> dict[str, Column]:
    """Sides with swapped corners put right."""
    return {
        "x1": F.least(side(p, "x1"), side(p, "x2")),
        "y1": F.least(side(p, "y1"), side(p, "y2")),
        "x2": F.greatest(side(p, "x1"), side(p, "x2")),
        "y2": F.greatest(side(p, "y1"), side(p, "y2")),
    }


def on_page(w: Column, h: Column, p: str = "", min_side: float = 4.0) -> dict[str, Column]:
    """Sides ordered, clamped to the page and widened to ``min_side``."""
    c = ordered_corners(p)
    w, h = w.cast("double"), h.cast("double")
    x1, y1 = F.greatest(F.lit(0.0), c["x1"]), F.greatest(F.lit(0.0), c["y1"])
    x2, y2 = F.least(w, c["x2"]), F.least(h, c["y2"])
    return {
        "x1": x1,
        "y1": y1,
        "x2": F.when(x2 - x1 < min_side, F.least(w, x1 + min_side)).otherwise(x2),
        "y2": F.when(y2 - y1 < min_side, F.least(h, y1 + min_side)).otherwise(y2),
    }


def valid(p: str = "") -> Column:
    ok = F.lit(True)
    for s in SIDES:
        ok = ok & side(p, s).isNotNull() & ~F.isnan(side(p, s)) & (F.abs(side(p, s)) < F.lit(float("inf")))
    return ok
