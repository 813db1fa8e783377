"""Box geometry as column expressions; boxes are (x, y, width, height) in pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def expand(box: dict[str, Column], page_width: Column, page_height: Column, ratio: Column, pad: Column, least: float = 4.0) -> dict[str, Column]:
    """Grow about the centre to ``side * ratio + pad``, with corners kept on the page."""
    out = {}
    for at, side, limit in (("x", "width", page_width), ("y", "height", page_height)):
        mid, half = box[at] + box[side] / 2, (box[side] * ratio + pad) / 2
        low = F.greatest(F.lit(0.0), mid - half)
        high = F.least(limit.cast("double"), mid + half)
        out[at], out[side] = low, F.greatest(F.lit(least), high - low)
    return out


def margin(box: dict[str, Column], page_width: Column, page_height: Column, by: float) -> dict[str, Column]:
    """Grow each side by a margin, kept on the page."""
    out = {}
    for at, side, limit in (("x", "width", page_width), ("y", "height", page_height)):
        low = F.greatest(F.lit(0.0), box[at] - by)
        out[at], out[side] = low, F.least(limit.cast("double"), box[at] + box[side] + by) - low
    return out


def overlap(a: str, b: str) -> Column:
    """The area shared by boxes whose columns have the prefixes ``a`` and ``b``."""

    def along(at: str, side: str) -> Column:
        low = F.greatest(F.col(f"{a}{at}"), F.col(f"{b}{at}"))
        high = F.least(F.col(f"{a}{at}") + F.col(f"{a}{side}"), F.col(f"{b}{at}") + F.col(f"{b}{side}"))
        return F.greatest(F.lit(0.0), high - low)

    return along("x", "width") * along("y", "height")


def area(prefix: str = "") -> Column:
    return F.greatest(F.lit(1.0), F.col(f"{prefix}width") * F.col(f"{prefix}height"))


def iou(a: str, b: str) -> Column:
    shared = overlap(a, b)
    return shared / F.greatest(F.lit(1.0), area(a) + area(b) - shared)


def smaller_overlap(a: str, b: str) -> Column:
    return overlap(a, b) / F.least(area(a), area(b))
