"""Image boxes as Column expressions. A box is (cx, bottom, w, h) or (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajframe.functions.angles import clamp

Box = dict[str, Column]


def corners(cx: Column, bottom: Column, w: Column, h: Column) -> Box:
    return {"x1": cx - w / 2.0, "y1": bottom - h, "x2": cx + w / 2.0, "y2": bottom}


def clipped(b: Box, width: int, height: int) -> Box:
    return {"x1": clamp(b["x1"], 0.0, width - 1.0), "y1": clamp(b["y1"], 0.0, height - 1.0), "x2": clamp(b["x2"], 0.0, width - 1.0), "y2": clamp(b["y2"], 0.0, height - 1.0)}


def area(b: Box) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = area({"x1": F.greatest(a["x1"], b["x1"]), "y1": F.greatest(a["y1"], b["y1"]), "x2": F.least(a["x2"], b["x2"]), "y2": F.least(a["y2"], b["y2"])})
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def valid(w: Column, h: Column, least: tuple[float, float] = (8.0, 8.0), most: tuple[float, float] = (1200.0, 700.0)) -> Column:
    return (w >= least[0]) & (h >= least[1]) & (w <= most[0]) & (h <= most[1])


def normalised(b: Box, width: int, height: int) -> Box:
    """(cx, cy, w, h) as shares of the image."""
    return {"cx": (b["x1"] + b["x2"]) / 2.0 / width, "cy": (b["y1"] + b["y2"]) / 2.0 / height, "w": (b["x2"] - b["x1"]) / width, "h": (b["y2"] - b["y1"]) / height}


def pixels(n: Box, width: int, height: int) -> Box:
    """Whole pixel corners, rounded half to even and clipped; null when nothing is left."""
    raw = {"x1": (n["cx"] - n["w"] / 2.0) * width, "y1": (n["cy"] - n["h"] / 2.0) * height, "x2": (n["cx"] + n["w"] / 2.0) * width, "y2": (n["cy"] + n["h"] / 2.0) * height}
    whole = clipped({k: F.bround(v) for k, v in raw.items()}, width, height)
    some = (whole["x2"] > whole["x1"]) & (whole["y2"] > whole["y1"])
    return {k: F.when(some, v.cast("int")) for k, v in whole.items()}


def square_crop(b: Box, width: int, height: int, scale: float = 1.5, least: float = 64.0) -> Box:
    """Square around a box, moved into the image, then clipped."""
    side = F.greatest(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) * scale, F.lit(least))
    x = clamp((b["x1"] + b["x2"]) / 2.0 - side / 2.0, 0.0, F.greatest(width - side, F.lit(0.0)))
    y = clamp((b["y1"] + b["y2"]) / 2.0 - side / 2.0, 0.0, F.greatest(height - side, F.lit(0.0)))
    return {"x1": F.bround(x).cast("int"), "y1": F.bround(y).cast("int"), "x2": F.bround(F.least(x + side, F.lit(float(width)))).cast("int"), "y2": F.bround(F.least(y + side, F.lit(float(height)))).cast("int")}
