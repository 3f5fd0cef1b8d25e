"""Column expressions of the frame runtime: corrections, queries of the grid, identifiers, input vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajframe.functions.angles import wrap180

IMAGE = (1280, 720)


def relative_pose(x: Column, y: Column, yaw: Column, ex: Column, ey: Column, eyaw: Column) -> dict[str, Column]:
    """An actor's pose seen from the ego: ahead, to the right, turned to [-180, 180)."""
    dx, dy, a = x - ex, y - ey, F.radians(eyaw)
    return {"ahead": dx * F.cos(a) + dy * F.sin(a), "right": dy * F.cos(a) - dx * F.sin(a), "rel_yaw": wrap180(yaw - eyaw)}


def centred_box(u: Column, v: Column, depth: Column, width_m: float, height_m: float, focal: float = 640.0) -> dict[str, Column]:
    """Whole-pixel box around a projected centre, cut off at the image; nulls where it is too near or empty."""
    held = lambda a, n: F.least(F.greatest(a, F.lit(0.0)), F.lit(n - 1.0))
    w, h = focal * width_m / depth, focal * height_m / depth
    x1, x2 = held(u - w / 2, IMAGE[0]), held(u + w / 2, IMAGE[0])
    y1, y2 = held(v - h / 2, IMAGE[1]), held(v + h / 2, IMAGE[1])
    ok = (depth > 0.1) & (x2 > x1) & (y2 > y1)
    return {k: F.when(ok, a.cast("int")) for k, a in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))}


def corrected_box(cx: Column, bottom: Column, w: Column, h: Column, centre: tuple[float, float] = (1.0, 0.0), foot: tuple[float, float] = (1.0, 0.0), size: tuple[float, float] = (1.0, 1.0), horizon: float = IMAGE[1] * 0.36) -> dict[str, Column]:
    """A looked-up box scaled and shifted: about the image's centre, about the horizon, and in size."""
    cx = IMAGE[0] / 2 + (cx - IMAGE[0] / 2) * centre[0] + centre[1]
    bottom = horizon + (bottom - horizon) * foot[0] + foot[1]
    w, h = w * size[0], h * size[1]
    return {"cx": cx, "bottom": bottom, "w": w, "h": h, "x": cx - w / 2.0, "y": bottom - h}


def centre_override(x: Column, z: Column, cx: Column, w: Column, focal: float = 640.0) -> dict[str, Column]:
    """The centre by projection where the actor is ahead, and the sides rebuilt around it, not cut off."""
    at = F.when(z > 1e-6, IMAGE[0] / 2 + focal * x / z).otherwise(cx)
    return {"cx": at, "x1": at - w / 2.0, "x2": at + w / 2.0}


def closing_speed(vx: Column, vy: Column, yaw: Column, other: Column, most: float = 25.0) -> Column:
    """Ego speed ahead (never backward) and the other's, held to 0..most."""
    ahead = F.greatest(vx * F.cos(F.radians(yaw)) + vy * F.sin(F.radians(yaw)), F.lit(0.0))
    return F.least(F.greatest(ahead + other, F.lit(0.0)), F.lit(most))


def lane_shift(x: Column, y: Column, yaw: Column, offset: float) -> dict[str, Column]:
    """A pose moved to the lane's right by ``offset`` and turned around."""
    a = F.radians(yaw)
    return {"x": x + offset * F.sin(a), "y": y - offset * F.cos(a), "opposite": wrap180(yaw + 180.0)}


def lane_offset(side: Column, width: float = 3.5) -> tuple[Column, Column]:
    """The lateral place of a side's lane (left positive) and what is wrong with it."""
    return F.when(side == "left", width).when(side == "right", -width), F.when(~F.coalesce(side.isin("left", "right"), F.lit(False)), F.concat(F.lit("unsupported side: "), F.coalesce(side, F.lit("none"))))


def number_tag(v: Column) -> Column:
    """Two decimals without trailing zeros, m for minus and p for the point."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
    return F.translate(short, "-.", "mp")


def scenario_id(kind: Column, side: Column, distance: Column, speed: Column) -> Column:
    return F.concat_ws("_", kind, side, F.concat(F.lit("d"), number_tag(distance)), F.concat(F.lit("v"), number_tag(speed)), F.lit("v1"))


def frame_id(path: Column) -> Column:
    """The number before a file name's ending, null without one."""
    found = F.regexp_extract(path, r"(\d+)\.[A-Za-z]+$", 1)
    return F.when(found != "", found.cast("long"))


def asset(key: Column, known: dict[str, str]) -> tuple[Column, Column]:
    """The asset a key stands for (vehicle.* stands for itself), and what is wrong with it."""
    found = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[key]
    out = F.when(key.startswith("vehicle."), key).otherwise(found)
    return out, F.when(out.isNull(), F.concat(F.lit("unknown asset: "), F.coalesce(key, F.lit("none"))))


def unlike(actual: dict[str, Column], expected: dict[str, float], tolerance: float = 1e-6) -> Column:
    """``name:actual!=expected`` for each setting that differs (whole numbers exactly), joined by ``;``."""
    one = lambda k, e: F.when((actual[k] != e) if isinstance(e, int) else (F.abs(actual[k] - e) > tolerance), F.concat(F.lit(f"{k}:"), actual[k].cast("string"), F.lit(f"!={e}")))
    return F.concat_ws(";", *[one(k, e) for k, e in expected.items()])


def plausible(visible: Column, cx: Column, bottom: Column, w: Column, h: Column) -> Column:
    """Whether a looked-up box can be used, else the geometric one is."""
    return F.coalesce(visible & (w > 1) & (h > 1) & cx.between(-IMAGE[0], 2 * IMAGE[0]) & bottom.between(-IMAGE[1], 2 * IMAGE[1]), F.lit(False))


def suspicious(cx: Column, bottom: Column, w: Column, h: Column) -> Column:
    return (w <= 0) | (h <= 0) | (bottom < 0) | (cx < -5000) | (cx > 6000) | (w > 5000) | (h > 5000)


def grid_query(x: Column, z: Column, lows: tuple[float, float], highs: tuple[float, float], mode: Column, margin: float = 5.0) -> dict[str, Column]:
    """What of the grid a state asks for: held inside it; nearer than the safe distance by ``mode`` (clamp, edge, invisible)."""
    near = z < lows[1] + margin
    gone = near & (mode == "invisible")
    used = F.when(near & (mode == "clamp"), lows[1] + margin).otherwise(z)
    held = lambda v, k: F.least(F.greatest(v, F.lit(lows[k])), F.lit(highs[k]))
    return {"x_used": held(x, 0), "z_used": F.when(gone, z).otherwise(held(used, 1)), "close_range": near, "valid": ~gone, "reason": F.when(gone, "below_safe_min_rel_z").otherwise("ok")}


def rect(cx: Column, bottom: Column, w: Column, h: Column, probability: Column, z: Column) -> dict[str, Column]:
    """Rectangle of a looked-up box: visible where likely, a pixel wide and ahead; cut off at the image, and whether that changed it."""
    seen = F.coalesce((probability >= 0.5) & (w >= 1) & (h >= 1) & (z >= 0), F.lit(False))
    raw = (cx - w / 2.0, bottom - h, cx + w / 2.0, bottom)
    held = [F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.0)) for v, n in zip(raw, (*IMAGE, *IMAGE), strict=True)]
    out = {k: F.when(seen, v).otherwise(0.0) for k, v in zip(("x1", "y1", "x2", "y2"), held, strict=True)}
    changed = F.lit(False)
    for a, b in zip(raw, held, strict=True):
        changed = changed | (a != b)
    return out | {"visible": seen, "clamped": seen & changed}


def displacement_ahead(x: Column, y: Column, x0: Column, y0: Column, yaw0: Column) -> Column:
    """How far a pose is ahead of a start along the start's heading."""
    a = F.radians(yaw0)
    return (x - x0) * F.cos(a) + (y - y0) * F.sin(a)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Between points of two or three coordinates."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def speed_norm(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)
