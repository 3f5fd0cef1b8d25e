"""Coordinate frames as Column expressions.

scenario: x forward, y left, yaw to the left. local plan: x right, z forward, yaw to the right, at the ego's start.
world: left-handed, forward (cos, sin), right (-sin, cos). camera: x right, z forward, yaw actor minus camera.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajframe.functions.angles import wrap180

#: The reference camera.
WIDTH, HEIGHT, FOV = 1280, 720, 90.0
MOUNT_FORWARD, MOUNT_UP = 1.5, 1.6
#: Nearest depth that is projected.
NEAR = 0.1


def _axes(yaw: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(yaw)), F.sin(F.radians(yaw))


def scenario_to_local(x: Column, y: Column, yaw: Column) -> dict[str, Column]:
    return {"x": -y, "z": x, "yaw": -yaw}


def local_to_world(x: Column, z: Column, yaw: Column, ego: dict[str, Column]) -> dict[str, Column]:
    """``ego`` is its pose (x, y, yaw) in the world when the plan began."""
    c, s = _axes(ego["yaw"])
    return {"x": ego["x"] + z * c - x * s, "y": ego["y"] + z * s + x * c, "yaw": wrap180(ego["yaw"] + yaw)}


def world_to_camera(x: Column, y: Column, yaw: Column, camera: dict[str, Column]) -> dict[str, Column]:
    c, s = _axes(camera["yaw"])
    dx, dy = x - camera["x"], y - camera["y"]
    return {"x": dy * c - dx * s, "z": dx * c + dy * s, "yaw": wrap180(yaw - camera["yaw"])}


def scenario_to_camera(x: Column, y: Column, yaw: Column, ego: dict[str, Column], forward: float = MOUNT_FORWARD) -> dict[str, Column]:
    """Actor in the scenario frame as the ego's camera, mounted ``forward`` of it, sees it; turns change sign."""
    c, s = _axes(ego["yaw"])
    dx, dy = x - ego["x"], y - ego["y"]
    return {"x": dx * s - dy * c, "z": dx * c + dy * s - forward, "yaw": wrap180(ego["yaw"] - yaw)}


def focal(width: int = WIDTH, fov: float = FOV) -> Column:
    return F.lit(width) / (2.0 * F.tan(F.radians(F.lit(fov / 2.0))))


def project(x: Column, y_down: Column, z: Column, width: int = WIDTH, height: int = HEIGHT, fov: float = FOV) -> dict[str, Column]:
    """Image point of a camera-frame point; null at or before the nearest depth."""
    f, seen = focal(width, fov), z > NEAR
    return {"u": F.when(seen, width / 2.0 + f * F.try_divide(x, z)), "v": F.when(seen, height / 2.0 + f * F.try_divide(y_down, z))}


def vehicle_box(x: Column, z: Column, width_m: Column, height_m: Column, margin: float = 100.0) -> dict[str, Column]:
    """Pinhole box of a vehicle standing on flat ground; visible while it reaches into the image widened by ``margin``."""
    p = project(x, F.lit(MOUNT_UP), z)
    w, h = focal() * F.try_divide(width_m, z), focal() * F.try_divide(height_m, z)
    inside = (p["u"] + w / 2.0 > -margin) & (p["u"] - w / 2.0 < WIDTH + margin) & (p["v"] > -margin) & (p["v"] - h < HEIGHT + margin)
    return {"cx": p["u"], "bottom": p["v"], "w": F.when(z > NEAR, w), "h": F.when(z > NEAR, h), "visible": (z > NEAR) & inside}


def horizon_scale(bottom: Column, horizon: float = HEIGHT / 2.0, height: float = HEIGHT, power: float = 1.4) -> Column:
    """Size from the image row that a box stands on."""
    return F.pow(F.greatest((bottom - horizon) / (height - horizon), F.lit(0.0)), F.lit(power))


def road_contact(z: Column, points: list[tuple[float, float]]) -> Column:
    """Image row where a vehicle at depth ``z`` meets the road: straight between (depth, row) points, held at both ends."""
    points = sorted(points)
    out = F.when(z <= points[0][0], points[0][1])
    for (z0, y0), (z1, y1) in zip(points, points[1:]):
        out = out.when(z <= z1, y0 + (y1 - y0) * (z - z0) / (z1 - z0))
    return out.when(z.isNotNull(), points[-1][1])


def corners(x: Column, z: Column, yaw: Column, length: float, width: float, height: float, nearest: float = 1e-4) -> list[tuple[Column, Column, Column]]:
    """Image points and depths (u, v, d) of a standing box's eight corners, null where not beyond ``nearest``."""
    cos, sin = _axes(yaw)
    points = []
    for ahead in (-length / 2, length / 2):
        for right in (-width / 2, width / 2):
            cx, cz = x + ahead * sin + right * cos, z + ahead * cos - right * sin
            for up in (0.0, height):
                points.append(tuple(F.when(cz > nearest, v) for v in (WIDTH / 2.0 + focal() * cx / cz, HEIGHT / 2.0 + focal() * (MOUNT_UP - up) / cz, cz)))
    return points


def corner_points(x: Column, z: Column, yaw: Column, length: float, width: float, height: float, nearest: float = 1e-4) -> Column:
    """Array of the image points (u, v) and depths d of :func:`corners`; corners not beyond ``nearest`` are left out."""
    points = [F.when(d.isNotNull(), F.struct(u.alias("u"), v.alias("v"), d.alias("d"))) for u, v, d in corners(x, z, yaw, length, width, height, nearest)]
    return F.filter(F.array(*points), lambda p: p.isNotNull())


def points_box(points: Column, width: int = WIDTH, height: int = HEIGHT, least: float = 2.0) -> dict[str, Column]:
    """Clipped box around image points; zeros and not visible if it misses the image or is under ``least`` pixels wide or high."""
    us, vs = F.transform(points, lambda p: p["u"]), F.transform(points, lambda p: p["v"])
    x1, x2, y1, y2 = F.array_min(us), F.array_max(us), F.array_min(vs), F.array_max(vs)
    within = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.0))
    meets = (x2 >= 0) & (x1 < width) & (y2 >= 0) & (y1 < height)
    big = (within(x2, width) - within(x1, width) >= least) & (within(y2, height) - within(y1, height) >= least)
    seen = F.coalesce(meets & big, F.lit(False))
    return {"visible": seen} | {k: F.when(seen, within(v, n)).otherwise(0.0) for k, v, n in (("x1", x1, width), ("y1", y1, height), ("x2", x2, width), ("y2", y2, height))}


def pair_box(points: Column, width: int = WIDTH, height: int = HEIGHT) -> dict[str, Column]:
    """Box around corner points as recorders give it: the reason where it is not visible, and the mean depth of the corners; unknown corners count as unseen."""
    points = F.filter(points, lambda p: p["u"].isNotNull() & p["v"].isNotNull())
    us, vs = F.transform(points, lambda p: p["u"]), F.transform(points, lambda p: p["v"])
    depths = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["d"])
    return _reasoned(F.coalesce(F.size(points), F.lit(0)), F.array_min(us), F.array_max(us), F.array_min(vs), F.array_max(vs), depths, width, height)


def corners_box(points: list[tuple[Column, Column, Column]], width: int = WIDTH, height: int = HEIGHT) -> dict[str, Column]:
    """:func:`pair_box` of :func:`corners`, in plain expressions that are compiled; functions over arrays are interpreted row by row."""
    seen = [u.isNotNull() & v.isNotNull() for u, v, _ in points]
    us, vs = ([F.when(ok, p[k]) for ok, p in zip(seen, points, strict=True)] for k in (0, 1))
    n, depths = F.lit(0), F.lit(0.0)
    for ok, (_, _, d) in zip(seen, points, strict=True):
        n, depths = n + ok.cast("int"), depths + F.when(ok, d).otherwise(0.0)
    return _reasoned(n, F.least(*us), F.greatest(*us), F.least(*vs), F.greatest(*vs), depths, width, height)


def _reasoned(n: Column, u1: Column, u2: Column, v1: Column, v2: Column, depths: Column, width: int, height: int) -> dict[str, Column]:
    """Box and reason from the number of seen corners, the ends of their points and the sum of their depths."""
    x1, y1 = F.greatest(u1, F.lit(0.0)), F.greatest(v1, F.lit(0.0))
    x2, y2 = F.least(u2, F.lit(width - 1.0)), F.least(v2, F.lit(height - 1.0))
    depth = F.try_divide(depths, n)
    outside = (x2 <= 0) | (x1 >= width) | (y2 <= 0) | (y1 >= height)
    reason = F.when(n < 2, "bbox_behind_camera").when(outside, "bbox_outside_image").when((x2 <= x1) | (y2 <= y1), "bbox_invalid")
    boxed = {k: F.when(reason.isNull(), v) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))}
    return {"visible": reason.isNull(), "reason": reason, "depth": F.when(F.coalesce(reason, F.lit("")).isin("", "bbox_outside_image"), depth)} | boxed
