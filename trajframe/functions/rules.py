"""Classifications as Column expressions: domain, visibility, quality, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The validated domain of the placement table.
X_LIMIT, Z_LIMIT = 4.0, 100.0
TOLERANCE = 1e-5


def _joined(*parts: tuple[Column, str]) -> Column:
    return F.concat_ws("+", *[F.when(test, F.lit(name)) for test, name in parts])


def domain_reason(x: Column, z: Column, below: bool = False) -> Column:
    """Which limits are broken, joined by +; empty inside the domain. ``below`` also tests the least depth."""
    tests = [(x < -X_LIMIT - TOLERANCE, "x_below_min"), (x > X_LIMIT + TOLERANCE, "x_above_max")]
    tests += [(z < -TOLERANCE, "z_below_min")] * below
    return _joined(*tests, (z > Z_LIMIT + TOLERANCE, "z_above_max"))


def capability(x: Column, z: Column, min_depth: float = 0.0) -> Column:
    """CULLED first, then OOD, else SUPPORTED."""
    return F.when(z <= min_depth + TOLERANCE, "CULLED").when(domain_reason(x, z) != "", "OOD").otherwise("SUPPORTED")


def front_visibility(x: Column, y: Column, fov: float = 90.0, near: float = 0.5, far: float = 120.0) -> Column:
    """Why a front camera does not see a point (x forward, y left), or visible."""
    distance, bearing = F.hypot(x, y), F.degrees(F.atan2(y, x))
    return F.when(distance < near, "too_close").when(distance > far, "too_far").when(x <= 0, "behind").when(F.abs(bearing) > fov / 2.0, "outside_fov").otherwise("visible")


def quality(visible: Column, w: Column, h: Column, edge: Column, ratio: Column) -> Column:
    """First reason that a labelled box fails; clean otherwise."""
    return (
        F.when(~visible, "not_visible")
        .when(w < 12.0, "box_too_narrow")
        .when(h < 10.0, "box_too_short")
        .when(edge, "bbox_clipped_or_near_edge")
        .when(ratio <= 0.0, "clean_geometry_only")
        .when(ratio < 0.35, "occluded")
        .otherwise("clean")
    )


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Half-open bins [a, b); beyond the last edge the last label."""
    out = F.when(x < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(x < e, label)
    return out.otherwise(labels[-1])
