"""Input vectors and targets of the networks, and their normalisation by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.functions.angles import finite

c = F.col
#: The order of a placement network's inputs.
PLACEMENT_INPUTS = ("rel_x", "rel_z", "rel_y", "rel_yaw", "fx", "fy", "cx", "cy", "width", "height", "fov", "mount_x", "mount_y", "mount_z", "pitch", "yaw", "roll")
#: The order of a box network's inputs, what each is divided by, and what stands in for a missing one.
BOX_INPUTS = (
    ("frame_progress", 1.0, None), ("adversary_forward_m", 60.0, None), ("adversary_lateral_m", 3.0, None), ("ego_throttle", 1.0, None), ("ego_spawn_index", 300.0, None), ("time_seconds", 20.0, None),
    ("initial_distance_to_adversary_m", 60.0, "adversary_forward_m"), ("distance_to_adversary_m", 60.0, "initial_distance_to_adversary_m"), ("estimated_distance_from_displacement_m", 60.0, "distance_to_adversary_m"),
    ("distance_progress", 1.0, None), ("ego_speed_mps", 20.0, None), ("ego_forward_displacement_m", 60.0, None),
)


def box_inputs(row: dict[str, Column] | None = None) -> Column:
    """Array of 12 scaled inputs from columns (or ``row``); what is missing or not finite takes the value it falls back to, or 0."""
    value: dict[str, Column] = {}
    out = []
    for name, scale, other in BOX_INPUTS:
        own = finite((row[name] if row else c(name)).cast("double"))
        value[name] = F.coalesce(own, value[other] if other else F.lit(0.0))
        out.append(value[name] / scale)
    return F.array(*out)


def placement_inputs(state: str = "relative_state", camera: str = "camera") -> Column:
    """Array of 17 inputs: relative pose, intrinsics, size, field of view, mount and angles."""
    return F.array(*[c(f"{state if n.startswith('rel_') else camera}.{n}").cast("double") for n in PLACEMENT_INPUTS])


def placement_targets(target: str = "target", camera: str = "camera") -> Column:
    """Array of four targets as shares of the image: centre, bottom, width, height."""
    return F.array(*[F.try_divide(c(f"{target}.{n}").cast("double"), c(f"{camera}.{side}").cast("double")) for n, side in (("center_x", "width"), ("bottom_y", "height"), ("box_width", "width"), ("box_height", "height"))])


def vector_stats(rows: DataFrame, vector: str, width: int, by: list[str] | None = None, least: float = 1e-6) -> DataFrame:
    """(by, n, mean, std): arrays of the mean and population deviation at each position, in one pass; deviations under ``least`` become 1.

    A position's missing values are left out of it.
    """
    at = [F.get(vector, F.lit(i)) for i in range(width)]
    std = lambda v: F.when(F.stddev_pop(v) < least, 1.0).otherwise(F.stddev_pop(v))
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in at]).alias("mean"), F.array(*[std(v) for v in at]).alias("std"))


def normalised(rows: DataFrame, vector: str, stats: DataFrame) -> DataFrame:
    """``rows`` with ``vector`` as (x - mean) / std by a one-row ``stats``."""
    s = F.broadcast(stats.select(c("mean").alias("fit_mean"), c("std").alias("fit_std")))  # one row
    out = rows.join(s, F.lit(True), "left")
    shifted = F.zip_with(vector, "fit_mean", lambda x, m: x - m)
    return out.withColumn(vector, F.zip_with(shifted, "fit_std", lambda x, d: x / d)).drop("fit_mean", "fit_std")
