"""What a renderer would be told of each frame: state, box, sprite and order, without pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import viewpoint
from trajframe.functions.geometry import vehicle_box

c = F.col


def frame_metadata(rows: DataFrame, scene: list[str], actor: list[str], width_m: float, height_m: float, min_depth: float, sprite_step: float = 15.0) -> DataFrame:
    """Adds active, box, rendered, sprite and order_index for camera-relative states (x, z, yaw).

    Actors at ``min_depth`` or nearer are culled. A rendered one has its box in view; its sprite is the nearest of a
    full turn in steps, a tie to the lower angle; order_index counts rendered ones of a scene from the farthest.
    """
    box = vehicle_box(c("x"), c("z"), F.lit(width_m), F.lit(height_m))
    out = rows.withColumn("active", F.coalesce(c("z") > min_depth, F.lit(False))).withColumns(box)
    out = out.withColumn("rendered", F.coalesce(c("active") & c("visible"), F.lit(False))).drop("visible")
    turns = int(round(360 / sprite_step))
    step = F.ceil(F.round(viewpoint(c("x"), c("z"), c("yaw")), 6) / sprite_step - 0.5).cast("int") % turns
    place = F.row_number().over(Window.partitionBy(*scene, "rendered").orderBy(F.desc("z"), *actor)) - 1
    shown = lambda v: F.when(c("rendered"), v)
    return out.withColumns({"sprite": shown((step * sprite_step).cast("int")), "order_index": shown(place.cast("long"))} | {k: shown(c(k)) for k in ("cx", "bottom", "w", "h")})


def preview(rows: DataFrame, scene: list[str], every: int = 30, sprite_step: float = 15.0) -> DataFrame:
    """Every ``every``-th frame of a scene from its first on, and its last, with the angle it is seen from and its sprite.

    ``rows`` hold the scene, frame, and camera-relative x, z, yaw of actors.
    """
    ends = rows.groupBy(*scene).agg(F.min("frame").alias("opens"), F.max("frame").alias("ends"))
    kept = rows.join(ends, scene).where(((c("frame") - c("opens")) % every == 0) | (c("frame") == c("ends"))).drop("opens", "ends")
    turns = int(round(360 / sprite_step))
    seen = viewpoint(c("x"), c("z"), c("yaw"))
    step = F.ceil(F.round(seen, 6) / sprite_step - 0.5).cast("int") % turns
    return kept.withColumns({"seen": seen, "sprite": (step * sprite_step).cast("int")})
