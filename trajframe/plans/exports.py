"""Plan documents of resolved scenarios: one JSON text a scenario, with its actors' frames in order.

A document holds one scenario's frames, so its size is bounded by the scenario's length, not by the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.functions.geometry import scenario_to_local

c = F.col
FRAME = "array<struct<frame_idx:long,t_s:double,local_x_m:double,local_y_m:double,local_z_m:double,local_yaw_deg:double,speed_mps:double>>"
PLAN = f"struct<plan_version:string,scenario_id:string,fps:int,actors:array<struct<actor_id:string,lifecycle:struct<first_frame_idx:long,last_frame_idx:long>,frames:{FRAME}>>>"
KEYFRAME = "array<struct<frame:long,state:struct<x_m:double,y_m:double,z_m:double,yaw_deg:double>>>"
RUNTIME = f"struct<scenario_id:string,timeline:struct<start_frame:long,end_frame:long,fps:int>,adversaries:array<struct<id:string,enabled:boolean,motion:struct<model:string,keyframes:{KEYFRAME}>>>>"


def _local() -> dict[str, Column]:
    p = scenario_to_local(c("x"), c("y"), c("yaw"))
    return {"x": p["x"], "y": F.lit(0.0), "z": p["z"], "yaw": p["yaw"]}


def execution_plan(frames: DataFrame, fps: int = 30) -> DataFrame:
    """(scenario_id, plan): from frames (scenario_id, actor_id, frame, x, y, yaw, speed) in the scenario frame."""
    p = _local()
    frame = F.struct(c("frame").alias("frame_idx"), (c("frame") / float(fps)).alias("t_s"), p["x"].alias("local_x_m"), p["y"].alias("local_y_m"), p["z"].alias("local_z_m"), p["yaw"].alias("local_yaw_deg"), c("speed").alias("speed_mps"))
    actors = frames.groupBy("scenario_id", "actor_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"), F.struct(F.min("frame").alias("first_frame_idx"), F.max("frame").alias("last_frame_idx")).alias("lifecycle"))
    docs = actors.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("actor_id", "lifecycle", "frames"))).alias("actors"))
    return docs.select("scenario_id", F.to_json(F.struct(F.lit("2.0").alias("plan_version"), c("scenario_id").cast("string").alias("scenario_id"), F.lit(fps).alias("fps"), "actors")).alias("plan"))


def runtime_scenario(frames: DataFrame, fps: int = 30) -> DataFrame:
    """(scenario_id, plan): the same frames as keyframed motion within the scenario's own timeline."""
    p = _local()
    key = F.struct("frame", F.struct(*[v.alias(n) for n, v in zip(("x_m", "y_m", "z_m", "yaw_deg"), (p["x"], p["y"], p["z"], p["yaw"]))]).alias("state"))
    actors = frames.groupBy("scenario_id", "actor_id").agg(F.array_sort(F.collect_list(key)).alias("keys"), F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    actor = F.struct(c("actor_id").alias("id"), F.lit(True).alias("enabled"), F.struct(F.lit("keyframed").alias("model"), c("keys").alias("keyframes")).alias("motion"))
    docs = actors.groupBy("scenario_id").agg(F.array_sort(F.collect_list(actor)).alias("adversaries"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    timeline = F.struct(c("lo").alias("start_frame"), c("hi").alias("end_frame"), F.lit(fps).alias("fps"))
    return docs.select("scenario_id", F.to_json(F.struct(c("scenario_id").cast("string").alias("scenario_id"), timeline.alias("timeline"), "adversaries")).alias("plan"))


def plan_frames(plans: DataFrame) -> DataFrame:
    """(scenario_id, actor_id, frame, x, z, yaw, speed) read back from execution plans, in the local frame."""
    a = plans.select("scenario_id", F.explode(F.from_json("plan", PLAN)["actors"]).alias("a")).select("scenario_id", "a.actor_id", F.explode("a.frames").alias("f"))
    return a.select("scenario_id", "actor_id", c("f.frame_idx").alias("frame"), c("f.local_x_m").alias("x"), c("f.local_z_m").alias("z"), c("f.local_yaw_deg").alias("yaw"), c("f.speed_mps").alias("speed"))


def runtime_frames(plans: DataFrame) -> DataFrame:
    """(scenario_id, actor_id, frame, x, z, yaw) read back from runtime scenarios, in the local frame."""
    a = plans.select("scenario_id", F.explode(F.from_json("plan", RUNTIME)["adversaries"]).alias("a")).select("scenario_id", c("a.id").alias("actor_id"), F.explode("a.motion.keyframes").alias("k"))
    return a.select("scenario_id", "actor_id", c("k.frame").alias("frame"), c("k.state.x_m").alias("x"), c("k.state.z_m").alias("z"), c("k.state.yaw_deg").alias("yaw"))
