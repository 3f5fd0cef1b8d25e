"""Canonical frame tables derived from the given star schema by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, frame, x, y, yaw, speed): one row an event, frames by time within a user."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        c("user_id").alias("run"), (F.row_number().over(by_time) - 1).cast("long").alias("frame"),
        (c("value") / 10.0).alias("x"), ((c("event_id") % 70) / 10.0 - 3.5).alias("y"),
        (c("event_id") % 361 - 180).cast("double").alias("yaw"), (c("event_id") % 40).cast("double").alias("speed"),
    )


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, actor_id, frame, visible, cx, bottom, w, h, depth, k): recorded boxes, the first row of each key."""
    key = Window.partitionBy(c("o_custkey") % 50, "o_orderstatus", c("o_orderkey") % 300).orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice").withColumn("n", F.row_number().over(key)).where("n = 1")
    p = c("o_totalprice")
    return o.select(
        (c("o_custkey") % 50).alias("case_id"), c("o_orderstatus").alias("actor_id"), (c("o_orderkey") % 300).alias("frame"),
        (c("o_orderkey") % 10 != 0).alias("visible"), (p % 880.0 + 200.0).alias("cx"), (p % 300.0 + 380.0).alias("bottom"),
        (p % 180.0 + 20.0).alias("w"), (p % 120.0 + 15.0).alias("h"), (p % 60.0 + 2.0).alias("depth"), c("o_orderkey").alias("k"),
    )


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes as a renderer gives them: some frames missing, boxes shifted."""
    shift = (c("k") % 11 - 5).cast("double")
    r = real(spark, sf_dir).where("k % 7 <> 0")
    return r.select("case_id", "actor_id", "frame", (c("k") % 13 != 0).alias("visible"), (c("cx") + shift).alias("cx"), (c("bottom") - shift).alias("bottom"), (c("w") + shift / 2.0).alias("w"), (c("h") - shift / 4.0).alias("h"), "depth", "k")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, line, x, z, yaw): actor states beside a camera, one a line item."""
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("line"), ((c("l_partkey") % 160) / 10.0 - 8.0).alias("x"), (c("l_quantity") * 2.5 - 5.0).alias("z"), (c("l_suppkey") * 3.6).alias("yaw"))
