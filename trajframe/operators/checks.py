"""Agreement of two exports, frame continuity, and metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import finite
from trajframe.operators.selection import medians

c = F.col


def invariants(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], group: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Full outer agreement of two frame tables by ``group``: rows of one side only, worst error a field, verdict."""
    left = a.select(*key, *[c(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    right = b.select(*key, *[c(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = left.join(right, key, "full_outer")
    errors = {f: F.max(F.abs(c(f"a_{f}") - c(f"b_{f}"))) for f in fields}
    near = F.lit(True)
    for f in fields:  # a value that one side alone lacks is a disagreement
        near = near & F.coalesce(F.abs(c(f"a_{f}") - c(f"b_{f}")) <= tolerance, c(f"a_{f}").isNull() & c(f"b_{f}").isNull())
    out = both.groupBy(*group).agg(F.count_if(c("in_b").isNull()).alias("only_a"), F.count_if(c("in_a").isNull()).alias("only_b"), *[F.round(e, 6).alias(f"max_{f}") for f, e in errors.items()], F.coalesce(F.bool_and(F.when(c("in_a") & c("in_b"), near)), F.lit(True)).alias("close"))
    return out.withColumn("verdict", F.when((c("only_a") == 0) & (c("only_b") == 0) & c("close"), "PASS").otherwise("FAIL")).drop("close")


def gaps(rows: DataFrame, key: list[str], frame: str = "frame") -> DataFrame:
    """(key, frame, next_frame): where a frame is not followed by the next one."""
    w = Window.partitionBy(*key).orderBy(frame)
    return rows.select(*key, frame, F.lead(frame).over(w).alias("next_frame")).where(c("next_frame") != c(frame) + 1)


def described(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, mean, exact median, min and max of each metric over its finite values, a row a metric even without any.

    The median comes from :func:`trajframe.operators.selection.medians`: no task holds a metric's values.
    """
    by = by or []
    number = {m: finite(c(m).cast("double")).alias(m) for m in metrics}
    long = rows.select(*by, *number.values()).unpivot(by, metrics, "metric", "value")
    out = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    if not by:  # also over an empty table
        out = rows.sparkSession.createDataFrame([(m,) for m in metrics], "of string").join(F.broadcast(out), c("of") == c("metric"), "left").select(c("of").alias("metric"), F.coalesce("n", F.lit(0)).alias("n"), "mean", "least", "most")
    keys = [*by, "metric"]
    mid = medians(long, keys, "value").select(*[c(k).alias(f"of_{k}") for k in keys], F.round("median", 6).alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"of_{k}"))
    return out.join(mid, same, "left").select(*keys, "n", "mean", "median", "least", "most")


def normaliser(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is under 1e-6."""
    long = rows.unpivot([], features, "feature", "value")
    std = F.stddev_pop("value")
    return long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.when(std < 1e-6, 1.0).otherwise(std), 6).alias("std"))


def capture_score(rows: DataFrame, key: list[str]) -> DataFrame:
    """Score of capture candidates from visible, edge and area: steady, whole views score high; unseen ones -1e9."""
    seen = F.count_if("visible")
    area = F.when(c("visible") & (c("area") > 0), c("area"))
    spread = F.when(F.count(area) < 2, 1.0).otherwise(F.stddev_pop(area) / F.greatest(F.avg(area), F.lit(1.0)))
    score = F.when(seen == 0, -1e9).otherwise(100.0 * seen - 20.0 * F.count_if(c("visible") & c("edge")) - 40.0 * spread)
    return rows.groupBy(*key).agg(seen.alias("n_visible"), F.round(score, 4).alias("score"))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule that a spec breaks; a rule is true where it is broken, null counts as kept."""
    broken = F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()])
    return rows.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def far_behind(rows: DataFrame, key: list[str], x: str = "x", frame: str = "frame", start: float = -10.0, moving: float = -20.0) -> DataFrame:
    """(key, frame, severity, message): actors that start under ``start`` metres, or come under ``moving`` later, warned of."""
    first = Window.partitionBy(*key).orderBy(frame)
    at = rows.select(*key, frame, x, F.row_number().over(first).alias("n"))
    said = F.array(F.when((c("n") == 1) & (c(x) < start), F.lit("starts_far_behind")), F.when(c(x) < moving, F.lit("moves_far_behind")))
    return at.select(*key, frame, F.lit("warning").alias("severity"), F.explode(F.filter(said, lambda m: m.isNotNull())).alias("message"))


def missing_keys(documents: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """(key, rule): required paths (dots into structs) that a parsed document lacks."""
    return violations(documents, key, {f"missing {path}": c(path).isNull() for path in required})
