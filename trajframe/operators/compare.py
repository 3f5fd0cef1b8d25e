"""Recorded against synthetic frames: the comparison grid and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.functions.angles import finite
from trajframe.functions.rules import domain_reason

KEY = ["case_id", "actor_id", "frame"]
PARTS = ("cx", "bottom", "w", "h")


def comparison_grid(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Common frames of a case x all its actors: one row a cell with each side's presence, visibility and boxes.

    Both sides are one table that is shuffled once, by case and frame: there, a frame's cells are put together, and the
    case's actors that it lacks are added from an array of the case's actors, which is counted from keys alone. Rows
    that repeat a key on one side are one cell, that of the greatest row. Rows with a null in their key are left out.
    """
    parts = ("visible", *PARTS, "depth")
    box = F.struct(*[F.col(x).alias(x) for x in parts])
    none = F.lit(None).cast(real.select(box.alias("b")).schema["b"].dataType)
    side = lambda df, r, s: df.select(*KEY, r.alias("real"), s.alias("synth"))
    both = side(real, box, none).unionByName(side(synth, none, box)).where(" and ".join(f"{k} is not null" for k in KEY))
    actors = both.groupBy(F.col("case_id").alias("of")).agg(F.collect_set("actor_id").alias("actors"))
    # Both groupings below keep to this one shuffle, as (case_id, frame) is part of their keys.
    cells = both.repartition("case_id", "frame").groupBy("case_id", "frame", "actor_id").agg(F.max("real").alias("real"), F.max("synth").alias("synth"))
    frames = cells.groupBy("case_id", "frame").agg(F.collect_list(F.struct("actor_id", "real", "synth")).alias("cells"), F.max("real").alias("any_real"), F.max("synth").alias("any_synth"))
    frames = frames.where("any_real is not null and any_synth is not null").select("case_id", "frame", "cells").join(actors, F.col("case_id") == F.col("of"))
    absent = F.transform(F.array_except("actors", F.transform("cells", lambda x: x["actor_id"])), lambda a: F.struct(a.alias("actor_id"), none.alias("real"), none.alias("synth")))
    rows = frames.select("case_id", "frame", F.explode(F.concat("cells", absent)).alias("x"))
    flag = lambda v: F.coalesce(v, F.lit(False))
    flat = [c for s in ("real", "synth") for c in (F.col(f"x.{s}").isNotNull().alias(f"{s}_present"), *[(flag(F.col(f"x.{s}.{p}")) if p == "visible" else F.col(f"x.{s}.{p}")).alias(f"{s}_{p}") for p in parts])]
    return rows.select("case_id", F.col("x.actor_id").alias("actor_id"), "frame", *flat)


def with_errors(grid: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """Adds err_<part>, synthetic minus real, where both are visible and (with a threshold) deep enough."""
    counted = F.col("real_visible") & F.col("synth_visible")
    if min_depth > 0:
        counted = counted & (finite(F.col("real_depth")) >= min_depth)
    return grid.withColumns({f"err_{p}": F.when(counted, finite(F.col(f"synth_{p}") - F.col(f"real_{p}"))) for p in PARTS} | {"counted": F.coalesce(counted, F.lit(False))})


def _share(test: Column, of: Column | None = None) -> Column:
    return F.round(F.avg(F.when(of, test.cast("double")) if of is not None else test.cast("double")), 6)


def summary_columns() -> dict[str, Column]:
    rp, sp, rv, sv = (F.col(x) for x in ("real_present", "synth_present", "real_visible", "synth_visible"))
    out = {
        "n_rows": F.count(F.lit(1)), "n_both": F.count_if(rp & sp), "n_real_only": F.count_if(rp & ~sp), "n_synth_only": F.count_if(~rp & sp),
        "n_real_seen_only": F.count_if(rv & ~sv), "n_synth_seen_only": F.count_if(~rv & sv), "n_counted": F.count_if(F.col("counted")),
        "presence_agreement": _share(rp == sp), "visibility_agreement": _share(rv == sv, rp & sp),
    }
    for p in PARTS:
        out[f"mae_{p}"] = F.round(F.avg(F.abs(f"err_{p}")), 6)
        out[f"mean_{p}"] = F.round(F.avg(f"err_{p}"), 6)
    return out


def summary(grid: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """Counts, agreements and errors by case and actor, by case, and over all (nulls name the totals)."""
    return with_errors(grid, min_depth).rollup("case_id", "actor_id").agg(*[v.alias(k) for k, v in summary_columns().items()])


def domain_split(grid: DataFrame, x: Column, z: Column) -> DataFrame:
    """Geometry inside the domain, outside it and unknown, by actor: counts, fractions of the actor's rows, errors."""
    known = finite(x).isNotNull() & finite(z).isNotNull() & F.col("real_present")
    kind = F.when(~known, "unknown").when(domain_reason(x, z, below=True) == "", "in_domain").otherwise("ood")
    rows = with_errors(grid).withColumn("domain", F.coalesce(kind, F.lit("unknown")))
    split = rows.groupBy("actor_id", "domain").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.abs(f"err_{p}")), 6).alias(f"mae_{p}") for p in PARTS])
    total = split.groupBy("actor_id").agg(F.sum("n").alias("of"))
    return split.join(total, "actor_id").withColumn("fraction", F.round(F.col("n") / F.col("of"), 6)).drop("of")


def by_threshold(real: DataFrame, synth: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Per case and depth threshold: frames counted and mean absolute errors, in one pass over one comparison.

    Each threshold is a condition within one aggregation; only a case's result is spread over the thresholds.
    """
    rows = with_errors(comparison_grid(real, synth))  # uncounted rows too, so that a case without any is still seen

    def at(least: float) -> Column:
        deep = F.col("counted") & (finite(F.col("real_depth")) >= least)
        return F.struct(F.lit(float(least)).alias("min_depth"), F.count_if(deep).alias("n_frames"), *[F.avg(F.when(deep, F.abs(f"err_{p}"))).alias(f"mae_{p}") for p in PARTS])

    return rows.groupBy("case_id").agg(F.array(*map(at, thresholds)).alias("t")).select("case_id", F.explode("t").alias("t")).select("case_id", "t.*")


def strata(per_case: DataFrame) -> DataFrame:
    """Per threshold: cases with and without frames, macro mean, min and max, frame-weighted mean of each error."""
    out = [F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("n_frames") > 0).alias("n_with"), F.sum("n_frames").alias("n_frames")]
    for p in PARTS:
        m, n = F.col(f"mae_{p}"), F.when(F.col(f"mae_{p}").isNotNull() & (F.col("n_frames") > 0), F.col("n_frames"))
        out += [F.round(f(m), 6).alias(f"{k}_{p}") for k, f in (("macro", F.avg), ("min", F.min), ("max", F.max))]
        out.append(F.round(F.try_divide(F.sum(m * n), F.sum(n)), 6).alias(f"weighted_{p}"))
    return per_case.groupBy("min_depth").agg(*out)


def worst_cases(per_case: DataFrame) -> DataFrame:
    """Per threshold and metric: the case with the largest error (to three places), the first on a tie."""
    long = per_case.where("n_frames > 0").unpivot(["case_id", "min_depth"], [f"mae_{p}" for p in PARTS], "metric", "value").withColumn("value", F.round("value", 3))
    return long.groupBy("min_depth", "metric").agg(F.min_by("case_id", F.struct(-F.col("value"), "case_id")).alias("case_id"), F.max("value").alias("value"))


def reasons_by_actor(rows: DataFrame, key: list[str]) -> DataFrame:
    """Support by actor from (key, class, reason): counts, share supported of what is required, and reasons with their counts.

    Rows are first counted by reason, so that a large actor is never gathered.
    """
    each = rows.groupBy(*key, "class", "reason").agg(F.count(F.lit(1)).alias("n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0))
    listed = F.array_sort(F.collect_list(F.when(F.col("class") == "OOD", F.format_string("%s:%d", "reason", "n"))))
    out = each.groupBy(*key).agg(F.sum("n").alias("active"), n("SUPPORTED").alias("supported"), n("CULLED").alias("culled"), n("OOD").alias("ood"), F.array_join(listed, ",").alias("reasons"))
    required = F.col("supported") + F.col("ood")
    return out.withColumn("supported_share", F.when(required == 0, 1.0).otherwise(F.col("supported") / required))
