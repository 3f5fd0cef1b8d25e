"""Exact order statistics of groups of any size, by repeated histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.sources.folders import kept

c = F.col
#: Bins of a histogram, and the most values of a group that are put in order.
BINS = 1024
FEW = 100_000


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & c(k).eqNullSafe(c(f"of_{k}"))
    return out


def medians(rows: DataFrame, keys: list[str], value: str, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, median): the exact median of the finite values of each group, the mean of the two middle ones if even.

    A group's values are counted (with map-side combining) first by sign and power of two, then in ``bins`` bins of
    equal width; the bin that holds the middle one becomes the next bracket, narrowed to the values really in it. A power
    of two holds 2^52 numbers, so with 1024 bins six passes follow the first at most, however values are spread. A
    bracket of one distinct value is the answer; one of at most ``few`` rows is put in order. So a task sees a histogram
    or ``few`` rows of a group, never all of it.
    """
    v = c("v")
    own = rows.select(*keys, c(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    own = kept(own, "median-values")
    # The lower middle one, counted from 0, is looked for in [low, high]; ``left`` is its place in there.
    state = own.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("inside"))
    state = kept(state.withColumn("left", F.floor((c("n") - 1) / 2).cast("long")), "median-brackets")
    names = [f"of_{k}" for k in keys]
    done = (c("low") == c("high")) | (c("inside") <= few)
    by_power = F.when(v == 0, 0).otherwise(F.signum("v") * (F.floor(F.log2(F.abs("v"))) + 1100)).cast("int")
    first = True
    while not state.where(~done).isEmpty():
        open_ = state.where(~done).select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], "low", "high", "left", "n")
        met = own.join(open_, _same(keys)).where((v >= c("low")) & (v <= c("high")))
        width = c("high") / 2 - c("low") / 2
        place = F.when(width > 0, F.least(F.floor((v / 2 - c("low") / 2) / width * bins), F.lit(bins - 1))).otherwise((v > c("low")).cast("long"))
        # The ends of a bracket that is too narrow for its own width stay apart.
        place = by_power if first else F.when(v == c("low"), 0).when(v == c("high"), bins - 1).otherwise(place).cast("int")
        first = False
        counts = met.groupBy(*keys, "n", "left", place.alias("bin")).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("inside").over(Window.partitionBy(*keys).orderBy("bin")) - c("inside")
        chosen = counts.withColumn("before", upto).where((c("before") <= c("left")) & (c("left") < c("before") + c("inside")))
        chosen = chosen.select(*keys, "low", "high", "n", "inside", (c("left") - c("before")).alias("left"))
        state = kept(state.where(done).unionByName(chosen), "median-brackets")
    ends = state.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], "low", "high", "n", "left")
    near = own.join(ends.where("low < high"), _same(keys)).where((v >= c("low")) & (v <= c("high")))
    small = near.groupBy(*keys, "n", "left").agg(F.sort_array(F.collect_list("v")).alias("vs")).select(*keys, "n", F.get("vs", c("left").cast("int")).alias("lower"))
    lower = small.unionByName(state.where("low = high").select(*keys, "n", c("low").alias("lower")))
    lower = kept(lower, "median-lower")
    # The upper middle one: the same value again, or the smallest above it.
    two = lower.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], "n", "lower")
    above = own.join(two, _same(keys)).groupBy(*keys, "n", "lower").agg(F.count_if(v <= c("lower")).alias("upto"), F.min(F.when(v > c("lower"), v)).alias("next"))
    upper = F.when(c("upto") > F.floor(c("n") / 2), c("lower")).otherwise(c("next"))
    return above.select(*keys, F.when(c("n") % 2 == 1, c("lower")).otherwise(c("lower") + (upper - c("lower")) / 2).alias("median"))
