"""Mixing sources to target weights by temperature, in DataFrame operations only.

Token shares p of the sources are raised to an exponent between 0 and 1 and normalised: w ~ p^t. The exponent is found
by bisection, as the smallest whose most repeated source stays within a repetition limit, or the one whose weights
have a target entropy. The token budget defaults to the least with which every source appears whole at least once, so
that a mix never has to leave a document out.

A source's quota w x budget is met by whole passes over its documents and one partial pass. Documents lie in blocks by
hash; a pass is a permutation of a source's blocks and of the documents in each, and the partial pass takes the
permutation up to the quota. Only block totals are ordered; within them a single block a source is cut, so a source of
any size is never sorted in one place.

Nulls: rows without a source form a source of their own; null and empty texts have no tokens and appear once a whole
pass. Repeated rows are mixed as they are. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import stored

SEED = 20_240_601
REPETITION = 2.0
#: Documents in a block, about.
BLOCK = 1024
#: Blocks of a source are summed in so many bits' ranges of their order before one range of them is ordered.
RANGE_BITS = 12
#: Up to so many sources' rows are broadcast to the documents; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Exponents tried in one pass over the sources: each pass is four levels of the bisection.
_TRIES = 15


def tokens(text: str = "text") -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.length("text")), n_blocks)


def _block_order(epoch: Column, block: str = "block") -> Column:
    return F.xxhash64(F.lit(SEED), epoch, "source", block)


def _doc_order(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 1), epoch, "doc_id", F.length("text"))


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens)."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens()).alias("n_tokens"))


def find_exponent(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None) -> float:
    """The exponent by bisection over the sources' totals: 0 is uniform, 1 is the sources' own shares.

    With an entropy target (nats) it is the exponent whose weights have it; with a repetition limit the smallest that
    keeps (largest share / smallest share) ^ (1 - t) within it. Both fall, and both rise, with one sign in t.
    """
    shares = totals.where("n_tokens > 0").select(F.col("n_tokens").cast("double").alias("n"))
    low, high = 0.0, 1.0
    ends = shares.agg(F.min("n"), F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    if ends[3] <= 1:
        return 1.0
    for _ in range(10):
        tries = [low + (high - low) * (k + 1) / (_TRIES + 1) for k in range(_TRIES)]
        if entropy is None:
            too_low = [(ends[1] / ends[0]) ** (1 - t) > repetition for t in tries]
        else:
            p = F.col("n") / ends[2]
            sums = shares.agg(*[F.sum(F.pow(p, t)) for t in tries], *[F.sum(F.pow(p, t) * F.log(p)) for t in tries]).first()
            too_low = [math.log(z) - t * s / z > entropy for t, z, s in zip(tries, sums[:_TRIES], sums[_TRIES:], strict=True)]
        n = sum(too_low)  # a prefix: repetition and entropy fall as t rises
        low, high = (tries[n - 1] if n else low), (tries[n] if n < _TRIES else high)
    return high


def quotas(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """(source, weight, passes, rest, n_blocks): whole passes over a source and the tokens of the partial one."""
    n = F.col("n_tokens").cast("double")
    z = totals.where("n_tokens > 0").agg(F.sum(F.pow(n, F.lit(exponent))), F.max(F.pow(n, F.lit(1 - exponent)))).first()
    total, least = (z[0] or 1.0), (z[0] or 1.0) * (z[1] or 1.0)
    weight = F.when(n > 0, F.pow(n, F.lit(exponent)) / total).otherwise(0.0)
    # Rounded, so that a quota that is a whole number of passes is not cut by a last bit.
    quota = F.round(weight * (least if budget is None else float(budget))).cast("long")
    passes = F.when(n > 0, F.floor(quota / n)).otherwise(F.lit(1 if budget is None else 0)).cast("int")
    return totals.select("source", weight.alias("weight"), passes.alias("passes"), F.when(n > 0, quota - passes * F.col("n_tokens")).otherwise(F.lit(0)).cast("long").alias("rest"), F.ceil(F.col("n_docs") / BLOCK).cast("long").alias("n_blocks"))


def _with_small(rows: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """Join per-source rows to documents: broadcast only below a checked size."""
    small = small.withColumnRenamed("source", "mix_source")
    return rows.join(F.broadcast(small) if size <= MOST_BROADCAST else small, rows["source"].eqNullSafe(F.col("mix_source"))).drop("mix_source")


def passes_of(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, int]:
    """(source, weight, passes, n_blocks, cut_block, cut_doc), and its row count.

    In the partial pass a document takes part if its block comes before cut_block in the pass's order, or is that block
    and the document comes before cut_doc.
    """
    totals = stored(source_totals(docs), "sources")
    plan = stored(quotas(totals, find_exponent(totals, repetition, entropy), budget), "quotas")
    size = plan.count()
    lay = _with_small(docs.select("doc_id", "source", tokens().alias("n"), "text"), plan.where("rest > 0"), size)
    lay = lay.select("source", "passes", "rest", _block(F.col("n_blocks")).alias("block"), _doc_order(F.col("passes")).alias("h"), "n")
    lay = stored(lay, "lay")
    blocks = lay.groupBy("source", "passes", "rest", "block").agg(F.sum("n").alias("n")).withColumn("order", _block_order(F.col("passes")))
    # A source's blocks are summed by the first bits of their order, so that no task orders more than a range of them.
    blocks = stored(blocks.withColumn("range", F.shiftright("order", 64 - RANGE_BITS)), "mix-blocks")
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = blocks.groupBy("source", "rest", "range").agg(F.sum("n").alias("n")).withColumn("before", before("range"))
    ranges = ranges.where("before < rest and before + n >= rest").select("source", F.col("range").alias("cut_range"), F.col("before").alias("before_range"))
    inner = _with_small(blocks, ranges, size).where("range = cut_range").withColumn("before", F.col("before_range") + before("order", "block"))
    cut = inner.where("before < rest and before + n >= rest")
    cut = stored(cut.select("source", "block", F.col("order").alias("cut_block"), (F.col("rest") - F.col("before")).alias("left")), "cuts")
    inside = _with_small(lay.select("source", "block", "h", "n"), cut.withColumnRenamed("block", "at_block"), size).where("block = at_block")
    order = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)  # one block's documents
    last = inside.withColumn("upto", F.sum("n").over(order)).where("upto >= left").groupBy("source").agg(F.min("h").alias("cut_doc"))
    cuts = cut.withColumnRenamed("source", "cut_source").join(last.withColumnRenamed("source", "last_source"), F.col("cut_source").eqNullSafe(F.col("last_source"))).select("cut_source", "cut_block", "cut_doc")
    out = plan.join(cuts, plan["source"].eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return stored(out.select("source", "weight", "passes", "n_blocks", "cut_block", "cut_doc"), "passes"), size


def mix(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """Every appearance of a document in the mix: its columns, mix_weight, mix_epoch, mix_block and mix_order.

    Columns of these four names that ``docs`` has are replaced; any other name may occur. Sorting a source's rows by
    (mix_epoch, mix_block, mix_order) gives its block permutations.
    """
    docs = docs.drop("mix_weight", "mix_epoch", "mix_block", "mix_order")
    plan, size = passes_of(docs, repetition, entropy, budget)
    # The document's own columns travel in one struct, so that none clashes with those worked out here.
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", F.col("text"))
    rows = _with_small(rows, plan, size).withColumn("at", _block(F.col("n_blocks")))
    at = _block_order(F.col("passes"), "at")
    extra = (at < F.col("cut_block")) | ((at == F.col("cut_block")) & (_doc_order(F.col("passes")) <= F.col("cut_doc")))
    copies = F.col("passes") + F.coalesce(extra, F.lit(False)).cast("int")
    rows = rows.withColumn("mix_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*[F.col("doc")[n].alias(n) for n in docs.columns], F.col("weight").alias("mix_weight"), "mix_epoch", _block_order(F.col("mix_epoch"), "at").alias("mix_block"), _doc_order(F.col("mix_epoch")).alias("mix_order"))
