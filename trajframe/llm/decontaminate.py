"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A text is its words (letters and digits, without case). A seed is the hash of the words at a mask's offsets; the words
in between are ignored, so a substitution there does not lose the hit. The overlap counts where some stretch of
``STRETCH`` words (the item's length, if shorter) has at least ``SHARE`` of its words equal; items of under
``EXACT_UNDER`` words count where all of them are equal.

The masks lose nothing: however the substitutions that ``SHARE`` allows lie in a stretch, some mask fits between them
(a test enumerates them). Items shorter than a stretch have masks of their own, which texts are hashed by only where
the benchmark has items of that length.

Seeds of all texts are joined with those of the benchmark, a stated query set, in blocks; each hit fixes an item and a
shift, along which the item is laid over the text's words (as 64-bit hashes).

Nulls: null texts and items have no words. Rows without a doc_id have no
result of their own and are kept by :func:`drop_contaminated`. Repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import stored

STRETCH, SHARE, EXACT_UNDER = 13, 0.75, 8
#: Up to so many benchmark seeds are broadcast at a time (three longs and two ints each).
MOST_BROADCAST = 1_000_000
#: Offsets of the masks by how many words a stretch has.
MASKS: dict[int, tuple[tuple[int, ...], ...]] = {n: (tuple(range(n)),) for n in range(1, EXACT_UNDER)} | {
    8: ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 5, 6)),
    9: ((0, 1, 2, 4), (0, 2, 5, 6)),
    10: ((0, 1, 2, 3), (0, 1, 2, 4)),
    11: ((0, 1, 2, 4),),
    12: ((0, 1, 2, 4), (0, 1, 6, 8)),
    13: ((0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 6, 8, 9)),
}


def words(col: str) -> Column:
    """Words of a text: what lies between ASCII signs, controls and spaces, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[\x00-/:-@\[-`{-\x7f]+"), lambda w: w != "")


def word_hashes(rows: DataFrame, key: str) -> DataFrame:
    """(key, h): the hash of each word of each text."""
    return rows.select(key, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("h"))


def seeds(hashed: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """``hashed`` with a row for each position pos and mask that fits there: seed is the hash of the words under it.

    Positions are exploded before words are looked up, so that Spark compiles the whole of it, and the array of a text's
    words is only pointed at, not copied, until rows have met a seed of the benchmark.
    """
    c = F.col
    at = hashed.withColumn("pos", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))))
    # A mask's offsets as bits tell its seeds from those of other masks; where it reaches beyond the text it has none.
    under = lambda m: F.when(c("pos") + m[-1] < F.size("h"), F.xxhash64(F.lit(sum(1 << o for o in m)), *[F.get(c("h"), c("pos") + o) for o in m]))
    return at.withColumn("seed", F.explode(F.array(*map(under, masks)))).where("seed is not null")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, item_id, item, shift, part) where some seed of a text and of an item agree, and the items (item_id, item, h).

    item tells texts of one item_id apart; shift is text minus item position; part holds the text's words under the item.
    The benchmark is dealt into blocks of at most about ``MOST_BROADCAST`` seeds, each met by all texts in a pass of its
    own without a shuffle.
    """
    c = F.col
    items = word_hashes(benchmark.where("item_id is not null and text is not null").select("item_id", "text"), "item_id").where(F.size("h") > 0).distinct()
    items = stored(items.withColumns({"item": F.xxhash64("h"), "n_item": F.size("h"), "wide": F.least(F.size("h"), F.lit(STRETCH))}), "items")
    lengths = sorted(r.wide for r in items.select("wide").distinct().collect()) or [STRETCH]  # at most STRETCH rows
    each = [seeds(items.where(c("wide") == n), list(MASKS[n])) for n in lengths]
    of_items = stored(reduce(DataFrame.unionByName, each).select("item_id", "item", "n_item", c("pos").alias("item_pos"), "seed"), "item-seeds")
    blocks = -(-of_items.count() // MOST_BROADCAST)
    hashed = word_hashes(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    of_docs = seeds(hashed, sorted({m for n in lengths for m in MASKS[n]}))
    shift = c("pos") - c("item_pos")
    part = F.slice("h", F.greatest(shift, F.lit(0)) + 1, c("n_item") + F.least(shift, F.lit(0)))
    met = [of_docs.join(F.broadcast(of_items.where(F.pmod("seed", F.lit(blocks)) == k) if blocks > 1 else of_items), "seed") for k in range(max(blocks, 1))]
    found = reduce(DataFrame.unionByName, [m.select("doc_id", "item_id", "item", shift.alias("shift"), part.alias("part")) for m in met])
    return found.distinct(), items.select("item_id", "item", "h")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, best_share): verified overlaps, one row a pair of document and item.

    n_equal counts equal words along the best shift, best_share is the largest share of equal words in a stretch. Only
    the words under an item travel with a hit, so no text is shuffled.
    """
    c = F.col
    found, items = hits(docs, benchmark)
    laid = found.join(items, ["item_id", "item"])
    laid = laid.select("doc_id", "item_id", F.transform("h", lambda w, k: F.coalesce((k + F.least("shift", F.lit(0)) >= 0) & (F.get("part", k + F.least("shift", F.lit(0))) == w), F.lit(False)).cast("int")).alias("same"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    laid = laid.withColumn("wide", F.least(F.size("same"), F.lit(STRETCH)))
    starts = F.sequence(F.lit(1), F.size("same") - c("wide") + 1)
    laid = laid.withColumn("best", F.array_max(F.transform(starts, lambda s: total(F.slice("same", s, c("wide"))))) / c("wide"))
    kept = laid.where(c("best") >= F.when(c("wide") < EXACT_UNDER, 1.0).otherwise(SHARE)).select("doc_id", "item_id", total(c("same")).alias("n_equal"), "best")
    return kept.groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.round(F.max("best"), 6).alias("best_share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    leaked = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked")
    return docs.join(leaked, docs["doc_id"] == leaked["leaked_id"], "left_anti")
