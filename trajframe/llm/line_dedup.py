"""Line dedup by streaming first occurrences, in DataFrame operations only.

A text is cut at every newline. A line's key is the line without white space (0x20, 0x09-0x0D) at both ends and with A-Z
lower-cased. A key of at least ``LEAST`` code points that several documents hold loses all its lines except those of
the smallest doc_id holding it; a document that repeats its own line keeps the repeats.

Keys travel as 128-bit hashes with (doc_id, position), never as text. Hashes are dealt by equal ranges (a hash is
uniform, so the bounds are known and nothing has to be sampled for them), sorted within a range by hash, document and
position, and each hash's first row names the document that keeps the line. Only the rows of dropped lines go on: they
are packed to bitmaps of 32 lines a word, words without a dropped line are left out, and the bitmaps alone meet the
documents again.

A key held by a large share of all lines would fill one range. Such keys are counted on a sixteenth of the documents:
those above 1 / (4 x ranges) of the sampled lines are fewer than 4 x ranges, so their table is small by construction and
is broadcast. Their first documents come from a minimum with map-side combining over all lines, and their rows are
spread over all ranges. Which keys are called frequent changes no result.

Nulls: null and empty texts have one empty line and lose nothing. Rows without a doc_id count together as one document
after all others. Rows with equal doc_id are one document, each row with its own bitmap by its text; equal rows give
equal results. An empty table gives an empty result. Other columns stay or are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import stored

LEAST = 10
#: Lines in a word of a bitmap.
WORD = 32
FULL = (1 << WORD) - 1
#: One in so many documents is looked at to find frequent keys.
SAMPLED = 16
SPACES = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line as compared: stripped, A-Z lower-cased, all else as it is."""
    bare = F.btrim(line, F.lit(SPACES))
    # On ASCII lines lower() changes A-Z only, and is much faster than a mapping by code point.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _own(docs: DataFrame) -> DataFrame:
    """(doc, text, text_key): what identifies a row, under names of our own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def keyed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, text_key, at, h1, h2): every line whose key is long enough."""
    own = _own(docs).select("doc", "text_key", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    key = own.where(F.char_length("line") >= least).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return key.select("doc", "text_key", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent_firsts(docs: DataFrame, ranges: int, least: int = LEAST) -> DataFrame | None:
    """(f1, f2, first): frequent keys with the smallest document holding each; fewer than 4 x ``ranges`` rows, or None."""
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLED)) == 0)
    counts = stored(keyed_lines(some, least).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "line-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(total // (4 * ranges), 8)).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    if hot.isEmpty():
        return None
    held = keyed_lines(docs, least).join(F.broadcast(hot), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    return stored(held.groupBy("f1", "f2").agg(F.min("doc").alias("first")), "frequent-lines")


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, text_key, at): the lines that an earlier document holds."""
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, firsts = keyed_lines(docs, least), frequent_firsts(docs, ranges, least)
    by_hash = F.floor((F.shiftrightunsigned("h1", 32)) * ranges / F.lit(float(1 << 32))).cast("int")
    if firsts is None:
        rows = rows.withColumn("known", F.lit(False)).withColumn("part", by_hash)
    else:
        rows = rows.join(F.broadcast(firsts), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left").withColumn("known", F.col("f1").isNotNull())
        rows = rows.where(~F.col("known") | ~F.col("doc").eqNullSafe(F.col("first")))
        rows = rows.withColumn("part", F.when(F.col("known"), F.pmod(F.xxhash64("doc", "text_key", "at"), F.lit(ranges)).cast("int")).otherwise(by_hash))
    dealt = rows.select("part", "h1", "h2", "doc", "text_key", "at", "known").repartitionById(ranges, F.col("part"))
    stream = Window.partitionBy("part", "h1", "h2").orderBy(F.asc_nulls_last("doc"), "at").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("first_doc", F.first("doc").over(stream))
    return seen.where(F.col("known") | ~F.col("doc").eqNullSafe(F.col("first_doc"))).select("doc", "text_key", "at")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, text_key, keep): for rows that lose lines, the words of their bitmap that are not full, as (word, bits).

    Bit b of word w tells whether line 32 w + b stays; words left out are all ones.
    """
    lost = dropped_lines(docs, least).select("doc", "text_key", F.floor(F.col("at") / WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(WORD)).cast("int")).alias("bit"))
    words = lost.groupBy("doc", "text_key", "word").agg(F.bit_or("bit").alias("bits"))
    words = words.select("doc", "text_key", F.struct("word", F.col("bits").bitwiseXOR(F.lit(FULL)).alias("bits")).alias("w"))
    return words.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list("w")).alias("keep"))


def _kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; the text itself where there is none."""
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    out = F.flatten(F.transform(keep, lambda w: F.transform(F.filter(bits, lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * WORD + b)))
    lines = split_lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def with_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, keep): each row of ``docs`` as a struct with its bitmap, null where nothing is lost."""
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_doc"), text_key.alias("own_key"))
    return rows.join(keep_bitmaps(docs, least), F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_key") == F.col("text_key")), "left").select("row", "keep")


def drop_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the text that is left of each; no row goes, a null text without losses stays null."""
    rows, text = with_bitmaps(docs, least), F.col("row.text")
    left = F.when(F.col("keep").isNull(), text).otherwise(_kept_text(text, F.col("keep")))
    return rows.select(*[(left if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, keep_words): what a row had, lost and keeps; keep_words is word:bits of its bitmap."""
    rows, text, keep = with_bitmaps(docs.select("doc_id", "text"), least), F.col("row.text"), F.col("keep")
    gone = F.aggregate(keep, F.lit(0).cast("long"), lambda n, w: n + WORD - F.bit_count(w["bits"]))
    words = F.array_join(F.transform(keep, lambda w: F.concat_ws(":", w["word"], w["bits"])), ",")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(split_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(text, keep).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(words, F.lit("")).alias("keep_words"),
    )
