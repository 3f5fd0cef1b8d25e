"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within three bits of each other differ in at most one bit of one of their 32-bit halves. Every
distinct fingerprint therefore emits, for each half, all variants within half the radius (one bit), and pairs whose
variant meets another fingerprint's half are verified on all 64 bits. Before that, full-word variants within one bit
link everything at distance two or less through the smallest fingerprint of each variant: a variant has at most 65
members, so no group's size is squared, and the half-word stage only has to find links between different groups.

Emitting full-word variants alone would need 2,081 rows a fingerprint for radius three; halves need 65 + 66.

Nulls: null text counts as empty. Texts without words have fingerprint zero, linked like any other. Rows with equal
``doc_id`` are kept, each with its own fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import stored, utf8

HASH_SEED = 42
#: Half-word keys with more fingerprints are split further.
HOT_KEY = 256


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as a signed number."""
    import xxhash

    words = text.lower().split()  # on bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), HASH_SEED)]
    else:
        hashes = [digest(b" ".join(x), HASH_SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return majority_bits(np.array(hashes, np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(x.as_buffer().to_pybytes(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flips(width: int) -> list[int]:
    """The masks that flip no bit or one bit of ``width``, as signed longs."""
    return [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(width)]


def _variants(fp: str, width: int):
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(width)])
    return F.transform(masks, lambda m: F.col(fp).bitwiseXOR(m))


def star_links(fps: DataFrame) -> DataFrame:
    """(a, b): each fingerprint with the smallest that shares a full-word variant within one bit (distance at most two)."""
    from pyspark.sql import Window

    balls = fps.select("fp", F.explode(_variants("fp", 64)).alias("variant"))
    bucket = Window.partitionBy("variant")  # at most 65 distinct fingerprints each
    met = balls.select("fp", F.min("fp").over(bucket).alias("low"))
    return met.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def cross_links(labels: DataFrame) -> DataFrame:
    """(a, b): pairs at distance three or less whose labels differ, found by half-word variants.

    ``labels`` is (fp, label). One row per pair of labels is kept, which is all that merging needs.
    """
    half = lambda part: F.shiftrightunsigned("fp", 32) if part else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), half(p).alias("half")) for p in (0, 1)]))
    exact = labels.select(F.col("fp").alias("fp2"), F.col("label").alias("label2"), both.alias("h")).select("fp2", "label2", F.col("h.part").alias("part"), F.col("h.half").alias("key"))
    ball = labels.select("fp", "label", both.alias("h")).select("fp", "label", F.col("h.part").alias("part"), F.explode(_variants("h.half", 32)).alias("key"))
    # Halves that many fingerprints share are split by what the other half has: within three bits of each other, one of
    # its two quarters differs in at most one bit.
    hot = stored(exact.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("part", "key"), "hot-halves")
    quarter = lambda fp, q: F.when(F.col("part") == 0, F.shiftrightunsigned(fp, 32 + 16 * q)).otherwise(F.shiftrightunsigned(fp, 16 * q)).bitwiseAND(F.lit(0xFFFF))
    quarters = lambda fp: F.explode(F.array(*[F.struct(F.lit(q).alias("at"), quarter(fp, q).alias("bits")) for q in (0, 1)])).alias("q")
    close = (F.col("label") > F.col("label2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 3)
    cold = lambda side: side.join(hot, ["part", "key"], "left_anti")
    split = lambda side, fp: side.join(hot, ["part", "key"], "left_semi").select("*", quarters(fp))
    few = cold(ball).join(cold(exact).hint("merge"), ["part", "key"]).where(close)
    near = split(ball, "fp").select("fp", "label", "part", "key", F.col("q.at").alias("at"), F.explode(_variants("q.bits", 16)).alias("bits"))
    many = near.join(split(exact, "fp2").select("fp2", "label2", "part", "key", F.col("q.at").alias("at"), F.col("q.bits").alias("bits")).hint("merge"), ["part", "key", "at", "bits"]).where(close)
    return few.select(F.col("label").alias("a"), F.col("label2").alias("b")).union(many.select("label", "label2")).distinct()


def smallest_reachable(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(fp, label): the smallest node reachable over ``links`` (a, b), by alternating large-star and small-star rounds.

    Each round hooks a node's larger neighbours to its smallest and shortens chains, so rounds grow with the logarithm
    of the longest chain. Links are cut from their lineage by a written table each round.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            break
        before = seen
        ends = now.union(now.select("b", "a"))
        low = ends.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = ends.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
        now = stored(small.select("x.a", "x.b").where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    root = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select("fp").join(root, F.col("fp") == F.col("a"), "left").select("fp", F.coalesce("root", "fp").alias("label"))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their group in ``groups`` (doc_id, component_id), with all their columns."""
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.where("doc_id is null"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document: its group under links of three bits or fewer."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    labels = stored(smallest_reachable(least, star_links(least)), "stars")
    merged = smallest_reachable(labels.select(F.col("label").alias("fp")).distinct(), cross_links(labels))
    groups = labels.join(merged.select(F.col("fp").alias("label"), F.col("label").alias("group")), "label").join(least, "fp")
    component = groups.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    # A fingerprint's own row count never meets in one task: the join is on distinct fingerprints, split by AQE where skewed.
    per_fp = groups.join(component, "group").select("fp", "component_id")
    return fps.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents that are the smallest ``doc_id`` of their group; all columns stay.

    Rows that repeat both doc_id and text count once; rows without a doc_id stay as they are.
    """
    groups = near_duplicate_groups(docs.where("doc_id is not null"), shingle)
    return first_of_groups(docs, groups)
