"""Near copies: SimHash ball hashing and min-hash bands find candidates, exact Jaccard similarity of word shingles decides.

Two texts are linked where at least ``NUM / DEN`` of their distinct five-word shingles are shared, and one document of
each group of linked texts stays. Candidates are texts whose SimHashes of five-word shingles meet by :mod:`simhash`'s
balls. At a similarity of 0.8, though, 64-bit SimHashes differ in ten bits on average, and balls that wide would make
nearly all pairs candidates; so texts that agree on the five minima of one of ``BANDS`` bands of min-hashes are
candidates too. A pair just at 0.8 misses all bands with a probability of 7 in 100,000, a
closer one more rarely. Every candidate is then verified on whole shingle sets, natively.

As in :mod:`simhash`, texts are first linked with one centre of each band's bucket, the one whose buckets are largest.
Sets whose buckets still hold several groups are then met by prefix filtering: pairs that share one of the rarest
shingles of each, as alike sets must, and whose sizes and remaining shingles leave a similarity of 0.8 possible, are
compared one by one. These bounds are exact, so no link between such sets is lost, and they leave few pairs of a large
group of near copies.

Nulls: null text counts as empty, and empty texts are copies of each other. Texts of up to five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import by_size, stored, utf8
from trajframe.llm.simhash import HASH_SEED, first_of_groups, majority_bits, smallest_reachable, star_links

SHINGLE, NUM, DEN = 5, 4, 5
BANDS, ROWS = 24, 5

c = F.col


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    parts = zip(*(words[k:] for k in range(SHINGLE)), strict=False) if len(words) > SHINGLE else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), HASH_SEED) for x in parts), np.uint64))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(23)
    return tuple(g.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1) for _ in range(2))


def bands(found: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A key for each band, as signed numbers: the hash of the band's minima."""
    import xxhash

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, ((found[at : at + 1024] ^ mixers[0]) * mixers[1]).min(axis=1))
    raw = low.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[k * ROWS * 8 : (k + 1) * ROWS * 8], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _set_id(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sim, bands): what names the shingle set of every text, its SimHash, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers()
        for batch in batches:
            for k, part in by_size(batch.column(1)):
                fps, sims, keys = [], [], []
                for x in part:
                    found = shingles(x.as_buffer().to_pybytes())
                    fps.append(_set_id(found))
                    sims.append(majority_bits(found))
                    keys.append(bands(found, mixers))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "sim", "bands"])

    return docs.select(c("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long, sim long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, found): the shingle set of each ``wanted`` (fp, first_doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in by_size(batch.column(1), 1_000_000):  # sets are larger than texts
                sets = [shingles(x.as_buffer().to_pybytes()) for x in part]
                ids = pa.array([_set_id(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), ids, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["want", "fp", "found"])

    texts = docs.select("doc_id", utf8("text").alias("text")).join(wanted.select(c("fp").alias("want"), "first_doc"), c("doc_id") == c("first_doc"))
    return texts.select("want", "text").mapInArrow(run, "want long, fp long, found array<long>").where("want = fp").select("fp", "found").dropDuplicates(["fp"])


def sets_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(fp, found): the stored shingle sets of the ``wanted`` (fp); ``sets`` is (fp, first_doc)."""
    return stored(shingle_sets(docs, sets.select("fp", "first_doc").join(wanted.select("fp").distinct(), "fp")), name)


def verified(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that share enough shingles of the sets ``found`` (fp, found)."""
    both = pairs.join(found.select(c("fp").alias("a"), c("found").alias("of_a")), "a").join(found.select(c("fp").alias("b"), c("found").alias("of_b")), "b")
    shared = both.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return shared.where(DEN * c("shared") >= NUM * (c("n") - c("shared"))).select("a", "b")


def centres(keys: DataFrame) -> DataFrame:
    """(key, centre): of each bucket the set whose buckets are largest together, as a common original's are."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(sizes.hint("merge"), "key").select("key", "fp", "n"), "shared-keys")
    weight = shared.groupBy("fp").agg(F.sum("n").alias("weight"))
    return shared.join(weight.hint("merge"), "fp").groupBy("key").agg(F.max(F.struct("weight", "fp")).alias("c")).select("key", c("c.fp").alias("centre"))


def contested(found: DataFrame, live: DataFrame) -> DataFrame:
    """(fp, label, n, m, prefix) of the ``live`` (fp, label) sets that may still be alike with one of another label.

    n is a set's size and m how many of its shingles sets of other labels have too, which bounds what it can share with
    any of them: those with m below 0.8 n are alike with none. ``prefix`` are the m - 0.8 n + 1 of these shingles that
    the fewest live sets have: a set alike with this one cannot miss them all.
    """
    each = stored(found.join(live.select("fp", "label"), "fp").select("fp", "label", F.size("found").alias("n"), F.explode("found").alias("x")), "shingles-apart")
    both = each.groupBy("x").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("df")).where("low < high").select("x", "df")
    of = each.join(both.hint("merge"), "x").groupBy("fp", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("x"))
    of = of.withColumn("m", F.size("x")).where(DEN * c("m") >= NUM * c("n"))
    return of.select("fp", "label", "n", "m", F.slice("x.x", F.lit(1), c("m") - F.ceil(NUM * c("n") / DEN).cast("int") + 1).alias("prefix"))


def possible_pairs(live: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``live`` sets (fp, label, n, m, prefix) of different labels that may be alike, each once.

    Alike sets share at least 4/9 of their sizes' sum, so the rarest shingle they share is within the prefix of the
    larger and within the first m - 8/9 n + 1 of the smaller, and no more can follow it than both have left. Copies of
    one text with changes of their own therefore meet only if they have changes in common; all that meet are kept.
    """
    rows = live.select("fp", "label", "n", "m", F.posexplode("prefix").alias("i", "x"))
    small = rows.where((NUM + DEN) * (c("m") - c("i")) >= 2 * NUM * c("n"))
    large = rows.select("x", *[c(x).alias(f"{x}2") for x in ("fp", "label", "n", "m", "i")])
    smaller = (c("n") < c("n2")) | ((c("n") == c("n2")) & (c("fp") < c("fp2")))
    left = F.least(c("m") - c("i"), c("m2") - c("i2"))
    may = smaller & (c("label") != c("label2")) & ((NUM + DEN) * left >= NUM * (c("n") + c("n2")))
    met = small.join(large.hint("merge"), "x").where(may)
    return met.select(F.greatest("fp", "fp2").alias("a"), F.least("fp", "fp2").alias("b")).distinct()


def ball_candidates(sets: DataFrame) -> DataFrame:
    """(a, b), a > b: sets (fp, sim) with one SimHash, or whose SimHashes meet in a ball, through one set for each SimHash."""
    least = stored(sets.groupBy("sim").agg(F.min("fp").alias("low")), "sims")
    same = sets.join(least, "sim").where("fp > low").select(c("fp").alias("a"), c("low").alias("b"))
    met = star_links(least.select(c("sim").alias("fp")))
    of = lambda end: least.select(c("sim").alias(end), c("low").alias(f"low_{end}"))
    near = met.join(of("a"), "a").join(of("b"), "b").select(F.greatest("low_a", "low_b").alias("a"), F.least("low_a", "low_b").alias("b"))
    return same.union(near)


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every document: the smallest doc_id of its group."""
    marks = stored(signatures(docs), "signatures")
    sets = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "sets")
    keys = stored(sets.select("fp", F.posexplode("bands").alias("at", "key")), "band-keys")
    middle = stored(centres(keys), "centres")
    banded = keys.join(middle.hint("merge"), "key").where("fp <> centre").select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b"))
    stars = stored(banded.union(ball_candidates(sets)).distinct(), "stars")
    ends = stars.select(c("a").alias("fp")).union(stars.select("b"))
    labels = stored(smallest_reachable(sets, verified(sets_of(docs, sets, ends, "star-sets"), stars)), "star-labels")
    labelled = keys.join(labels.hint("merge"), "fp")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    live = stored(labelled.join(mixed.hint("merge"), "key", "left_semi").select("fp", "label").distinct(), "apart")
    found = sets_of(docs, sets, live, "apart-sets")
    links = verified(found, stored(possible_pairs(stored(contested(found, live), "live")), "possible-pairs"))
    of = lambda end: labels.select(c("fp").alias(end), c("label").alias(f"label_{end}"))
    links = links.join(of("a"), "a").join(of("b"), "b").select(c("label_a").alias("a"), c("label_b").alias("b")).distinct()
    merged = smallest_reachable(labels.select(c("label").alias("fp")).distinct(), links)
    groups = labels.join(merged.select(c("fp").alias("label"), c("label").alias("group")), "label").join(sets.select("fp", "first_doc"), "fp")
    component = groups.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    return marks.select("doc_id", "fp").join(groups.join(component, "group").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest ``doc_id`` of their group; all columns stay.

    Rows that repeat both doc_id and text count once; rows without a doc_id stay as they are.
    """
    groups = near_copy_groups(docs.where("doc_id is not null"))
    return first_of_groups(docs, groups)
