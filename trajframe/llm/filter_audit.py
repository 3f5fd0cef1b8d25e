"""Filter interaction audit: what five quality filters remove, for every order in which they could be applied.

A document's failures are a mask of five bits. Which filter removes it depends on the order only through the letters
up to the first one it fails. In lexicographic order the permutations with a common beginning have neighbouring Lehmer
ranks, so a mask's removal at a step covers whole intervals of ranks: its count is added where an interval begins and
taken off where it ends, and a prefix sum over the 120 ranks gives every order's removals at once.

Spark counts masks by part (with map-side combining: no part, however large, meets in one task); a part's 32 masks are
one row, and the ranks are worked out from that row. Texts are digested where they lie; only a 128-bit hash, the id, the
part and the mask of a document are shuffled.

Nulls: null text is empty, null source the empty string, a row without a doc_id is neither copied from nor a copy (it
never fails E) and has no label. Rows with equal doc_id are counted each; equal texts under one id do not fail E. A
document with several label rows is good (toxic) if one of them says so; null labels say nothing. An empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import by_size, stored, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Texts of more bytes are walked word by word instead of being cut at once.
LONG = 1_000_000
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mask_of(text: bytes) -> int:
    """Bits 0 to 3 are set where filters A to D fail on a UTF-8 text; bytes split at 0x20 and 0x09-0x0D only."""
    if len(text) <= LONG:
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    code_points = len(text.translate(None, _CONTINUED))
    upper = len(text.translate(None, _NOT_UPPER))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * upper > 5 * code_points) << 2 | (_MARKS.search(text) is not None) << 3


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h1, h2): filters A to D and a 128-bit hash of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at, texts in by_size(batch.column(2)):
                masks, hashes = [], []
                for x in texts:
                    text = x.as_buffer().to_pybytes()
                    masks.append(mask_of(text))
                    hashes.append(xxhash.xxh128_digest(text))
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(masks, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "part", "mask", "h1", "h2"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), utf8("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, part string, mask int, h1 long, h2 long")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters they fail, E included."""
    rows = stored(digests(docs), "filter-digests")
    copied = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(copied.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "first-copies")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Copies of one text meet its first document by a join of two shuffled tables, which Spark splits where a text has very many.
    rows = rows.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left").select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    rows = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_intervals() -> np.ndarray:
    """Rows (mask, step, letter, begin, end): ranks from begin to end (exclusive) in which a mask is removed at a step.

    A beginning of k letters that ends with the mask's first failure covers the (5 - k)! ranks that share it.
    """
    n, out = len(FILTERS), []
    for mask in range(1, 1 << n):
        passed = [i for i in range(n) if not mask >> i & 1]
        for k in range(len(passed) + 1):
            for before in itertools.permutations(passed, k):
                for last in (i for i in range(n) if mask >> i & 1):
                    head = (*before, last)
                    begin = sum(sum(y < x and y not in head[:i] for y in range(n)) * factorial(n - 1 - i) for i, x in enumerate(head))
                    out.append((mask, k, last, begin, begin + factorial(n - 1 - k)))
    return np.array(out, np.int64)


def removals(counts: np.ndarray) -> np.ndarray:
    """Removed documents by (rank, step, measure) from counts by (mask, measure)."""
    mask, step, _, begin, end = removal_intervals().T
    ends = np.zeros((len(ORDERS) + 1, len(FILTERS), counts.shape[1]), np.int64)
    np.add.at(ends, (begin, step), counts[mask])
    np.subtract.at(ends, (end, step), counts[mask])
    return ends.cumsum(axis=0)[:-1]


def audit_part(counts: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of one part, by rank and step, from its documents (n, good, toxic) by mask."""
    letters = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    masks = np.arange(len(counts))
    fails = np.array([counts[masks >> i & 1 == 1, 0].sum() for i in range(len(FILTERS))])
    gone = removals(counts)
    removed = gone[:, :, 0]
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, letters, removed)
    return {
        "kept": counts[:, 0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": fails[letters] - removed,
        "unique_fails": counts[1 << letters, 0],
        "good_lost": gone[:, :, 1],
        "toxic_lost": gone[:, :, 2],
        "shapley": shapley[letters],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module."""
    cell = lambda m, c: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    flat = F.array(*[cell(m, c) for m in range(1 << len(FILTERS)) for c in ("n", "good", "toxic")])
    parts = mask_counts(docs, labels).groupBy("part").agg(flat.alias("counts"))
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = audit_part(np.array(counts.as_py(), np.int64).reshape(-1, 3))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(orders), pa.array(steps), *[pa.array(got[c].ravel()) for c in columns]], ["part", "filter_order", "step", *columns])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))
