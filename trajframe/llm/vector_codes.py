"""Vector code compression: four integer codebooks by dual-tree Lloyd rounds.

A component x becomes floor(1024 x); a vector is cut into four equal parts, each coded by the nearest of (at most) 256
entries of its position's codebook. Spark deals the vectors; a task keeps them in blocks, each block a balanced tree
over its parts (bounding box, count and sum of every node, laid out once and stored). A round meets each block's tree
with a tree over the codebook's entries: squared distances between node boxes bound all distances between what lies in
them, so combinations that cannot hold a nearest entry are pruned; where one entry is left for a node, the node's cached
sum and count are added to it without a look at its parts; leaves that stay uncertain compare their parts with the
entries left, in integers. Bounds are integers too and prune only what is strictly farther, so ties go to the lower
index exactly as in a full comparison.

A task hands on one partial sum per entry it met; Spark adds them, and only the codebooks themselves (4 x 256 entries)
pass through the driver.

Rows are dropped whose vector is null, holds a null, NaN or infinite component, or differs in length from the vector of
the smallest kept vec_id, or whose length is no positive multiple of four. Components of 2^90 or more in magnitude after
scaling are beyond exact sums and dropped as well. Distances that no 64-bit number holds are worked out with Python
integers; an error that no long holds is null. Null vec_ids come after all others; repeated rows count once each. Other
columns are ignored. An empty table, or one without kept rows, gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors in a block, and parts in a leaf of its tree.
BLOCK = 4096
LEAF = 16
_LARGEST = 2.0**90


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), as 64-bit numbers where these hold them and as Python integers elsewhere."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object)


def _room(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays in a type in which their squared distances are exact."""
    largest = max((max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b) if x.size), default=0)
    kind = np.int64 if (2 * largest) ** 2 * max(a.shape[-1], 1) < 1 << 62 else object
    return a.astype(kind), b.astype(kind)


def _levels(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / leaf)))


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: halves of halves of n items."""
    return (n * np.arange((1 << level) + 1, dtype=np.int64)) >> level


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the items in which every node of every level is a run: split at the median of the widest axis."""
    order = np.arange(len(points))
    for level in range(_levels(len(points), leaf)):
        at = _bounds(len(points), level)
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
    return order


class Tree:
    """Boxes, counts and sums of all nodes by level, over items in tree order; the last level's nodes are the leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.depth = points, _levels(len(points), leaf)
        self.at = [_bounds(len(points), level) for level in range(self.depth + 1)]
        begin = self.at[-1][:-1]
        low, high, total = [np.minimum.reduceat(points, begin)], [np.maximum.reduceat(points, begin)], [np.add.reduceat(points, begin)]
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
        self.low, self.high, self.total = low[::-1], high[::-1], total[::-1]


def _box_distances(a: Tree, la: int, ia: np.ndarray, b: Tree, lb: int, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest squared distance between boxes of two trees."""
    below, above = b.low[lb][ib] - a.high[la][ia], a.low[la][ia] - b.high[lb][ib]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(b.high[lb][ib] - a.low[la][ia], a.high[la][ia] - b.low[lb][ib])
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def assign(parts: Tree, entries: Tree, index: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(entry of each part in tree order, whole nodes as (level, node, entry)).

    ``index`` gives the codebook's index of each entry in the entries' tree order. Leaves of the entries' tree are single
    entries.
    """
    codes, whole, kind = np.full(len(parts.points), -1, np.int64), [], parts.points.dtype
    lp = le = 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        near, far = _box_distances(parts, lp, p, entries, le, e)
        least = np.full(len(parts.low[lp]), far.max(), kind)
        np.minimum.at(least, p, far)
        keep = near <= least[p]
        p, e = p[keep], e[keep]
        if le == entries.depth:
            alone = np.bincount(p, minlength=len(least))[p] == 1
            for node, entry in zip(p[alone].tolist(), index[e[alone]].tolist(), strict=True):
                codes[parts.at[lp][node] : parts.at[lp][node + 1]] = entry
                whole.append((lp, node, entry))
            p, e = p[~alone], e[~alone]
        deeper_p, deeper_e = lp < parts.depth, le < entries.depth
        if not len(p) or not (deeper_p or deeper_e):
            break
        for deeper, which in ((deeper_p, 0), (deeper_e, 1)):
            if deeper:
                own, other = (p, e) if which == 0 else (e, p)
                own, other = np.concatenate([2 * own, 2 * own + 1]), np.concatenate([other, other])
                p, e = (own, other) if which == 0 else (other, own)
        lp, le = lp + deeper_p, le + deeper_e
    if len(p):  # uncertain leaves
        by = np.lexsort((index[e], p))
        p, e = p[by], e[by]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for node, left in zip(p[np.append(0, cuts)].tolist(), np.split(e, cuts), strict=True):
            a, b = parts.at[lp][node], parts.at[lp][node + 1]
            own, choice = parts.points[a:b], entries.points[left]
            # |e|^2 - 2 p.e orders entries as the squared distance does; the first least is the lowest index.
            codes[a:b] = index[left][np.argmin((choice * choice).sum(axis=1) - 2 * (own @ choice.T), axis=1)]
    return codes, whole


def _entry_tree(book: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree whose leaves are single entries; the last one is repeated up to a power of two, which changes no nearest entry."""
    book_index = np.minimum(np.arange(1 << _levels(len(book), 1)), len(book) - 1)
    order = book_index[tree_order(book[book_index], 1)]
    return Tree(book[order], 1), order


def _pack(x: np.ndarray) -> bytes:
    """Integers as bytes: 32 or 64 bits each, or decimal text."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel())).encode()
    small = not x.size or max(-int(x.min()), int(x.max())) < 1 << 31
    return (b"i" + x.astype(np.int32).tobytes()) if small else (b"l" + x.astype(np.int64).tobytes())


def _unpack(b: bytes, n: int) -> np.ndarray:
    flat = np.array([int(v) for v in b[1:].split(b",")], object) if b[:1] == b"t" else np.frombuffer(b[1:], np.int32 if b[:1] == b"i" else np.int64).astype(np.int64)
    return flat.reshape(n, -1)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles): the rows that are coded."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < _LARGEST))
    own = own.where(F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = own.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    return own.where(F.size("embedding") == (first[0] if first else 0))


def blocks(kept: DataFrame) -> DataFrame:
    """(n, vec_ids, labels, orders, parts): vectors in blocks, each position's parts as integers in tree order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                own = batch.slice(at, BLOCK)
                n = len(own)
                whole = integers(own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
                orders, packed = [], []
                for part in np.split(whole, PARTS, axis=1):
                    order = tree_order(part, LEAF)
                    orders.append(order.astype(np.int32).tobytes())
                    packed.append(_pack(part[order]))
                yield pa.RecordBatch.from_pydict({"n": [n], "vec_ids": [own.column(0).to_pylist()], "labels": [own.column(1).to_pylist()], "orders": [orders], "parts": [packed]}, schema=kind)

    label = kept.schema["label"].dataType.simpleString()
    form = f"n int, vec_ids array<long>, labels array<{label}>, orders array<binary>, parts array<binary>"
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pa.schema([("n", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(kept.schema["label"].dataType))), ("orders", pa.list_(pa.binary())), ("parts", pa.list_(pa.binary()))])
    return kept.mapInArrow(run, form)


def _each_part(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], column: str = "parts"):
    """(batch, row, position, tree over the row's parts, entries' tree, its order): every block's four trees in turn."""
    trees = [_entry_tree(b) for b in books]
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index(column))
        for row in range(len(batch)):
            n = batch.column(0)[row].as_py()
            for position in range(PARTS):
                points, entries = _unpack(parts[row][position].as_py(), n), trees[position]
                points, book = _room(points, entries[0].points)
                same = book.dtype == entries[0].points.dtype
                yield batch, row, position, Tree(points, LEAF), (entries[0] if same else Tree(book, 1)), entries[1]


def partial_sums(stored_blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, total): what each task adds to every entry, added up by Spark."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS, ENTRIES, width), object)
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        for _, _, position, tree, entries, index in _each_part(batches, books):
            codes, whole = assign(tree, entries, index)
            own = np.zeros((ENTRIES, width), tree.points.dtype)
            taken = np.zeros(len(codes), bool)
            for level, node, entry in whole:
                own[entry] += tree.total[level][node]
                taken[tree.at[level][node] : tree.at[level][node + 1]] = True
            np.add.at(own, codes[~taken], tree.points[~taken])
            totals[position] += own
            counts[position] += np.bincount(codes, minlength=ENTRIES)
        part, entry = np.nonzero(counts)
        if len(part):
            sums = pa.array([[Decimal(int(v)) for v in row] for row in totals[part, entry]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), sums], ["part", "entry", "n", "total"])

    rows = stored_blocks.select("n", "parts").mapInArrow(run, "part int, entry int, n long, total array<decimal(38,0)>")
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]).cast("decimal(38,0)") for i in range(width)]).alias("total"))


def first_books(kept: DataFrame) -> list[np.ndarray]:
    """The parts of the smallest kept vec_ids, by position."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    return np.split(integers(np.array([r.embedding for r in rows], np.float64)), PARTS, axis=1) if rows else []


def next_books(books: list[np.ndarray], stored_blocks: DataFrame) -> list[np.ndarray]:
    """One round: every used entry becomes the floor of its parts' mean, unused ones stay."""
    out = [b.astype(object) for b in books]
    for r in partial_sums(stored_blocks, books).collect():  # 4 x 256 rows at most
        out[r.part][r.entry] = [int(v) // r.n for v in r.total]
    fits = lambda b: max(abs(int(v)) for v in b.ravel()) < 1 << 62
    return [b.astype(np.int64) if fits(b) else b for b in out]


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def coded(stored_blocks: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """(vec_id, label, code, error) under finished codebooks."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(stored_blocks.schema["labels"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = error = None
        for batch, row, position, tree, entries, index in _each_part(batches, books):
            n = len(tree.points)
            if position == 0:
                codes, error = np.zeros((n, PARTS), np.int64), np.zeros(n, object)
            order = np.frombuffer(batch.column(3)[row][position].as_py(), np.int32)
            got, _ = assign(tree, entries, index)
            place = np.empty(len(index), np.int64)
            place[index] = np.arange(len(index))  # the entry's place in the tree's order
            off = tree.points - entries.points[place[got]]
            codes[order, position] = got
            error[order] += (off * off).sum(axis=1).astype(object)
            if position == PARTS - 1:
                text = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
                fit = [int(x) if int(x) < 1 << 63 else None for x in error]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(1)[row].as_py(), pa.int64()), pa.array(batch.column(2)[row].as_py(), kind), pa.array(text, pa.string()), pa.array(fit, pa.int64())], ["vec_id", "label", "code", "error"])

    return stored_blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def train_and_code(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks) of all kept vectors."""
    kept = kept_vectors(vectors)
    label = kept.schema["label"].dataType.simpleString()
    books = first_books(kept)
    if not books:
        return kept.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), []
    laid = stored(blocks(kept), "vector-blocks")
    for _ in range(rounds):
        books = next_books(books, laid)
    return coded(laid, books, label), books


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes, their errors, and errors summed by label."""
    out, books = train_and_code(vectors)
    out = stored(out, "vector-codes")
    # A sum with an error that no long holds, or that itself outgrows one, is null.
    total = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    sums = out.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
