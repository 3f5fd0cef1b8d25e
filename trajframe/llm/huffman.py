"""Token ids as canonical, length-limited Huffman blocks.

Texts are encoded where they lie, and their ids dealt by ranges of ``doc_id`` in ascending order. Ids are counted over
all documents, code lengths of at most 16 bits come from those counts by package-merge, and each block of whole documents is packed on its
own, with the bit offset of every 256th id. Blocks decode independently: all checkpoints advance together, one table
lookup an id.

A file set is a folder with three Parquet tables: ``codebook`` (id, n, bits), ``ranges`` (pid, start: ids before the
range over all documents) and ``blocks`` (pid, base: ids before the block in its range, n_ids, doc_ids, lens, offsets,
payload, crc32).

Nulls: null text is empty (only the end id); null doc_ids come first. Repeated ids are ordered by their text's hash.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.llm.common import PieceMemo, between_spaces, by_size, numbered, shared_dir, stored, tokenizer_path

MOST_BITS = 16
BLOCK_IDS = 262_144
CHECKPOINT = 256
#: Characters encoded in one call: the library's own results take hundreds of bytes a token while it lasts.
LIBRARY_CHARS = 200_000
#: Bytes of text encoded together: a part builds its memos' look-up tables anew, and repeats fewer pieces the longer it is.
PART_BYTES = 8_000_000
BLOCK_COLUMNS = ["pid", "base", "n_ids", "doc_ids", "lens", "offsets", "payload", "crc32"]

#: Characters with Unicode's White_Space property (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_WORD_THEN_MARKS = f"^(?P<a>{_LETTERS})(?P<b>{_MARKS})(?P<c>\n?)(?P<d>{_LETTERS[:-1]}*)(?P<e>{_MARKS})$"
_BEFORE_SPACE = f"[{WHITE}] "


def chunks(text: str) -> list[str]:
    """Cut a text where a byte-level BPE's own splitting never joins: before white space that follows something else.

    The usual text, in which no space follows white space, may as safely be cut at each space.
    """
    return _RUNS.findall(text)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}


class ByteBpe:
    """Ids of texts as Arrow lists, through worker memos of what lies between spaces and of the words within.

    Letters, marks and a newline after them are always split, so that a new mixture needs no new encoding. Words that
    the memos lack are encoded together, joined by spaces or newlines, which splitting keeps apart; the ids of these
    then tell the words apart again. Words get most of the room, for a word takes the library several times as long as
    a piece of known words takes here. A task has one core, so the library starts no threads of its own.
    """

    def __init__(self, name: str, kind: pa.DataType, ordinary: bool = False):
        """kind: type of an id; ordinary: special tokens' strings in a text are ordinary text."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer_path(name)), kind
        self.tokenizer.encode_special_tokens = ordinary
        names = self.tokenizer.get_vocab()
        first = np.array([x[:1] for x in sorted(names, key=names.get)])
        space, newline = (byte_letters()[ord(x)] for x in " \n")
        self.begins = {" ": first == space, "\n": np.arange(len(first)) == names[newline]}
        self.pieces = PieceMemo(self._after_space, pa.list_(kind), 8_000_000)
        self.words = PieceMemo(self._words, pa.list_(kind))
        self.chunks = PieceMemo(self._apart, pa.list_(kind), 4_000_000)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [np.empty(0, self.kind.to_pandas_dtype())], [np.empty(0, np.int64)]
        parts = np.flatnonzero(np.diff(np.cumsum([len(x) for x in texts]) // LIBRARY_CHARS)) + 1
        for k, to in pairwise([0, *parts, len(texts)]):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k:to], add_special_tokens=False)]
            size.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.fromiter(chain.from_iterable(found), ids[0].dtype, int(size[-1].sum())))
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(size)))

    def _lists(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, self.kind))

    def _apart(self, pieces: pa.Array) -> pa.Array:
        """Each piece by itself."""
        return self._lists(*self._library(pieces.to_pylist()))

    def _together(self, words: pa.Array, before: str) -> pa.Array:
        """Each word of letters alone with ``before`` in front of it; a newline's id is left out."""
        words = words.to_pylist()
        ids, _ = self._library([before + before.join(words[k : k + 1024]) for k in range(0, len(words), 1024)])
        starts = self.begins[before][ids]
        begin = np.append(np.flatnonzero(starts), len(ids))
        if len(begin) != len(words) + 1:
            raise ValueError("the vocabulary doesn't keep words apart")
        return self._lists(ids, begin) if before == " " else self._lists(ids[~starts], begin - np.arange(len(begin)))

    def _words(self, words: pa.Array) -> pa.Array:
        """Words with or without a space before them, marks, and newlines."""
        spaced = pc.match_substring_regex(words, f"^ {_LETTERS}$")
        bare = pc.match_substring_regex(words, f"^{_LETTERS}$")
        rest = pc.invert(pc.or_(spaced, bare))
        kinds = pa.array(np.select([x.to_numpy(zero_copy_only=False) for x in (spaced, bare)], [0, 1], 2))
        both = [self._together(pc.utf8_slice_codeunits(words.filter(spaced), 1), " "), self._together(words.filter(bare), "\n"), self._apart(words.filter(rest))]
        return pa.concat_arrays(both).take(in_turn(kinds))

    def _after_space(self, pieces: pa.Array) -> pa.Array:
        """Each piece with a space before it."""
        cut = pc.extract_regex(pieces, _WORD_THEN_MARKS)
        odd = pc.or_(pc.is_null(cut), pc.match_substring(pieces, "<|"))
        parts = [x.fill_null("") for x in cut.filter(pc.invert(odd)).flatten()]
        parts[0] = pc.binary_join_element_wise(pa.scalar(" "), parts[0], "")
        coded = pa.concat_arrays(parts).dictionary_encode()
        number = coded.indices.to_numpy().reshape(len(parts), -1).T
        there = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[number] if number.size else number.astype(bool)
        usual = self._gathered(self.words.lookup(coded.dictionary.filter(pc.not_equal(coded.dictionary, ""))), _without(coded.dictionary)[number[there]], np.append(0, np.cumsum(there.sum(axis=1))), None)
        return pa.concat_arrays([usual, self._apart(pc.binary_join_element_wise(pa.scalar(""), pieces.filter(odd), " "))]).take(in_turn(odd))

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> pa.Array:
        """A list of ids for each text, with ``end`` after them if given."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, _BEFORE_SPACE)
        usual = self._gathered(*self._usual(texts.filter(pc.invert(odd))), end)
        if not pc.any(odd).as_py():
            return usual
        pieces, number, begin = numbered(pa.array([chunks(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())))
        return pa.concat_arrays([usual, self._gathered(self.chunks.lookup(pieces), number, begin, end)]).take(in_turn(odd))

    def _usual(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each text's pieces as numbers of these, and where each text's begin."""
        pieces, number, begin = between_spaces(texts)
        heads, at = np.unique(number[begin[:-1]], return_inverse=True)  # a text's first piece has no space before it
        ids = pa.concat_arrays([self.pieces.lookup(pieces), self._apart(pieces.take(pa.array(heads)))])
        number = number.copy()
        number[begin[:-1]] = len(pieces) + at
        return ids, number, begin

    def _gathered(self, ids: pa.Array, number: np.ndarray, begin: np.ndarray, end: int | None) -> pa.Array:
        if end is not None:
            number, begin = np.insert(number, begin[1:], len(ids)), begin + np.arange(len(begin))
            ids = pa.concat_arrays([ids, pa.array([[end]], ids.type)])
        upto = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()[number]))
        return pa.ListArray.from_arrays(pa.array(upto[begin], pa.int32()), ids.take(pa.array(number)).flatten())


def _without(words: pa.Array, left_out: str = "") -> np.ndarray:
    """The numbers of ``words`` once ``left_out`` is gone from them."""
    return np.cumsum(pc.not_equal(words, left_out).to_numpy(zero_copy_only=False)) - 1


def in_turn(kind: pa.Array) -> pa.Array:
    """Where each row stands once rows are put together by kind (a flag or a small number)."""
    out = np.empty(len(kind), np.int64)
    out[np.argsort(kind.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(kind))
    return pa.array(out)


@cache
def byte_bpe(name: str, kind: pa.DataType, ordinary: bool = False) -> ByteBpe:
    """One for each worker and vocabulary, so that its memo serves all of the worker's tasks."""
    return ByteBpe(name, kind, ordinary)


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, h, ids): every text's ids and the end id, as little-endian 16-bit numbers; h orders texts of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pa.uint16())
        for batch in batches:
            for k, texts in by_size(batch.column(2), PART_BYTES):
                ids = bpe.encode(texts, end_id)
                flat = ids.flatten().to_numpy().astype("<u2", copy=False)
                offsets = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy())) * 2
                raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(texts)), batch.column(1).slice(k, len(texts)), raw], ["doc_id", "h", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, ids binary")


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n) over all rows' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(65_536, np.int64)
        for batch in batches:
            ids = batch.column(0)
            ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
            n += np.bincount(np.frombuffer(ids.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]), minlength=65_536)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, []
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        kinds.append(at < n)  # which entries of this merged list are leaves
        level = both[at]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(kinds):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Canonical codes by (length, id) for an array of lengths by id; 0 bits: no code."""
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    step = np.uint64(1) << (MOST_BITS - bits[order].astype(np.uint64))
    codes = np.zeros(len(bits), np.uint64)
    codes[order] = (np.cumsum(step) - step) >> (MOST_BITS - bits[order].astype(np.uint64))
    return codes


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids`` and the bit offset of every ``CHECKPOINT``-th."""
    size = bits[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = starts >> 5, (64 - (starts & 31) - size).astype(np.uint64)
    value = codes[ids] << shift
    words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::CHECKPOINT]


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the id whose code begins it, and that code's length."""
    codes, used = canonical_codes(bits), np.flatnonzero(bits)
    ids, lengths = np.zeros(1 << MOST_BITS, np.uint16), np.ones(1 << MOST_BITS, np.uint8)
    spare = MOST_BITS - bits[used].astype(np.int64)
    width = 1 << spare
    at = np.repeat(codes[used].astype(np.int64) << spare, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    ids[at], lengths[at] = np.repeat(used, width), np.repeat(bits[used], width)
    return ids, lengths


def unpack(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a block, all checkpoints decoded side by side."""
    ids, lengths = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at, last = offsets.astype(np.int64), (len(window) - 1) * 8
    out = np.empty((min(CHECKPOINT, n), len(at)), np.uint16)
    for k in range(len(out)):
        key = window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        out[k] = ids[key]
        at = np.minimum(at + lengths[key], last)
    return out.T.reshape(-1)[:n]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document and write the file set at ``path`` (vocabularies of up to 65,536 ids).

    Texts are encoded where they lie; only their ids, two bytes each, are dealt into ranges.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, vocabulary, end_id), "ids")
    found = id_counts(rows).orderBy("id").collect()  # at most one row an id of the vocabulary
    bits = np.zeros(65_536, np.uint8)
    if found:
        bits[[r.id for r in found]] = code_lengths(np.array([r.n for r in found]))
    spark.createDataFrame([(r.id, r.n, int(bits[r.id])) for r in found], "id int, n long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pid = canonical_codes(bits), TaskContext.get().partitionId()
        base, names, parts, size = 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal base, names, parts, size
            ids = np.frombuffer(b"".join(parts), "<u2")
            payload, offsets = pack(ids, bits, codes)
            lens = [len(p) // 2 for p in parts]
            row = [[pid], [base], [len(ids)], [names], [lens], [offsets.astype("<u4").tobytes()], [payload], [zlib.crc32(payload)]]
            base, names, parts, size = base + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], BLOCK_COLUMNS)

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                parts.append(ids.as_buffer().to_pybytes())
                size += len(parts[-1]) // 2
                if size >= block_ids:
                    yield close()
        if names:
            yield close()

    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    ranged.select("doc_id", "ids").mapInArrow(run, "pid int, base long, n_ids long, doc_ids array<long>, lens array<int>, offsets binary, payload binary, crc32 long").write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("pid").agg(F.sum("n_ids").alias("n")).orderBy("pid").collect()  # one row a range
    before = np.cumsum([0] + [r.n for r in totals]).tolist()
    spark.createDataFrame([(r.pid, n) for r, n in zip(totals, before, strict=False)], "pid int, start long").coalesce(1).write.parquet(f"{path}/ranges")


def _decoded(spark: SparkSession, path: str, per_document, kind: pa.DataType, schema: str) -> DataFrame:
    bits = np.zeros(65_536, np.uint8)
    for r in spark.read.parquet(f"{path}/codebook").collect():  # at most one row an id of the vocabulary
        bits[r.id] = r.bits
    before = dict(spark.read.parquet(f"{path}/ranges").collect())  # one row a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError(f"block {row['base']} of range {row['pid']} is damaged")
                start = before[row["pid"]] + row["base"]
                ids = unpack(row["payload"], np.frombuffer(row["offsets"], "<u4"), row["n_ids"], table).astype("<u4")
                at = 0
                out = []
                for name, n in zip(row["doc_ids"], row["lens"], strict=True):
                    out.append((name, start + at, n, per_document(ids[at : at + n])))
                    at += n
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], kind)], schema.replace(",", "").split(" ")[::2])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the file set."""
    return _decoded(spark, path, lambda ids: ids.astype(np.int32), pa.list_(pa.int32()), "doc_id long, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the file set."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.tobytes()), pa.int64(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write the file set to the shared folder and return the digests read back from it."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary, end_id)
    return token_digests(docs.sparkSession, path)
