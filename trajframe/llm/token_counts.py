"""Token counts of whole texts by a map-side two-tier lookup.

A text is cut at spaces into pre-tokens, which the vocabulary never joins (no piece has a word mark after another
character; :func:`splits_at_marks` verifies it for a vocabulary). First tier: lengths of frequent pre-tokens, broadcast
as one compact blob of at most ``TABLE_ENTRIES`` entries. Second tier: a bounded memo in each worker, which encodes
what it has not met. No pre-token is shuffled; only each task's few heavy hitters are, to build the table.

Nulls: null text counts as empty (no tokens). Repeated rows and ids give a row each. Empty table: empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import PieceMemo, between_spaces, by_size, numbered, tokenizer_path

TABLE_ENTRIES = 65_536
#: A task reports pre-tokens that make up at least one in so many of its own.
HEAVY_SHARE = 8192
MARK = "▁"


def splits_at_marks(processor) -> bool:
    """Whether no piece holds a word mark after another character, nor a newline, so that pre-tokens are independent."""
    return not any(re.search(f"[^{MARK}]{MARK}|\n", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


def pre_tokens(text: str) -> list[str]:
    """Pieces between spaces; of a run of spaces all but the last stay before the next piece (each stands for a mark)."""
    parts = text.replace(MARK, " ").split(" ") if text else []
    if "" not in parts:
        return parts
    out, run = [], 0
    for at, x in enumerate(parts):
        if x == "" and at < len(parts) - 1:
            run += 1
        else:
            out.append(" " * run + x)
            run = 0
    return out


class PieceLengths:
    """Lengths of pre-tokens under a SentencePiece vocabulary, worked out for those it has not met."""

    def __init__(self, name: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        if not splits_at_marks(self.sp):
            raise ValueError(f"{name}: pieces cross word marks, so counts by pre-token would be wrong")
        self.lines = PieceMemo(self._plain, pa.int64(), 12_000_000)
        self.whole = PieceMemo(self._by_line, pa.int64())

    def _plain(self, keys: pa.Array) -> pa.Array:
        """A key is a line start (mark before it) or, after a newline, a later line without a mark."""
        keys = keys.to_pylist()
        got = self.sp.encode(keys, num_threads=1)
        # The library gives nothing for an empty text, where inside a text the mark stands alone; "\n..." brings two pieces of its own.
        return pa.array([len(ids) - 2 if k[:1] == "\n" else max(len(ids), 1) for k, ids in zip(keys, got, strict=True)], pa.int64())

    def _by_line(self, pieces: pa.Array) -> pa.Array:
        cut = pc.split_pattern(pieces, "\n")
        size = pc.list_value_length(cut).to_numpy().astype(np.int64)
        begin = np.cumsum(size) - size
        later = np.ones(int(size.sum()), bool)
        later[begin] = False
        flat = cut.flatten()
        keys = pc.if_else(pa.array(later), pc.binary_join_element_wise(pa.scalar("\n"), flat, ""), flat).dictionary_encode()
        lengths = self.lines.lookup(keys.dictionary).to_numpy()[keys.indices.to_numpy()]
        return pa.array(np.add.reduceat(lengths, begin) + size - 1 if len(size) else lengths)

    def count(self, texts: list[str] | pa.Array) -> list[int]:
        """Texts with a run of spaces, a space at an end or a mark are cut one by one, all others in columns."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, f"^ |  | $|{MARK}|^$")
        out = np.zeros(len(texts), np.int64)
        for some, cut in ((pc.invert(odd), lambda x: between_spaces(x)), (odd, lambda x: numbered(pa.array([pre_tokens(t) for t in x.to_pylist()], pa.list_(pa.string()))))):
            pieces, number, begin = cut(texts.filter(some))
            upto = np.append(0, np.cumsum(self.whole.lookup(pieces).to_numpy()[number]))
            out[some.to_numpy(zero_copy_only=False)] = np.diff(upto[begin])
        return out.tolist()


_worker: dict[str, PieceLengths] = {}


def _lengths(name: str, table: Broadcast, key: str) -> PieceLengths:
    """This worker's memo for one run of the operator, begun with the broadcast table."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = PieceLengths(name)
        pieces, lengths = table.value
        if lengths:
            _worker[key].whole.seed(pa.array(pieces.split(MARK)), pa.array(lengths, pa.int64()))
    return _worker[key]


def heavy_hitters(docs: DataFrame) -> DataFrame:
    """(piece, n): pre-tokens frequent within a task, summed over all tasks; every task reports a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, floor = Counter(), 0, 0
        for batch in batches:
            for _, texts in by_size(batch.column(0)):
                # Runs of spaces are left to the second tier.
                pieces, number, _ = between_spaces(texts)
                total += len(number)
                seen.update(dict(zip(pieces.to_pylist(), np.bincount(number, minlength=len(pieces)).tolist(), strict=True)))
            if len(seen) > 500_000:  # lossy counting: what is rare so far cannot reach the share any more than by the floor
                floor += 1
                seen = Counter({k: n for k, n in seen.items() if n > floor})
        top = [(k, n) for k, n in seen.items() if n * HEAVY_SHARE >= total and len(k) <= 48 and MARK not in k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_table(docs: DataFrame, vocabulary: str) -> Broadcast:
    """The first tier: (pieces joined by marks, which none holds, and lengths) of the most frequent pre-tokens, at most ``TABLE_ENTRIES``."""
    top = [r.piece for r in heavy_hitters(docs).orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).select("piece").collect()]
    return docs.sparkSession.sparkContext.broadcast((MARK.join(top), PieceLengths(vocabulary)._by_line(pa.array(top)).to_pylist() if top else []))


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document, over its whole text."""
    table, key = frequent_table(docs, vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(vocabulary, table, key)
        for batch in batches:
            n = [x for _, texts in by_size(batch.column(2)) for x in lengths.count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
