"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a new local one where it is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch between Spark and Python while a table is stored; both sides hold whole batches.
ARROW_ROWS = 2_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    While it is written, Arrow batches have at most ``ARROW_ROWS`` rows; the session's setting is put back afterwards.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; resolved where it is called, so that each executor uses its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(col: str | Column) -> Column:
    """UTF-8 bytes of a text column, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


class PieceMemo:
    """A worker's memo from pieces of text to values, in Arrow columns.

    ``encode`` maps a string array of distinct pieces to an array of values. Columns take a few bytes an entry more than
    the text itself, and are looked up by one vectorised join a call. Keys and values together are held to
    ``most_bytes``: beyond it only what the last call used stays, and nothing if even that is too much, so memory is
    bounded whatever the texts hold. Results never depend on the memo.
    """

    def __init__(self, encode: Callable[[pa.Array], pa.Array], kind: pa.DataType, most_bytes: int = 16_000_000):
        self.encode, self.most_bytes = encode, most_bytes
        self.keys, self.values = pa.array([], pa.string()), pa.array([], kind)

    def seed(self, keys: pa.Array, values: pa.Array) -> None:
        self.keys, self.values = keys, values

    def lookup(self, pieces: pa.Array) -> pa.Array:
        """The value of each of the distinct ``pieces``."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.keys), -1).to_numpy().copy()
        new = at < 0
        if new.any():
            fresh = pieces.filter(pa.array(new))
            at[new] = len(self.keys) + np.arange(len(fresh))
            self.keys, self.values = pa.concat_arrays([self.keys, fresh]), pa.concat_arrays([self.values, self.encode(fresh)])
        out = self.values.take(pa.array(at))
        if self.keys.nbytes + self.values.nbytes > self.most_bytes:
            keep = len(pieces) if pieces.nbytes + out.nbytes <= self.most_bytes // 2 else 0
            self.keys, self.values = pieces.slice(0, keep), out.slice(0, keep)
        return out


def by_size(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) of a column of texts or bytes in parts of about ``most_bytes``, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + most_bytes, side="right")), at + 1)
        yield at, column.slice(at, to - at)
        at = to
        pa.default_memory_pool().release_unused()  # a worker is reused by other stages


def between_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces between single spaces, each text's pieces as numbers of these, and where each text's begin."""
    return numbered(pc.split_pattern(texts, " "))


def numbered(cut: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lists of pieces as (distinct pieces, the number of each piece in order, where each list begins)."""
    flat = cut.flatten().dictionary_encode()
    begin = np.cumsum(np.append(0, pc.list_value_length(cut).to_numpy(zero_copy_only=False)))
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), begin
