"""Where intermediate tables go, and over how many tasks large ones are dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a task of :func:`bounded`.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors see: under ``spark.checkpoint.dir``.

    Where that is unset, a local folder in local mode (as in tests); elsewhere an error, as executors would write to
    disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trajframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read back: its lineage is cut, a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df`` dealt by ``key`` over so many tasks that each has about ``TASK_ROWS`` of its ``rows``, however many these are.

    Sorts, windows and groups by ``key`` after it keep these tasks; a fixed number of them would hold ever more rows each.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *key)
