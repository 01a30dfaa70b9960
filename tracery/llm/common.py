"""What the corpus operators share: tables, shared storage and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast at most; each is a few dozen bytes. Larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers BATCH_BYTES at a time, unless the session has a limit of its own: 10,000 whole
    texts at once would take much of an executor's memory, on both sides."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and all
    run on one machine. On a cluster an unset folder is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tracery-")
        shared_dir.own = found
    return found


_STASHED: list[str] = []


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _STASHED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stashes(spark: SparkSession) -> int:
    """Delete what this process has stashed so far, and say how many folders. Results that were not written yet need them."""
    n = len(_STASHED)
    while _STASHED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STASHED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stashed frame for broadcast if it has at most ``rows`` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches, column: str = "text", size: int = 8 << 20):
    """Cut batches of rows so that each holds about ``size`` characters of ``column``, and one row at least."""
    for batch in batches:
        ends = batch[column].map(lambda t: len(t) if t is not None else 0).cumsum().to_numpy()
        start = 0
        while start < len(batch):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.iloc[start:stop].reset_index(drop=True)
            start = stop
        del batch, ends
    free_memory()


def free_memory() -> None:
    """Give a worker's unused memory back to the system, as it lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows never train a model."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the undirected links (a, b); root is the smallest id that can be reached.

    Hash-to-min: each round every id takes the smallest label among itself and its neighbours, then the
    label's own label. Labels are stored in the shared folder after each round; a hub's links are
    combined before they are shuffled. Null ends are dropped; no links give no rows.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct()
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        own = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("jump"))
        # hooking: the old root takes the smallest label that any of its members has seen
        hook = own.where("root < old").groupBy(F.col("old").alias("id")).agg(F.min("root").alias("hook"))
        new = own.join(up, "root", "left").join(hook, "id", "left").select("id", "old", F.least("root", "jump", "hook").alias("root"))
        new = stash(new, "labels")
        moved = new.where("root < old").limit(1).count()
        labels = new.select("id", "root")
        if not moved:
            return labels
