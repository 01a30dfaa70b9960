"""Removal of lines that an earlier document has: sorted streams of line hashes and bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, modest_batches, partitions, stash, table

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Hash, document and position of every line that is long enough to be a duplicate."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), lines.alias("lines"))
    rows = rows.select("doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode_outer("lines").alias("pos", "line"))  # the inner form would split all texts once more, to leave out empty lists
    rows = rows.withColumn("line", F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER)).where(F.char_length("line") >= min_chars)
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "version", "n_lines", "pos")


_SEEN = "kind int, h1 long, h2 long, doc_id long, version long, n_lines int, pos int"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted range: kind 0 are repeats; 1 the lines of the range's first hash that only an earlier range
    could repeat; 2 the range's last hash with its smallest document."""
    head = last = None
    for b in batches:
        h1, h2, doc = b["h1"].to_numpy(), b["h2"].to_numpy(), b["doc_id"].to_numpy()
        if not len(h1):
            continue
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))].copy()
        if last is not None and (h1[0], h2[0]) == last[:2]:
            first[: np.argmax(new[1:]) + 1 if new[1:].any() else len(doc)] = last[2]
        if head is None:
            head = (h1[0], h2[0])
        last = (h1[-1], h2[-1], first[-1])
        kind = np.where(doc > first, 0, np.where((h1 == head[0]) & (h2 == head[1]), 1, -1))
        b = b.assign(kind=kind)[kind >= 0]
        if len(b):
            yield b[["kind", "h1", "h2", "doc_id", "version", "n_lines", "pos"]]
    if last is not None:
        yield pd.DataFrame({"kind": [2], "h1": [last[0]], "h2": [last[1]], "doc_id": [last[2]], "version": [0], "n_lines": [0], "pos": [0]})


def pack_bits(n: int, dropped) -> bytes:
    """A compressed bitmap of n lines: 1 keeps, 0 drops."""
    keep = np.ones(n, np.uint8)
    keep[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(n: int, bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([pack_bits(n, d) for n, d in zip(n_lines, dropped, strict=True)])


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, keep) for each document that loses lines; keep is a compressed bitmap.

    A line's key is the line without white space at its ends and with A-Z in lower case. A key of at
    least ``min_chars`` code points loses all its lines except those of the smallest doc_id that has it.
    Line hashes (128 bits) are range-partitioned by hash and document and sorted by hash, document and
    position, so a line that a third of all documents share is spread over ranges; each range streams
    and passes on what it can't decide alone, which is at most one document's lines. ``version`` is a
    hash of the text: rows that repeat a doc_id are one document to each other and keep their lines.
    Rows without a doc_id neither drop lines nor lose any. An empty table gives no rows.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    lines = _lines(docs, min_chars)
    ranged = lines.repartitionByRange(max(partitions(spark), 1), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "version", "pos")
    seen = stash(ranged.mapInPandas(_stream, _SEEN), "lines")
    # as many rows as ranges at most
    tails = F.broadcast(seen.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")))
    later = seen.where("kind = 1").join(tails, ["h1", "h2"]).where("first < doc_id").select("doc_id", "version", "n_lines", "pos")
    repeats = seen.where("kind = 0").select("doc_id", "version", "n_lines", "pos").unionByName(later)
    marks = repeats.groupBy("doc_id", "version", "n_lines").agg(F.collect_set("pos").alias("dropped"))
    return marks.select("doc_id", "version", "n_lines", F.size("dropped").alias("n_dropped"), _bitmap("n_lines", "dropped").alias("keep"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the text that the bitmaps keep, and with n_lines and n_dropped; a null text is one empty line.

    Columns of ``docs`` named n_lines or n_dropped are replaced. Bitmaps are broadcast only if they are few.
    """
    modest_batches(docs.sparkSession)
    bitmaps = stash(bitmaps, "bitmaps")
    size = bitmaps.agg(F.count("*"), F.sum(F.octet_length("keep"))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 100 * BROADCAST_ROWS:
        bitmaps = F.broadcast(bitmaps)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("keep").alias("_keep"))
    joined = docs.select(*columns).join(marks, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left").drop("_id", "_version")
    schema = T.StructType([f for f in docs.schema if f.name in columns] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches):
        for b in batches:
            texts, total, gone = [], [], []
            for text, keep in zip(b["text"], b["_keep"], strict=True):
                text = text or ""
                n = text.count("\n") + 1
                lost = 0
                if keep is not None:
                    bits = unpack_bits(n, keep)
                    lost = n - int(bits.sum())
                    text = "\n".join(x for x, k in zip(text.split("\n"), bits, strict=True) if k)
                texts.append(text)
                total.append(n)
                gone.append(lost)
            yield b.drop(columns="_keep").assign(text=texts, n_lines=total, n_dropped=gone)

    return joined.mapInPandas(cut, schema)




def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least ten code points, over all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    cut = drop_lines(docs, line_bitmaps(docs, 10))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
firsts as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (
  select k.*, coalesce(f.first_doc < k.doc_id, false) as dropped from keyed k left join firsts f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""
