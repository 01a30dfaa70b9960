"""Importance resampling of documents towards a target text, by hashed n-grams whose CRCs come from a table of positions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, partitions, pieces, stash, table
from .shingles import LOWER, join_texts

BUCKETS, LONGEST = 10_000, 3
#: Distances from a span's end that the table covers; longer spans are folded block by block.
DEPTH = 64
#: Characters of texts cut at once, bytes of spans looked up at once, long spans folded at once.
PIECE, EXPANDED, FOLDED = 1 << 18, 1 << 16, 1 << 10
_ONES = np.uint32(0xFFFFFFFF)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _position_table(depth: int) -> np.ndarray:
    """What a byte at each distance from the end of a message adds to its CRC-32."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = (first >> np.uint32(1)) ^ np.where(first & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    rows = [first]
    while len(rows) < depth:
        rows.append((rows[-1] >> np.uint32(8)) ^ first[rows[-1] & np.uint32(255)])
    return np.stack(rows)


_TABLE = _position_table(DEPTH)
_FLAT = _TABLE.ravel()
#: CRC-32 of as many zero bytes: what the start value and the final inversion add to a message of that length.
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def _linear(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The XOR of the table's entries over the bytes of each span of 1 to DEPTH bytes."""
    size = size.astype(np.int32)
    stop = np.cumsum(size, dtype=np.int32)
    start = stop - size
    at = np.arange(stop[-1], dtype=np.int32)
    byte = data.take(at + np.repeat(begin - start, size))
    entry = np.repeat(stop - np.int32(1), size)
    entry -= at
    entry <<= 8
    entry |= byte
    return np.bitwise_xor.reduceat(_FLAT.take(entry), start)


def _folded(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of spans of any length: a first block that leaves whole ones of DEPTH bytes, and those in turn, each with the
    register so far moved on by DEPTH bytes."""
    head = (size - 1) % DEPTH + 1
    register = _linear(data, begin, head) ^ _LENGTH[head] ^ _ONES
    at, left, open_ = begin + head, size - head, np.arange(len(size))
    while len(open_ := open_[left[open_] > 0]):
        r = register[open_]
        moved = _TABLE[DEPTH - 1][r & np.uint32(255)]
        for k in (1, 2, 3):
            moved = moved ^ _TABLE[DEPTH - 1 - k][(r >> np.uint32(8 * k)) & np.uint32(255)]
        register[open_] = moved ^ _linear(data, at[open_], np.full(len(open_), DEPTH))
        at[open_] += DEPTH
        left[open_] -= DEPTH
    return register ^ _ONES


def span_crcs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``, all of them one byte long at least; spans may overlap."""
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero(size <= DEPTH)
    if len(short):
        cuts = np.searchsorted(np.cumsum(size[short]), np.arange(EXPANDED, size[short].sum() + EXPANDED, EXPANDED))
        for own in np.split(short, np.unique(cuts[:-1])):
            if len(own):
                out[own] = _linear(data, begin[own], size[own]) ^ _LENGTH[size[own]]
    long = np.flatnonzero(size > DEPTH)
    for k in range(0, len(long), FOLDED):
        own = long[k : k + FOLDED]
        out[own] = _folded(data, begin[own], size[own])
    return out


def features(texts: list, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The words of each text, and for each length of run up to ``longest`` the text and the bucket of every run."""
    data, starts = join_texts(texts)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    size = edge[1::2] - edge[0::2]
    text = np.searchsorted(starts, edge[0::2], side="right") - 1
    # all words again, with one space after each
    place = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[data[word]]

    def runs():
        for k in range(longest):
            first = np.flatnonzero(text[: len(text) - k] == text[k:]) if len(text) > k else np.zeros(0, np.int64)
            last = first + k
            yield text[first], (span_crcs(joined, place[first], place[last] + size[last] - place[first]) % np.uint32(buckets)).astype(np.int64)

    return np.bincount(text, minlength=len(texts)), runs()


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; each task adds up its own first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, size=PIECE):
            for _, bucket in features(batch["text"].tolist(), longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return docs.select(F.col("text").cast("string")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, s, t, gain) for every bucket: floor of 1000 times the log of how much likelier the target's smoothed share is."""
    spark = docs.sparkSession
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    both = stash(both.select("bucket", "s", "t"), "buckets")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda x: x.cast("double")
    ratio = d(F.col("t") + 1) * d(F.lit((total["s"] or 0) + buckets)) / (d(F.col("s") + 1) * d(F.lit((total["t"] or 0) + buckets)))
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))


def score_documents(docs: DataFrame, gains: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row. ``gains`` has as many rows as there are buckets."""
    gain = np.zeros(buckets, np.int64)
    for r in gains.select("bucket", "gain").collect():
        gain[r["bucket"]] = r["gain"]

    def weigh(batches):
        for batch in pieces(batches, size=PIECE):
            n = len(batch)
            words, runs = features(batch["text"].tolist(), longest, buckets)
            weight, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, bucket in runs:
                held, at = np.unique(text, return_index=True)
                if len(held):
                    weight[held] += np.add.reduceat(gain[bucket], at)
                count += np.bincount(text, minlength=n)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": words, "n_features": count, "weight": weight})

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    return found.withColumn("score", F.col("weight") + noise)


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place from 1 in ``order``: ranges are sorted on their own and start where those before end."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = stash(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect()}  # a row for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offsets = F.create_map(*[F.lit(x) for item in before.items() for x in item]) if before else F.lit(None).cast("map<bigint,bigint>")
    return dealt.withColumn("place", (F.element_at(offsets, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of the documents without replacement, likelier ones towards the target's distribution of features.

    ``docs`` has doc_id and text, ``target`` has text; other columns are not read. Features are runs of 1 to ``longest``
    words (ASCII letters and digits, and all characters beyond ASCII; only A-Z is lower-cased) joined by a space, with repeats;
    a feature's bucket is its CRC-32 modulo ``buckets``. Counts cover all texts of both tables. Returns for each row doc_id,
    n_words, n_features, weight (sum of its features' gains), score (weight plus a Gumbel term from seed and doc_id) and rank:
    1, 2, 3... for the floor(percent * N / 100) highest scores of the N documents with ``least_words`` words, else NULL.

    CRCs come from a table of what a byte adds at each distance from the end of its feature: the entries of a feature's bytes
    are XORed in one ``reduceat`` over all spans, with a constant for its length; features beyond DEPTH bytes are folded block
    by block. Ranks come from a range sort, without a task that sees all rows.

    Null and empty texts have no features, weight 0 and a score, but are never drawn. Ties of score go to the smaller doc_id.
    Rows without a doc_id draw their term from an empty id and come last among ties. Rows that repeat a doc_id are documents
    of their own, with ranks next to each other where their texts are equal. An empty target or table gives gains by smoothing.
    """
    modest_batches(docs.sparkSession)
    scored = stash(score_documents(docs, bucket_gains(docs, target, longest, buckets), longest, buckets, seed), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    # the file order tells rows of one doc_id apart, so that many of them don't meet in a range
    placed = _numbered(scored.where(able).withColumn("_row", F.monotonically_increasing_id()), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row"))
    ranked = placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of all documents, drawn towards the benchmark's texts."""
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
