"""Exact nearest neighbours of binary codes in Hamming distance, by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import modest_batches, partitions, stash, table

#: Codes in one shard of the index and queries in one block, about: what a task holds at once. Every query goes to every shard,
#: so shards are as large as memory allows. For more tasks a block has fewer queries, but LEAST_QUERIES, and if blocks are few
#: a shard fewer codes, but LEAST_CODES.
SHARD_CODES, BLOCK_QUERIES, LEAST_QUERIES, LEAST_CODES = 1 << 19, 1024, 128, 1 << 16
#: Codes that are compared, and probes that are looked up, at once.
MEETINGS = 1 << 21


def sign_codes(vectors: DataFrame, keep: int) -> DataFrame:
    """(code, vec_id) with one bit a dimension, set where the value is above 0; vectors of other than 64
    dimensions, null ones and rows without an id have no code. Of equal codes in a batch, the ``keep``
    smallest ids stay: no others can be among the nearest, as ties go to the smaller id."""

    def code(batches):
        for b in batches:
            ok = b["embedding"].map(lambda v: v is not None and len(v) == 64) & b["vec_id"].notna()
            b = b[ok]
            if not len(b):
                continue
            bits = np.nan_to_num(np.stack([np.asarray(v, dtype=np.float64) for v in b["embedding"]])) > 0
            codes = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
            out = pd.DataFrame({"code": codes, "vec_id": b["vec_id"].to_numpy(np.int64)}).drop_duplicates().sort_values(["code", "vec_id"])
            yield out[out.groupby("code").cumcount() < keep]

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInPandas(code, "code long, vec_id long")


class MultiIndex:
    """Tables of all segments of a set of distinct 64-bit codes; exact search by growing radii.

    After every segment has been probed with all radii up to r, each code within distance
    segments * (r + 1) - 1 has been met, for a code further in every segment is further in sum.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.astype(np.uint64)
        self.m = max(2, round(64 / max(8, min(16, np.log2(max(len(codes), 2))))))
        cuts = np.linspace(0, 64, self.m + 1).astype(int)
        self.parts = [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.tables = []
        for shift, width in self.parts:
            values = (self.codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            self.tables.append((np.argsort(values, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(values.astype(np.int64), minlength=1 << width))])))

    def _probe(self, queries: np.ndarray, masks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each segment's table, where the codes of each query and probe begin, and how many there are."""
        out = []
        for (shift, width), (_, starts), mask in zip(self.parts, self.tables, masks, strict=True):
            own = (queries >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            probe = (own[:, None] ^ mask[None, :]).astype(np.int64)
            first = starts[probe]
            out.append((first, starts[probe + 1] - first))
        return out

    def search(self, queries: np.ndarray, k: int, counts: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): all codes no further than the nearest that hold k ids in all; counts: ids of each code.
        Codes beyond a query's bound (a distance within which k ids are known to lie elsewhere) need not be found."""
        limit = np.full(len(queries), 65) if bounds is None else bounds.astype(np.int64)
        queries = queries.astype(np.uint64)
        active = np.arange(len(queries))
        kept = [np.zeros(0, np.int64)] * 3
        radius = 0
        while len(active):
            masks = [np.array([sum(1 << f for f in flips) for flips in combinations(range(width), radius)], np.uint64) for _, width in self.parts]
            step = max(1, MEETINGS // max(1, *map(len, masks)))
            for a in range(0, len(active), step):
                chunk = active[a : a + step]
                spans = self._probe(queries[chunk], masks)
                # as many queries at once as meet MEETINGS codes, or one
                met = np.cumsum(sum(n.sum(axis=1) for _, n in spans))
                cuts = np.flatnonzero(np.diff(met // MEETINGS, prepend=0)) if len(met) > 1 else []
                for lo, hi in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
                    if lo < hi:
                        kept = self._merge(queries, chunk[lo:hi], [(f[lo:hi], n[lo:hi]) for f, n in spans], kept, k, counts, limit)
            covered = self.m * (radius + 1) - 1
            active = active[(limit[active] > covered) & (covered < 64)]
            radius += 1
        return kept[0], kept[1], kept[2]

    def _merge(self, queries: np.ndarray, own: np.ndarray, spans: list, kept: list[np.ndarray], k: int, counts: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
        """``kept`` with what ascending queries ``own`` have met within their limits, which fall to the distance of their kth id."""
        a, b = np.searchsorted(kept[0], own[0]), np.searchsorted(kept[0], own[-1], side="right")
        at, found = [kept[0][a:b]], [kept[1][a:b]]
        for (first, n), (order, _) in zip(spans, self.tables, strict=True):
            q, n, first = np.repeat(own, n.shape[1])[n.ravel() > 0], n[n > 0], first[n > 0]
            q, c = np.repeat(q, n), order[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
            close = np.bitwise_count(queries[q] ^ self.codes[c]) <= limit[q]
            at.append(q[close])
            found.append(c[close])
        both = np.unique(np.concatenate(at) * len(self.codes) + np.concatenate(found))
        q, c = both // len(self.codes), both % len(self.codes)
        d = np.bitwise_count(queries[q] ^ self.codes[c]).astype(np.int64)
        order = np.lexsort((d, q))
        q, c, d = q[order], c[order], d[order]
        # the distance at which a query has met k ids is that of the code that brings them to k
        total = np.cumsum(counts[c])
        before = total - counts[c]
        before -= before[np.searchsorted(q, q)]
        kth = (before < k) & (before + counts[c] >= k)
        limit[q[kth]] = np.minimum(limit[q[kth]], d[kth])
        stay = d <= limit[q]
        return [np.concatenate([whole[:a], part[stay], whole[b:]]) for whole, part in zip(kept, (q, c, d), strict=True)]


_CODES = "part long, codes binary, ids binary, bounds binary"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of codes or block of queries as a row."""
    rows = rows.drop_duplicates()
    return pd.DataFrame({"part": [rows["part"].iloc[0]], **{name: [rows[column].to_numpy(np.int64).tobytes()] for name, column in (("codes", "code"), ("ids", "vec_id"), ("bounds", "bound"))}})


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query the k other rows nearest in Hamming distance of
    sign codes; ties go to the smaller id.

    ``vectors`` and ``queries`` have vec_id and embedding; other columns are not read. Every vector is in the index.
    Codes are dealt to shards by hash and queries to blocks. Each block is first answered by one shard, exactly, by
    multi-index hashing; the distance of its kth id then bounds the radii in all other shards, whose
    answers are merged. With fewer than k other rows, all are returned; vectors without a code are neither found nor
    answered; an id that is repeated with different vectors is found by each, at its least distance, and asked with each.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    index = sign_codes(vectors, k + 1)
    total = index.count()
    asked = sign_codes(queries, 1 << 62).distinct()
    number = asked.count()
    blocks = max(number // BLOCK_QUERIES + 1, min(partitions(spark), number // LEAST_QUERIES))
    shards = max(total // SHARD_CODES + 1, min(partitions(spark) // blocks, total // LEAST_CODES))
    shard = stash(index.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(shards))).withColumn("bound", F.lit(0)).groupBy("part").applyInPandas(_pack, _CODES), "shards")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def answer(batches):
        for b in batches:
            for codes, ids, q_codes, q_ids, q_bounds in zip(b["codes"], b["ids"], b["q_codes"], b["q_ids"], b["q_bounds"], strict=True):
                rows = pd.DataFrame({"code": np.frombuffer(codes, np.int64), "id": np.frombuffer(ids, np.int64)}).sort_values(["code", "id"])
                rows = rows[rows.groupby("code").cumcount() <= k]
                distinct, start, counts = np.unique(rows["code"].to_numpy(), return_index=True, return_counts=True)
                own, asks = np.frombuffer(q_ids, np.int64), np.frombuffer(q_codes, np.int64)
                some, back = np.unique(asks, return_inverse=True)
                bounds = np.zeros(len(some), np.int64)
                np.maximum.at(bounds, back, np.frombuffer(q_bounds, np.int64))
                q, c, d = MultiIndex(distinct.view(np.uint64)).search(some.view(np.uint64), k + 1, counts, bounds)
                n = counts[c]
                hits = pd.DataFrame({"q": np.repeat(q, n), "distance": np.repeat(d, n), "neighbor_id": rows["id"].to_numpy()[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[c], n)]})
                hits = hits.sort_values(["q", "distance", "neighbor_id"])
                hits = hits[hits.groupby("q").cumcount() <= k]
                hits = pd.DataFrame({"q": back, "code": asks, "query_id": own}).merge(hits, on="q")
                yield hits[["query_id", "code", "neighbor_id", "distance"]].astype("int64")

    def answered(block: DataFrame, home: bool) -> DataFrame:
        """The answers of each block's own shard, or of all others; a cell is a task's work."""
        own = F.col("block") % shards
        other = block.select(F.col("part").alias("block"), F.col("codes").alias("q_codes"), F.col("ids").alias("q_ids"), F.col("bounds").alias("q_bounds"))
        other = other.withColumn("shard", own) if home else other.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != own)
        cells = other.join(shard.select(F.col("part").alias("shard"), "codes", "ids"), "shard")
        count = blocks if home else blocks * (shards - 1)
        return cells.repartitionByRange(max(int(count), 1), "shard", "block").mapInPandas(answer, "query_id long, code long, neighbor_id long, distance long")

    far = F.lit(65).cast("long")
    first = stash(answered(asked.withColumn("bound", far).groupBy("part").applyInPandas(_pack, _CODES), True), "first")
    # k + 1 ids within a distance, the query's own among them, are enough
    kth = first.groupBy("query_id", "code").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") > k).select(F.col("query_id").alias("vec_id"), "code", "kth")
    bounded = asked.join(kth, ["vec_id", "code"], "left").select("part", "code", "vec_id", F.coalesce("kth", far).alias("bound"))
    near = first.unionByName(answered(bounded.groupBy("part").applyInPandas(_pack, _CODES), False)) if shards > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    best = near.where("query_id <> neighbor_id").groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 20, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 10)


OP3_SQL = """
with codes as (select vec_id, list_transform(embedding, lambda x: x > 0) as bits from embeddings where len(embedding) = 64),
pairs as (
  select q.vec_id as query_id, v.vec_id as neighbor_id,
    list_sum(list_transform(list_zip(q.bits, v.bits), lambda x: case when x[1] = x[2] then 0 else 1 end))::bigint as distance
  from codes q join codes v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from pairs)
select query_id, rank, neighbor_id, distance from ranked where rank <= 10
"""
