"""Documents that hold benchmark items: SimHash of item-sized windows, multi-index blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, pieces, table
from .shingles import shingle_hashes, word_hashes

#: Shingles of items that a pass over the documents holds in each task; more items make more passes.
PASS_SHINGLES = 1_000_000
#: Hamming radius of the fingerprints and the bytes that index them: a pair within the radius has a byte
#: within RADIUS // 8. A window at similarity 0.8 is 9.7 bits away on average, with a deviation of 2.9.
RADIUS, BLOCKS = 24, 8


def simhash(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of shingle hashes; a shingle weighs as often as it occurs."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    starts = np.cumsum(lengths) - lengths
    return np.packbits(np.add.reduceat(bits, starts, axis=0) > 0, axis=1).view(np.uint64).ravel()


class HammingBlocks:
    """Fingerprints by each of their bytes; finds every one within RADIUS, and some beyond it."""

    def __init__(self, prints: np.ndarray) -> None:
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BLOCKS
        self.prints = prints
        self.tables = []
        for byte in prints.view(np.uint8).reshape(-1, BLOCKS).T:
            order = np.argsort(byte, kind="stable")
            bounds = np.searchsorted(byte[order], np.arange(257))
            self.tables.append([order[np.concatenate([np.arange(bounds[v], bounds[v + 1]) for v in np.flatnonzero(near[x])])] for x in range(256)])

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within RADIUS."""
        n = max(len(self.prints), 1)
        pairs = []
        for table, byte in zip(self.tables, queries.view(np.uint8).reshape(-1, BLOCKS).T, strict=True):
            for value in np.unique(byte):
                own, found = np.flatnonzero(byte == value), table[value]
                pairs.append((own[:, None] * n + found[None, :]).ravel())
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        q, p = both // n, both % n
        close = np.bitwise_count(queries[q] ^ self.prints[p]) <= RADIUS
        return q[close], p[close]


class Items:
    """Benchmark items as shingles, fingerprints and an index of both."""

    def __init__(self, ids: np.ndarray, texts: list[str], words: int) -> None:
        hashes, _, _, counts, _ = word_hashes(texts)
        keep = counts > 0
        self.ids, self.sizes, self.words = ids[keep], counts[keep], words
        shingles, item = shingle_hashes(hashes, counts, words)
        item = (np.cumsum(keep) - 1)[item]
        lengths = np.bincount(item, minlength=len(self.ids))
        first = np.cumsum(lengths) - lengths
        self.weights = [np.unique(shingles[a : a + n], return_counts=True) for a, n in zip(first, lengths, strict=True)]
        offset = np.arange(len(shingles)) - first[item]
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.item, self.offset = shingles[order], item[order], offset[order]
        self.blocks = HammingBlocks(simhash(shingles, lengths))

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's: sums of least and of greatest counts."""
        own, n = self.weights[item]
        values, m = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        least = np.minimum(n[at], m)[own[at] == values].sum()
        return least / (n.sum() + m.sum() - least)


def _windows(items: Items, shingles: np.ndarray, counts: np.ndarray, doc: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first shingle, shingles) of every item-sized window that has a shingle of an item at the item's own place."""
    lo, hi = np.searchsorted(items.shingles, shingles), np.searchsorted(items.shingles, shingles, side="right")
    n = hi - lo
    hit = np.repeat(np.arange(len(shingles)), n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    d = doc[hit]
    first = spans[d]
    size = np.maximum(items.sizes[items.item[entry]] - items.words + 1, 1)
    limit = first + np.bincount(doc, minlength=len(counts))[d]
    start = np.maximum(hit - items.offset[entry], first)
    start = np.maximum(np.minimum(start, limit - size), first)
    length = np.minimum(size, limit - start)
    found = np.unique(np.stack([d, start, length], axis=1), axis=0) if len(d) else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def _leaks(batches: Iterator[pd.DataFrame], items: Items, similarity: float) -> Iterator[pd.DataFrame]:
    for b in pieces(batches, size=1 << 20):
        hashes, _, _, counts, _ = word_hashes(b["text"].tolist())
        shingles, doc = shingle_hashes(hashes, counts, items.words)
        spans = np.searchsorted(doc, np.arange(len(b)))
        d, start, length = _windows(items, shingles, counts, doc, spans)
        rows = []
        for a in range(0, len(d), 4096):
            s, n = start[a : a + 4096], length[a : a + 4096]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
            for q, p in zip(*items.blocks.within(simhash(shingles[inside], n)), strict=True):
                like = items.similarity(p, shingles[s[q] : s[q] + n[q]])
                if like >= similarity - 1e-12:
                    k = d[a + q]
                    rows.append((b["doc_id"].iloc[k], items.ids[p], s[q] - spans[k], min(counts[k], n[q] + items.words - 1), like))
        if rows:
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start_word", "n_words", "similarity"])
            # of the windows of a document that match an item, those that overlap a better one are the same leak
            out = out.sort_values(["doc_id", "item_id", "similarity", "start_word"], ascending=[True, True, False, True], kind="stable")
            kept, taken = [], {}
            for i, r in enumerate(out.itertuples(index=False)):
                others = taken.setdefault((r.doc_id, r.item_id), [])
                if all(r.start_word >= e or r.start_word + r.n_words <= s for s, e in others):
                    others.append((r.start_word, r.start_word + r.n_words))
                    kept.append(i)
            yield out.iloc[kept]


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): item-sized windows of documents that match benchmark items.

    Texts are words between white space with A-Z in lower case. Where a document and an item share a shingle of
    ``words`` words (without one no window reaches any similarity above 0), the window of the item's size that puts the
    shingle at the item's own place gets a 64-bit SimHash; eight byte blocks find all items within RADIUS bits; the weighted Jaccard similarity of
    shingle counts then decides exactly. Items come in passes of at most PASS_SHINGLES shingles, so a
    task's memory does not grow with the benchmark; a pass reads the documents once and shuffles nothing.
    A window at the document's end may be shorter than its item. Null or empty texts and rows without
    an id match nothing; an item or document with fewer words than ``words`` is one shingle; repeated rows give repeated
    results; long texts are read whole; columns besides the named ones are not read; empty tables give none.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stated = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna()
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    found = spark.createDataFrame([], schema)
    ids, texts, weight = [], [], 0

    def search(ids, texts):
        items = Items(np.array(ids, np.int64), texts, words)
        return rows.mapInPandas(lambda b: _leaks(b, items, similarity), schema) if len(items.ids) else spark.createDataFrame([], schema)

    for item in stated.orderBy("item_id").toLocalIterator():
        ids.append(item["item_id"])
        texts.append(item["text"])
        weight += len(item["text"]) // 4 + 1
        if weight >= PASS_SHINGLES:
            found, ids, texts, weight = found.unionByName(search(ids, texts)), [], [], 0
    return found.unionByName(search(ids, texts)) if ids else found


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, five-word shingles at 0.8."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 0.8)
