"""Text quality: random-indexing word vectors pooled per document and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, modest_batches, pieces, table
from .shingles import join_texts, mix64, word_hashes

#: Buckets of words and of word shapes, and the dimensions of their vectors.
WORDS, SHAPES, DIMS = 1024, 1200, 64
#: Labelled documents at most that the network is fitted on: those with the smallest hash of their id.
FIT_ROWS = 12_000


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Of every text, each word's bucket followed by its shape's; and how many such tokens each text has."""
    hashes, begin, size, counts, _ = word_hashes(texts)
    if not len(hashes):
        return np.zeros(0, np.int64), counts * 2
    data, _ = join_texts(texts)
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int16), begin)
    digit = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int16), begin)
    sign = (data > 32) & (data < 127) & ~((data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122))
    signs = np.add.reduceat(sign.astype(np.int16), begin)
    last = data[begin + size - 1]
    kind = np.select([(last == 46) | (last == 44), last == 33, last == 124, sign[begin + size - 1]], [1, 2, 3, 4], 0)
    again = np.zeros(len(hashes), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = np.minimum(upper, 2).astype(np.int64)
    for value, base in ((np.minimum(signs, 3), 4), (kind, 5), (digit > 0, 2), (np.searchsorted([2, 4, 7, 11], size, side="right"), 5), (again, 2)):
        shape = shape * base + value
    tokens = np.empty(2 * len(hashes), np.int64)
    tokens[0::2] = (mix64(hashes) >> np.uint64(40)) % np.uint64(WORDS)
    tokens[1::2] = WORDS + shape
    return tokens, counts * 2


def index_vectors() -> np.ndarray:
    """The fixed sparse vector of each bucket: eight of its dimensions are +1 or -1."""
    random = np.random.default_rng(3)
    out = np.zeros((WORDS + SHAPES, DIMS), np.float32)
    for row in out:
        row[random.choice(DIMS, 8, replace=False)] = random.choice([-1, 1], 8)
    return out


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the index vectors of the two tokens on each side, for all tokens of a partition."""
    n = WORDS + SHAPES
    pairs, single = np.zeros(n * n, np.int32), np.zeros(n, np.int64)
    for b in pieces(batches, size=1 << 20):
        tokens, counts = _tokens(b["text"].tolist())
        doc = np.repeat(np.arange(len(counts)), counts)
        single += np.bincount(tokens, minlength=n)
        for step in (1, 2):
            inside = doc[step:] == doc[:-step]
            np.add(pairs, np.bincount((tokens[:-step] * n + tokens[step:])[inside], minlength=n * n), out=pairs, casting="unsafe")
    both = pairs.reshape(n, n).astype(np.float32)
    index = index_vectors()
    sums = both @ index + both.T @ index
    from pyspark import TaskContext

    # 64 groups at most for any number of partitions
    yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 64], "sums": [sums.astype(np.float64).tobytes()], "counts": [single.tobytes()]})


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    sums, counts = 0, 0
    for s, c in zip(rows["sums"], rows["counts"], strict=True):
        sums, counts = sums + np.frombuffer(s, np.float64), counts + np.frombuffer(c, np.int64)
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "sums": [sums.tobytes()], "counts": [counts.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of each bucket over all texts, centred and of unit length; of one fixed size for any corpus."""
    schema = "part long, sums binary, counts binary"
    parts = docs.select("text").mapInPandas(_contexts, schema).groupBy("part").applyInPandas(_add, schema).toLocalIterator()
    sums, counts = np.zeros((WORDS + SHAPES) * DIMS), np.zeros(WORDS + SHAPES, np.int64)
    for row in parts:
        sums, counts = sums + np.frombuffer(row["sums"], np.float64), counts + np.frombuffer(row["counts"], np.int64)
    mean = sums.reshape(-1, DIMS) / np.maximum(counts, 1)[:, None]
    centre = (mean * counts[:, None]).sum(axis=0) / max(counts.sum(), 1)
    out = np.where(counts[:, None] > 0, mean - centre, 0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of a text's words and of its shapes, the spread of its shapes, and its length."""
    tokens, counts = _tokens(texts)
    out = np.zeros((len(texts), 3 * DIMS + 1), np.float32)
    ends = np.cumsum(counts)
    for k, (e, n) in enumerate(zip(ends, counts, strict=True)):
        if n:
            own = tokens[e - n : e]
            shapes = vectors[own[1::2]]
            out[k, :DIMS] = vectors[own[0::2]].mean(axis=0)
            out[k, DIMS : 2 * DIMS] = shapes.mean(axis=0)
            out[k, 2 * DIMS : -1] = shapes.std(axis=0)
            out[k, -1] = np.log1p(n)
    return out


class Network:
    """Two layers with a sigmoid at the end, fitted by Adam, and a temperature fitted on rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 30) -> None:
        random = np.random.default_rng(5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        aside = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
        fit = np.flatnonzero(~aside)
        self.w = [random.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), random.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        first, second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        step = 0
        for _ in range(epochs):
            order = random.permutation(fit)
            for a in range(0, len(order), 128):
                k = order[a : a + 128]
                h = np.tanh(x[k] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[k]) / len(k)
                back = error[:, None] * self.w[2] * (1 - h * h)
                slopes = [x[k].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ error + 1e-4 * self.w[2], np.array([error.sum()])]
                step += 1
                for v, g, m, s in zip(self.w, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.003 * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if aside.any():
            z, t = self._logits(x[aside]), y[aside]
            losses = [(np.logaddexp(0, z / k) - t * z / k).mean() for k in np.geomspace(0.3, 5, 60)]
            self.temperature = float(np.geomspace(0.3, 5, 60)[int(np.argmin(losses))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out; they have the smallest hash of their id."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted: how likely each text is of quality 1.

    Word buckets get random-indexing vectors from all texts; a document is the mean of those of its
    words and word shapes. The network learns from at most ``fit_rows`` labelled documents whose crc32
    of the id is not divisible by 5, and reads nothing but texts. Null and empty texts are scored as a
    text without words; a row without an id is scored and not held out; without any label the score is
    0.5; a label that is given twice counts as its largest. Columns named held_out, score or predicted are replaced.
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    vectors = word_vectors(docs)

    def features(batches):
        for b in pieces(batches, size=1 << 20):
            yield pd.DataFrame({"x": [v.tobytes() for v in pooled(b["text"].tolist(), vectors)], "label": b["label"]})

    known = labelled(docs, labels, "quality", fit_rows).select("text", "label").mapInPandas(features, "x binary, label int").toPandas()
    net = None
    if len(known):
        known = known.sort_values(["x", "label"])
        net = Network(np.stack([np.frombuffer(v, np.float32) for v in known["x"]]).astype(np.float64), known["label"].to_numpy(np.float64))

    schema = T.StructType([*docs.schema.fields, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        for b in pieces(batches, size=1 << 20):
            yield b.assign(score=net.predict(pooled(b["text"].tolist(), vectors)) if net else 0.5)

    marked = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return marked.mapInPandas(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a network fitted on labels.quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).drop("text")
