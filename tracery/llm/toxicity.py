"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, modest_batches, pieces, table
from .quality import labelled

#: Labelled documents at most that the machine is fitted on: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: Landmarks at most, how alike two of them may be, and words that they are chosen from at most.
LANDMARKS, APART, CANDIDATES = 96, 0.75, 5_000
#: Written forms of each landmark, with one or two letters put in, that the machine learns as well.
VARIANTS = 6
#: Weight of a subsequence of three characters for each character that it skips, and how many it may skip.
DECAY, SKIPS = 0.6, 3
#: Words less alike to every landmark than this add nothing to a sentence.
FLOOR = 0.3
#: Decisions on a word above which it counts, in steps.
STEPS = np.array([0.0, 0.1, 0.2, 0.4, 0.6, 0.8])
#: Words that a worker remembers, and characters of a word that are compared at once.
CACHE_WORDS, WIDTH = 500_000, 24

_BASE = 40
#: Characters written for letters that they resemble.
_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_SIGNS = ".,;:!?\"'()[]|"
_ENDS = frozenset(".!?")
_OTHER = re.compile(r"[\W_]+")
_PAIR = re.compile(r"\b\w[\s.*_-]\w\b")
_SPELLED = re.compile(r"(?:(?<=\s)|^)(?:\w[\s.*_-]+){2,}\w(?=\W|$)")
_CODES = np.zeros(1 << 16, np.int64)
_CODES[1:] = 27 + np.arange(1, 1 << 16) % 10
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[2], _CODES[3] = 37, 38


def plain(word: str) -> str:
    """A lower-case word without signs; characters that stand for letters inside it are replaced by those."""
    inner = word.strip(_SIGNS)
    return inner if inner.isalpha() else _OTHER.sub("", inner.translate(_ALIKE))


def _parts(word: str) -> list[str]:
    word = f"\2{word}\3"
    return [word] if len(word) <= WIDTH else [word[a : a + WIDTH] for a in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def _matrix(words: list[str], width: int = WIDTH) -> np.ndarray:
    raw = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "replace")
    return _CODES[np.frombuffer(raw, "<u4").reshape(-1, width) & 0xFFFF]


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of all subsequences of three characters that skip at most SKIPS, and their weight; 0 where there is none."""
    for a in range(1, SKIPS + 2):
        for b in range(1, SKIPS + 3 - a):
            third = codes[:, a + b :]
            n = third.shape[1]
            yield np.where(third > 0, (codes[:, :n] * _BASE + codes[:, a : a + n]) * _BASE + third, 0), DECAY ** (a + b - 2)


def _sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of unit length per word."""
    codes = _matrix(words)
    found = [(c, np.full(c.shape, w)) for c, w in _triples(codes)]
    code, weight = (np.concatenate([f[k] for f in found], axis=1) for k in (0, 1))
    row, col = np.nonzero(code)
    key = row * _BASE**3 + code[row, col]
    values, back = np.unique(key, return_inverse=True)
    sums = np.bincount(back, weights=weight[row, col], minlength=len(values))
    row = values // _BASE**3
    norm = np.sqrt(np.bincount(row, weights=sums * sums, minlength=len(words)))
    return row, values % _BASE**3, sums / norm[row]


class Kernel:
    """Normalised subsequence kernel between words and landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        row, code, weight = _sparse([_parts(w)[0] for w in landmarks])
        codes, back = np.unique(code, return_inverse=True)
        # 0 is the place of all codes that no landmark has; most codes are in one landmark or two, so each has a list of its own
        self.place = np.zeros(_BASE**3, np.int32)
        self.place[codes] = np.arange(1, len(codes) + 1)
        order = np.lexsort((row, back))
        self.owner, self.weight = row[order], weight[order]
        self.start = np.searchsorted(back[order], np.arange(-1, len(codes) + 1))
        self.most = np.zeros(len(codes) + 1)
        np.maximum.at(self.most, back + 1, weight)

    def similarity(self, words: list[str], floor: float = 0.0) -> np.ndarray:
        """Of each word, the similarity to each landmark; of a long word, the largest of its parts. Words of which a sum
        of the landmarks' largest weights shows that none can reach ``floor`` are left at 0."""
        parts = [_parts(w) for w in words]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        flat = [p for ps in parts for p in ps]
        counts = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(words)), counts)
        for a in range(0, len(flat), 4096):
            row, code, weight = _sparse(flat[a : a + 4096])
            place = self.place[code]
            some = place > 0
            if floor > 0:
                some &= np.bincount(row, weights=weight * self.most[place])[row] >= floor - 1e-6
            row, place, weight = row[some], place[some], weight[some]
            if len(row):
                first = self.start[place]
                n = self.start[place + 1] - first
                each = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                near, back = np.unique(row, return_inverse=True)
                cell = np.repeat(back, n) * len(self.landmarks) + self.owner[each]
                values = np.bincount(cell, weights=np.repeat(weight, n) * self.weight[each], minlength=len(near) * len(self.landmarks))
                values = values.reshape(len(near), -1).astype(np.float32)
                at = owner[a : a + 4096][near]
                alone = counts[at] == 1
                out[at[alone]] = values[alone]
                np.maximum.at(out, at[~alone], values[~alone])
        return out


def _whiten(kernel: Kernel) -> np.ndarray:
    """The Nyström map: the inverse square root of the landmarks' own kernel."""
    values, vectors = np.linalg.eigh(kernel.similarity(kernel.landmarks).astype(np.float64) ** 2)
    keep = values > 1e-3
    return vectors[:, keep] / np.sqrt(values[keep])


def fit_svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, cost: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by Newton's method; each row counts ``toxic`` times on one side and
    ``clean`` times on the other, both sides weighed alike."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    up, down = toxic * (0.5 * cost / max(toxic.sum(), 1e-9)), clean * (0.5 * cost / max(clean.sum(), 1e-9))
    pull = np.ones(z.shape[1])
    pull[-1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w):
        f = z @ w
        return f, (pull * w * w).sum() / 2 + (up * np.maximum(0, 1 - f) ** 2).sum() + (down * np.maximum(0, 1 + f) ** 2).sum()

    f, now = loss(w)
    for _ in range(steps):
        slope = pull * w - 2 * z.T @ (up * np.maximum(0, 1 - f) - down * np.maximum(0, 1 + f))
        bend = np.diag(pull) + 2 * (z * (up * (f < 1) + down * (f > -1))[:, None]).T @ z
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4:
            f_new, new = loss(w - size * move)
            if new < now:
                break
            size /= 2
        else:
            break
        w, f, done, now = w - size * move, f_new, now - new < 1e-9 * now, new
        if done:
            break
    return w[:-1], float(w[-1])


class WordMachine:
    """Decisions on words: a support vector machine in the Nyström coordinates of the squared kernel."""

    def __init__(self, landmarks: list[str], weights: np.ndarray | None = None) -> None:
        """``weights`` are one for each landmark's squared kernel; a word like no landmark has a decision of 0."""
        self.kernel, self.weights = Kernel(landmarks), weights
        self.known: dict[str, float] = {}

    def rows(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which plain words are like a landmark, and their squared similarities to each."""
        at, rows = [np.zeros(0, np.int64)], [np.zeros((0, len(self.kernel.landmarks)), np.float32)]
        for a in range(0, len(forms), 20_000):
            found = self.kernel.similarity(forms[a : a + 20_000], FLOOR)
            keep = np.flatnonzero(found.max(axis=1) >= FLOOR)
            at.append(a + keep)
            rows.append(np.where(found[keep] >= FLOOR, found[keep], 0) ** 2)
        return np.concatenate(at), np.concatenate(rows)

    def fit(self, rows: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """Learns from words as labelled sentences hold them, and from landmarks written with letters put in."""
        random = np.random.default_rng(23)
        odd = []
        for word in self.kernel.landmarks:
            for k in range(VARIANTS):
                form = word
                for _ in range(1 + k % 2):
                    cut = int(random.integers(1, len(form)))
                    form = form[:cut] + chr(97 + int(random.integers(26))) + form[cut:]
                odd.append(form)
        at, more = self.rows(odd)
        mapped = _whiten(self.kernel)
        x = np.concatenate([rows, more]) @ mapped
        # the forms of a landmark count as often, together, as the average word of toxic documents
        share = np.full(len(at), toxic.sum() / max((toxic > 0).sum(), 1) / VARIANTS)
        weights, self.bias = fit_svm(x, np.append(toxic, share), np.append(clean, np.zeros(len(at))), 30_000.0)
        self.weights = mapped @ weights

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        fresh = list(words.difference(self.known))
        forms = [plain(w) for w in fresh]
        names = list(dict.fromkeys(forms))
        at, rows = self.rows(names)
        decisions = dict(zip((names[k] for k in at.tolist()), np.maximum((rows * self.weights).sum(axis=1) + self.bias, 0).tolist(), strict=True))
        self.known.update(zip(fresh, (decisions.get(f, 0.0) for f in forms), strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: how many words have a decision above each step, against its length and as such, the length, and
        the worst sentence, whose decision is the sum of its words'."""
        texts = [_SPELLED.sub(lambda m: re.sub(r"\W", "", m[0]), t) if _PAIR.search(t) else t for t in map(str.lower, texts)]
        words = [t.replace("\n", " . ").split() for t in texts]
        self._learn(set().union(*words) if words else set())
        out = np.zeros((len(texts), 2 * len(STEPS) + 2))
        look = self.known.__getitem__
        for row, own in zip(out, words, strict=True):
            decisions = np.fromiter(map(look, own), np.float64, len(own))
            hits = np.flatnonzero(decisions)
            counts = np.zeros(len(STEPS))
            if len(hits):
                found = decisions[hits]
                counts = np.array([np.clip((found - s) / 0.2, 0, 1).sum() for s in STEPS])
                ends = np.array([k for k, w in enumerate(own) if w[-1] in _ENDS] + [len(own)])
                row[-1] = np.log1p(np.bincount(np.searchsorted(ends, hits), weights=found).max())
            scale = np.sqrt(len(own) + 20)
            row[: len(STEPS)] = counts / scale
            row[len(STEPS) : -2] = np.log1p(counts)
            row[-2] = len(own) / scale
        return out


_MACHINES: dict[bytes, WordMachine] = {}


def machine(landmarks: list[str], weights: np.ndarray, bias: float) -> WordMachine:
    """This process's machine; a worker keeps it, with the words it knows, from task to task."""
    key = repr((landmarks, bias)).encode() + weights.tobytes()
    if key not in _MACHINES:
        _MACHINES.clear()
        own = _MACHINES[key] = WordMachine(landmarks, weights)
        own.bias = bias
    return _MACHINES[key]


class TextMachine:
    """The machine that decides on documents, and a logistic curve from its margin to a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        """The curve is fitted on every fifth document, which the machine doesn't see."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = (x - self.mean) / self.scale
        aside = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
        self.weights, self.bias = fit_svm(x[~aside], (y[~aside] > 0).astype(float), (y[~aside] <= 0).astype(float), 100.0)
        if not ((y[aside] > 0).any() and (y[aside] <= 0).any()):
            aside = np.ones(len(x), bool)
        z = np.stack([x[aside] @ self.weights + self.bias, np.ones(aside.sum())], axis=1)
        toxic = y[aside] > 0
        # Platt's targets keep the curve finite where the margins tell the labels apart
        t = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
        self.curve = np.array([1.0, 0.0])
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            self.curve -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - t) + 1e-2 * self.curve)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = ((x - self.mean) / self.scale * self.weights).sum(axis=1) + self.bias  # row by row: alike in any batch
        return 1 / (1 + np.exp(-np.clip(margin * self.curve[0] + self.curve[1], -30, 30)))


def choose_landmarks(words: pd.DataFrame, toxic: int, clean: int) -> list[str]:
    """Words that toxic documents hold far more often than others, the most telling first, none too like another."""
    odds = np.log((words["toxic"] + 0.1) / (toxic + 1)) - np.log((words["clean"] + 0.5) / (clean + 1))
    words = words.assign(value=odds * words["toxic"])[odds > 2.5].sort_values(["value", "word"], ascending=[False, True])
    words = words[words["value"] >= 12]
    found = list(dict.fromkeys(w for w in map(plain, words["word"]) if 3 <= len(w) <= WIDTH - 2))
    if not found:
        return []
    row, code, weight = _sparse([_parts(w)[0] for w in found])
    codes, column = np.unique(code, return_inverse=True)
    vectors = np.zeros((len(found), len(codes)), np.float32)
    vectors[row, column] = weight
    like = vectors @ vectors.T
    kept: list[int] = []
    for k in range(len(found)):
        if len(kept) < LANDMARKS and (not kept or like[k, kept].max() < APART):
            kept.append(k)
    return [found[k] for k in kept]


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` with held_out, score and predicted: how likely each text is toxic.

    Words are compared with landmark words by common subsequences of three characters, which may skip
    up to SKIPS others, so inserted signs or letters and other endings still match; single letters that
    spell a word are joined. Landmarks are words of the at most ``fit_rows`` labelled documents whose crc32
    of the id is not divisible by 5. A machine in the landmarks' Nyström coordinates learns from the words
    of those documents' sentences, which inherit the label; a sentence's decision is the sum of its words'.
    A second machine learns documents from the decisions on all their words and on their worst sentence;
    a logistic curve, fitted on documents kept aside, makes a probability of its margin.
    Null and empty texts have no word; a row without an id is scored and not held out; with no labels or
    no telling word all scores are the share of toxic labels; a label given twice counts as its largest;
    repeated rows get equal scores. Columns named held_out, score or predicted are replaced.
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    known = labelled(docs, labels, "toxic", fit_rows)
    known = known.withColumn("text", F.coalesce("text", F.lit(""))).persist()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = known.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s]+"))).alias("word")).groupBy("word")
    words = words.agg(F.sum((F.col("label") > 0).cast("int")).alias("toxic"), F.sum((F.col("label") <= 0).cast("int")).alias("clean"))
    telling = words.where((F.col("toxic") > 1) & (F.col("toxic") > 3 * F.col("clean"))).orderBy(F.desc("toxic"), "word").limit(CANDIDATES).toPandas()
    landmarks = choose_landmarks(telling, sizes.get(1, 0), sizes.get(0, 0))
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    decide = None
    if landmarks:
        first = WordMachine(landmarks)

        def alike(batches):
            for b in batches:
                forms = [plain(w) for w in b["word"]]
                b = b.assign(form=forms).groupby("form", as_index=False)[["toxic", "clean"]].sum()
                at, rows = first.rows(b["form"].tolist()) if len(b) else ([], [])
                yield pd.DataFrame({"toxic": b["toxic"].to_numpy()[at], "clean": b["clean"].to_numpy()[at], "x": [r.tobytes() for r in rows]})

        # as many as the bounded rows have such words
        found = words.mapInPandas(alike, "toxic long, clean long, x binary").toPandas().groupby("x", as_index=False).sum()
        rows = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, len(landmarks))
        first.fit(rows, found["toxic"].to_numpy(np.float64), found["clean"].to_numpy(np.float64))
        weights, bias = first.weights, first.bias

        def documents(batches):
            own = machine(landmarks, weights, bias)
            for b in pieces(batches, size=2 << 20):
                yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [v.tobytes() for v in own.features(b["text"].tolist())]})

        found = known.select("doc_id", "label", "text").mapInPandas(documents, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "label", "x"])
        decide = TextMachine(np.stack([np.frombuffer(x) for x in found["x"]]), found["label"].to_numpy())
    known.unpersist()

    schema = T.StructType([*docs.schema.fields, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        own = machine(landmarks, weights, bias) if decide else None
        for b in pieces(batches, size=2 << 20):
            yield b.assign(score=decide.score(own.features([t or "" for t in b["text"]])) if decide else prior)

    marked = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return marked.mapInPandas(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a machine fitted on labels.toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text")
