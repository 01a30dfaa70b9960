"""Removal of long repeated byte strings: minimizers bring their contexts together, suffix arrays compare them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, partitions, pieces, stash, table
from .shingles import mix64

#: Bytes of contexts in one shard, about, and contexts of one string that a suffix array compares at most;
#: those of a more frequent string are compared by counting their windows.
SHARD_BYTES, GROUP_CONTEXTS = 1_500_000, 3000
#: Names from which the recursion ranks by doubling instead of by buckets.
MANY_NAMES = 512

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Fingerprints of all substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P_INVERSE, np.uint64)]), dtype=np.uint64)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * powers[:-1], dtype=np.uint64)])

    def of(self, start, stop) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start] + np.asarray(stop - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values, by prefixes and suffixes of blocks."""
    n = len(x)
    fill = np.concatenate([x, np.full(-n % w, x[-1], x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(fill, axis=1).ravel()
    behind = np.minimum.accumulate(fill[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def minimizers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Every window of ``length`` bytes inside one text belongs to its k-byte string of least hash (the first such):
    places of those strings, their hashes, the first and the last window of each, and fingerprints of the data."""
    roll = Rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, roll
    at = np.arange(len(data) - k + 1)
    bits = np.uint64(max(int(len(data)).bit_length(), 1))
    hashes = roll.of(at, at + k)
    width = length - k + 1
    least = (_sliding_min((hashes >> bits << bits) | at.astype(np.uint64), width) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # the low bits gave way to the place: where that hid the least hash, it is looked up again
    for w in np.flatnonzero(_sliding_min(hashes, width) != hashes[least]):
        least[w] = w + int(np.argmin(hashes[w : w + width]))
    inside = np.zeros(len(least) + 1, np.int32)
    full = ends - starts >= length
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        return none, none, none, none, roll
    owner = least[window]
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[new], hashes[owner[new]], window[new], window[np.append(new[1:], len(window)) - 1], roll


def _seeds(batches: Iterator[pd.DataFrame], length: int, k: int) -> Iterator[pd.DataFrame]:
    for b in pieces(batches, size=1 << 20):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        at, hashes, first, last, roll = minimizers(data, starts, ends, length, k)
        doc = np.searchsorted(ends, at, side="right")
        context = mix64(roll.of(first, last + length) + (at - first).astype(np.uint64))
        yield pd.DataFrame({
            "h": hashes.astype(np.uint64).view(np.int64), "c": context.view(np.int64), "doc_id": b["doc_id"].to_numpy()[doc], "version": b["version"].to_numpy()[doc], "start": (first - starts[doc]).astype(np.int32),
            "before": (at - first).astype(np.int16), "size": (last + length - first).astype(np.int16),
        })


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S) or not (L); the last is smallest."""
    step = np.sign(np.diff(s.astype(np.int64)))
    place = np.where(step != 0, np.arange(len(step)), len(s))
    following = np.minimum.accumulate(place[::-1])[::-1]
    small = np.ones(len(s), bool)
    small[:-1] = np.append(step, 1)[np.minimum(following, len(step))] > 0
    return small


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the order of the leftmost-smaller suffixes induces: larger suffixes bucket by bucket
    from the left, then smaller ones from the right."""
    counts = np.bincount(s, minlength=symbols)
    tail = np.cumsum(counts)
    head = tail - counts
    sa = np.full(len(s), -1, np.int64)
    by = np.argsort(s[lms], kind="stable")
    own = s[lms][by]
    first = np.searchsorted(own, np.arange(symbols + 1))
    at = tail[own] - (first[own + 1] - first[own]) + np.arange(len(own)) - first[own]
    sa[at] = lms[by]
    lms_from = tail - np.diff(first)

    def spread(found, free, direction):
        order = np.argsort(s[found], kind="stable")
        sym = s[found][order]
        new = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        n = np.diff(np.append(new, len(sym)))
        rank = np.arange(len(sym)) - np.repeat(new, n)
        sa[free[sym] + rank if direction > 0 else free[sym] - 1 - rank] = found[order]
        free[sym[new]] += direction * n

    free = head.copy()
    for c in np.flatnonzero(counts):
        done = head[c]
        while free[c] > done:
            upto = free[c]
            before = sa[done:upto] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            done = upto
            if len(before):
                spread(before, free, 1)
        before = sa[lms_from[c] : tail[c]] - 1
        before = before[before >= 0]
        if len(before):
            spread(before, free, 1)
    large = free
    free = tail.copy()
    for c in np.flatnonzero(counts)[::-1]:
        done = tail[c]
        while free[c] < done:
            upto = free[c]
            before = sa[upto:done][::-1] - 1
            before = before[before >= 0]
            before = before[small[before]]
            done = upto
            if len(before):
                spread(before, free, -1)
        before = sa[head[c] : large[c]][::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        if len(before):
            spread(before, free, -1)
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of many names, by ranks of doubling length."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.concatenate([rank[k:], np.full(min(k, len(s)), -1)]) + 1
        key = rank * (len(s) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank[order[-1]] == len(s) - 1:
            return order
        k *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """By induced sorting. ``s`` ends with a 0 that occurs nowhere else."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(s, small, lms, symbols)
    if len(lms) < 2:
        return sa
    # names of leftmost-smaller substrings in their order
    mark = np.zeros(len(s), bool)
    mark[lms] = True
    ordered = sa[mark[sa]]
    next_ = np.empty(len(s), np.int64)
    next_[lms] = np.append(lms[1:], len(s) - 1)
    size = next_[ordered] - ordered + 1
    roll = Rolling((s & 255).astype(np.uint8)) if symbols > 256 else Rolling(s.astype(np.uint8))
    if symbols > 256:
        high = Rolling((s >> 8).astype(np.uint8))
        prints = roll.of(ordered, ordered + size) + np.uint64(3) * high.of(ordered, ordered + size)
    else:
        prints = roll.of(ordered, ordered + size)
    fresh = np.concatenate([[True], (prints[1:] != prints[:-1]) | (size[1:] != size[:-1])])
    name = np.empty(len(s), np.int64)
    name[ordered] = np.cumsum(fresh) - 1
    reduced = name[lms]
    if fresh.all():
        order = np.argsort(reduced, kind="stable")
    else:
        names = int(fresh.sum())
        order = suffix_array(reduced, names) if names <= MANY_NAMES else _doubled(reduced)
    return induce(s, small, lms[order], symbols)


def permuted_lcp(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """In text order, the common prefix of each suffix with the one before it in ``sa``, up to ``limit``, by bisection on
    fingerprints; those that reach ``limit`` or differ at once need one look."""
    before = np.full(len(sa), -1)
    before[sa[1:]] = sa[:-1]
    roll = Rolling(data)
    room = np.minimum(limit, len(data) - np.maximum(np.arange(len(sa)), before))
    out = np.zeros(len(sa), np.int64)
    at = np.flatnonzero((before >= 0) & (room > 0))
    at = at[data[at] == data[before[at]]]
    full = roll.of(at, at + room[at]) == roll.of(before[at], before[at] + room[at])
    out[at[full]] = room[at[full]]
    at = at[~full]
    low = np.ones(len(at), np.int64)
    step = 1 << max(int(limit).bit_length() - 1, 0)
    while step:
        longer = np.minimum(low + step, room[at])
        low = np.where(roll.of(at, at + longer) == roll.of(before[at], before[at] + longer), longer, low)
        step >>= 1
    out[at] = low
    return out


def worth_comparing(contexts: list[bytes], groups: np.ndarray, before: np.ndarray, k: int, length: int) -> np.ndarray:
    """Whether another context of the same string agrees with one in the half of a window that lies before the
    string, or in that after it: a shared window needs one of them."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    at = np.cumsum(sizes) - sizes + before
    half = (length - k) // 2
    roll = Rolling(data)
    out = np.zeros(len(contexts), bool)
    for ok, start, stop in ((before >= half, at - half, at), (sizes - before - k >= half, at + k, at + k + half)):
        own = np.flatnonzero(ok)
        key = mix64(roll.of(start[own], stop[own]) + groups[own].view(np.uint64))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own[count[back] > 1]] = True
    return out


def repeated_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every ``length`` bytes that start at two places or more: contexts of one shard as one string
    with separators, its suffix array, and runs of suffixes whose permuted common prefixes reach ``length``. No window
    belongs to two contexts, so the suffixes of a run are different places."""
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - 1 - offset
    sa = suffix_array(np.append(data.astype(np.int64) + 1, 0), 258)[1:]
    lcp = permuted_lcp(data, sa, length)[sa]
    good = left[sa] >= length
    joined = np.concatenate([[False], (lcp[1:] >= length) & good[1:] & good[:-1], [False]])
    hit = sa[joined[:-1] | joined[1:]]
    return owner[hit], offset[hit]


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(int(a), int(b)) for a, b in out]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _runs(starts: pd.Series, stops: pd.Series) -> pd.Series:
    return pd.Series([[x for r in _merged(a, b) for x in r] for a, b in zip(starts, stops, strict=True)])


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 50) -> DataFrame:
    """(doc_id, version, runs): the maximal byte runs [start, stop, ...] of each text that are covered by strings of
    ``length`` bytes which also start anywhere else; version is a hash of the text.

    Every string of ``length`` bytes belongs to the k-byte string of least hash inside it, so equal ones belong to
    equal ones. 1. These k-byte strings are hashed with their context (all strings of ``length`` bytes that
    belong to them); those met once in the corpus go no further. A context met twice is repeated as a whole.
    2. The other contexts of a repeated string are gathered, one for each distinct context, in shards;
       each shard's suffix array is induced and its permuted common prefixes give the repeated windows.
       Where one string has more than GROUP_CONTEXTS different contexts, its windows are counted instead by a shuffle
       on their fingerprints, so that no task holds them all.
    Null and empty texts and those under ``length`` bytes repeat nothing as such; rows without a doc_id are left out;
    each row is a document, so rows that repeat a doc_id repeat each other's strings. Fingerprints have 64 bits.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.hash("text").alias("version"), F.col("text").cast("string"))
    spark = docs.sparkSession
    modest_batches(spark)
    seeds = stash(rows.mapInPandas(lambda b: _seeds(b, length, k), "h long, c long, doc_id long, version int, start int, before short, size short"), "all-seeds")
    # counts are written first: a join of two plain shuffles can be dealt anew where one string holds many rows
    twice = stash(seeds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    seeds = stash(seeds.join(twice, "h"), "seeds")

    place = F.struct("doc_id", "version", "start", "before", "size")
    contexts = seeds.groupBy("h", "c").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    contexts = stash(contexts.select("h", "c", (F.col("n") > 1).alias("again"), "first.*"), "contexts")
    whole = seeds.join(contexts.where("again").select("h", "c"), ["h", "c"]).select("doc_id", "version", "start", (F.col("start") + F.col("size")).alias("stop"))
    several = stash(contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
    ask = contexts.join(several, "h").select("h", "m", "doc_id", "version", "start", "before", "size")
    ask = stash(ask.groupBy("doc_id", "version").agg(F.collect_list(F.struct("h", "m", "start", "before", "size")).alias("asked")), "asked")

    def cut(batches):
        for b in pieces(batches, size=2 << 20):
            out = []
            for doc, version, text, asked in zip(b["doc_id"], b["version"], b["text"], b["asked"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(a["h"], a["m"], doc, version, a["start"], a["before"], data[a["start"] : a["start"] + a["size"]]) for a in asked]
            yield pd.DataFrame(out, columns=["h", "m", "doc_id", "version", "start", "before", "context"])

    # a row that comes twice asks twice; one of the two is enough
    asked = rows.join(ask, ["doc_id", "version"]).mapInPandas(cut, "h long, m long, doc_id long, version int, start int, before short, context binary")
    found = stash(asked, "cut")
    size = found.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    shards = max(partitions(spark), size // SHARD_BYTES)

    def compare(group):
        group = group.drop_duplicates(["h", "doc_id", "version", "start"])
        group = group[worth_comparing(group["context"].tolist(), group["h"].to_numpy(np.int64), group["before"].to_numpy(np.int64), k, length)]
        if not len(group):
            return pd.DataFrame({"doc_id": [], "version": [], "start": [], "stop": []}).astype("int64")
        owner, offset = repeated_windows(group["context"].tolist(), length)
        out = group[["doc_id", "version", "start"]].iloc[owner]
        out = out.assign(start=out["start"] + offset).sort_values(["doc_id", "version", "start"])
        runs = [(*d, a, b) for d, g in out.groupby(["doc_id", "version"]) for a, b in _merged(g["start"], g["start"] + length)]
        return pd.DataFrame(runs, columns=["doc_id", "version", "start", "stop"])

    shaped = found.where(F.col("m") <= GROUP_CONTEXTS).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    some = shaped.groupBy("shard").applyInPandas(compare, "doc_id long, version int, start int, stop int")

    def windows(batches):
        for b in pieces(batches, "context", size=1 << 18):
            data = np.frombuffer(b"".join(b["context"]), np.uint8)
            sizes = b["context"].map(len).to_numpy()
            n = np.maximum(sizes - length + 1, 0)
            before = np.repeat(np.cumsum(sizes) - sizes, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + before
            prints = Rolling(data).of(at, at + length)
            yield pd.DataFrame({"w": prints.view(np.int64), "doc_id": np.repeat(b["doc_id"].to_numpy(), n), "version": np.repeat(b["version"].to_numpy(), n), "start": np.repeat(b["start"].to_numpy(), n) + at - before})

    frequent = found.where(F.col("m") > GROUP_CONTEXTS).mapInPandas(windows, "w long, doc_id long, version int, start int")
    frequent = stash(frequent, "windows")
    spot = F.struct("doc_id", "version", "start")
    count = stash(frequent.groupBy("w").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("w"), "repeated")
    rest = frequent.join(count, "w").select("doc_id", "version", "start", (F.col("start") + length).alias("stop"))

    spans = whole.unionByName(some).unionByName(rest)
    spans = spans.groupBy("doc_id", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return spans.select("doc_id", "version", _runs("starts", "stops").alias("runs"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text): kept has the remaining bytes."""
    runs = stash(repeated_spans(docs, length), "runs")
    rows = docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("version"), F.col("text").cast("string"))
    joined = rows.join(runs, ["doc_id", "version"], "left")

    def cut(batches):
        for b in pieces(batches, size=4 << 20):
            out = []
            for text, own in zip(b["text"], b["runs"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                at, kept, gone = 0, [], 0
                own = own if own is not None else ()
                for a, z in zip(own[0::2], own[1::2], strict=True):
                    kept.append(data[at:a])
                    at, gone = z, gone + z - a
                out.append((len(data), gone, len(own) // 2, b"".join([*kept, data[at:]])))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])], axis=1)

    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes over all documents."""
    cut = remove_repeats(table(spark, sf_dir, "documents"), 200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
