"""Near duplicates by HyperMinHash: compressed registers propose pairs, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, modest_batches, partitions, pieces, small, stash, table
from .ngram_join import PIECE, _overlaps, _sets, cut_sets, fingerprints
from .shingles import mix64

#: Registers of a sketch, bits of a register's mantissa, bands of a large set's sketch.
REGISTERS, MANTISSA, BANDS = 240, 10, 40
#: Expected share of registers of 2**MANTISSA mantissas that agree by chance (for sets of one size), times 2**MANTISSA.
COLLISION = 0.169919487159739093975315012348630288992889
#: Standard errors by which an estimate may fall short of the limit and still be confirmed.
ERRORS = 4.0
#: Documents of a key that one task compares, and items of their sets; a larger key is compared by pairs of parts.
WIDE, WIDE_ITEMS = 4096, 2_000_000
#: Rows of keys that one call compares, about.
BUCKET_ROWS = 5000
EMPTY = np.uint16(0xFFFF)


def registers(grams: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """A row of REGISTERS numbers of 16 bits for each text: for each bucket of its n-grams the smallest hash, as the place of
    its first bit that is set (counted from the end of a 53-bit word, so fewer leading zeros are larger) and the bits after it."""
    bucket = ((mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = np.maximum(mix64(grams + np.uint64(0x51ED270B)) >> np.uint64(11), np.uint64(1)).astype(np.float64)
    # a double already is an exponent and a mantissa
    code = ((value.view(np.uint64) >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)).astype(np.uint16)
    out = np.full(texts * REGISTERS, EMPTY, np.uint16)
    np.minimum.at(out, text * REGISTERS + bucket.astype(np.int64), code)
    return out.reshape(texts, REGISTERS)


def judged(same: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches of which ``same`` of ``used`` registers agree, less the agreements expected by
    chance, and the standard error that a pair at ``limit`` would have: its registers are drawn from the union without
    replacement, so small sets have small errors."""
    used = np.maximum(used, 1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = COLLISION * used / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    union = np.maximum((na + nb) / (1 + limit), used)
    return np.clip((same - chance) / used, 0, 1), np.sqrt(limit * (1 - limit) / used * (union - used) / np.maximum(union - 1, 1)) + 0.5 / used


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for two arrays of sketches, row by row."""
    filled = (a != EMPTY) | (b != EMPTY)
    return judged(((a == b) & filled).sum(axis=1), filled.sum(axis=1), na, nb, limit)


def levels(percent: int) -> list[tuple[int, int]]:
    """(largest size, bands) of the levels of set sizes, the last without a limit.

    Sets that link differ in size by 100/percent at most, so they lie in one level or in neighbours, and of two sets of up to s
    items at most 2 s (100 - percent) / (100 + percent) items are in one only. A level has two bands more than that, so two
    bands hold the same of both sets, until there would be more than BANDS."""
    out, size = [], 1
    while (bands := 2 * size * (100 - percent) // (100 + percent) + 2) < BANDS:
        out.append((size, bands))
        size = size * 100 // percent + 1
    return [*out, (np.iinfo(np.int64).max, BANDS)]


def _profile(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Size, two sums and sketch of each text's set."""
    for batch in pieces(batches, size=PIECE):
        grams, text = _sets(batch["text"].tolist(), words)
        sizes = np.bincount(text, minlength=len(batch))
        f1, f2 = fingerprints(grams, sizes)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "f1": f1, "f2": f2, "regs": [r.tobytes() for r in registers(grams, text, len(batch))]})


def _band_keys(regs: np.ndarray, level: int, bands: int, layout: int) -> np.ndarray:
    """A key for each row and band of its registers, 0 where the band is empty. Layout 0 has neighbours in a band, layout 1 every
    so many-th register."""
    of = (np.arange(REGISTERS) * bands // REGISTERS) if layout == 0 else np.arange(REGISTERS) % bands
    seed = np.uint64(level * 2 + layout + 1) << np.uint64(32)
    each = np.where(regs == EMPTY, np.uint64(0), mix64(regs.astype(np.uint64) + (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(16)) + seed))
    keys = np.zeros((len(regs), bands), np.uint64)
    for b in range(bands):
        keys[:, b] = each[:, of == b].sum(axis=1, dtype=np.uint64)
    return keys


def _all_keys(regs: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The keys of each set in its level and the next, 0 where it has none. Even levels come first, so that two sets that share
    a key have it in the same column; small sets have two layouts."""
    steps = levels(percent)
    own = np.searchsorted(np.array([s for s, _ in steps[:-1]], np.int64), n)
    out = np.zeros((len(n), 2, 2, BANDS), np.uint64)
    for level, (_, bands) in enumerate(steps):
        at = np.flatnonzero((own == level) | (own == level - 1))
        for layout in (0, 1)[: (1 if bands == BANDS else 2) * bool(len(at))]:
            out[at, level % 2, layout, :bands] = _band_keys(regs[at], level, bands, layout)
    return out.reshape(len(n), -1).view(np.int64)


def _banded(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """A row for each key of each set."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch["regs"]), np.uint16).reshape(len(batch), REGISTERS)
        keys = _all_keys(regs, batch["n"].to_numpy(), percent)
        row, column = np.nonzero(keys)
        yield pd.DataFrame({"key": keys[row, column], "id": batch["id"].to_numpy()[row], "n": batch["n"].to_numpy()[row]})


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose estimated similarity may reach the limit."""

    def judge(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), REGISTERS) for c in ("ra", "rb"))
            found, error = estimate(a, b, batch["na"].to_numpy(), batch["nb"].to_numpy(), percent / 100)
            yield batch.loc[found + ERRORS * error >= percent / 100, ["a", "b", "na", "nb"]]

    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("regs").alias("ra")), "a").join(sketches.select(F.col("id").alias("b"), F.col("regs").alias("rb")), "b")
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(judge, "a long, b long, na long, nb long")


def _comparable(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


_NEAR = "key long, p int, q int, id long, n long, root long, near binary"


def _meet(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The documents of each key of a bucket of keys that may reach the limit, by their sketches, with some of another component,
    and the ids of those in one of each pair's two rows. A pair that has several keys in common comes with the first of them only."""
    ids, n, root, part = (rows[c].to_numpy() for c in ("id", "n", "root", "part"))
    regs = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(len(rows), REGISTERS)
    keys = _all_keys(regs, n, percent)
    out = []
    for (key, p, q), at in rows.groupby(["key", "p", "q"]).indices.items():
        # parts of one key meet each other here, and themselves in a cell of their own
        pairs = _pairs(key, keys[at], ids[at], n[at], root[at], regs[at], np.arange(len(at)) if p == q else part[at], percent)
        near = {k: b"" for own in pairs.values() for k in own.tolist()} | {k: ids[at[own]].tobytes() for k, own in pairs.items()}
        out += [(key, p, q, ids[at[k]], n[at[k]], root[at[k]], blob) for k, blob in near.items()]
    return pd.DataFrame(out, columns=["key", "p", "q", "id", "n", "root", "near"])


def _pairs(key: int, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, root: np.ndarray, regs: np.ndarray, part: np.ndarray, percent: int) -> dict[int, np.ndarray]:
    """By place, the places of the likely partners in other parts; each pair once."""
    roots, counts = np.unique(root, return_counts=True)
    largest = root == roots[counts.argmax()]
    filled = (regs != EMPTY).astype(np.float32)
    size, out = filled.sum(axis=1), {}
    for k in np.flatnonzero(~largest):  # all documents of the largest component are one already
        other = (root != root[k]) & (part != part[k]) & (largest | (ids > ids[k])) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        at = np.flatnonzero(other)
        mine = np.where(regs[k] == EMPTY, EMPTY - 1, regs[k])  # agrees with no empty register
        same = np.count_nonzero(regs[at] == mine, axis=1)
        found, error = judged(same, size[at] + size[k] - filled[at] @ filled[k], n[at], n[k], percent / 100)
        at = at[found + ERRORS * error >= percent / 100]
        first = ((keys[at] == keys[k]) & (keys[k] != 0)).argmax(axis=1)
        at = at[keys[k][first] == key]
        if len(at):
            out[int(k)] = at
    return out


def _confirm(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links among the likely partners of each key of a bucket of keys, by their full sets: as many as connect what is linked."""
    out = []
    for _, at in rows.groupby(["key", "p", "q"]).indices.items():
        own = rows.iloc[at].sort_values("id")
        ids, n, group = (own[c].to_numpy(np.int64) for c in ("id", "n", "root"))
        starts = np.cumsum(n) - n
        items = np.unique(np.concatenate(own["grams"].tolist()), return_inverse=True)[1]
        mark = np.zeros(items.max() + 1, bool)
        for k, near in enumerate(own["near"]):
            others = np.searchsorted(ids, np.frombuffer(near, np.int64))
            others = others[group[others] != group[k]]
            if not len(others):
                continue
            mine, sizes = items[starts[k] : starts[k] + n[k]], n[others]
            mark[mine] = True
            first = np.cumsum(sizes) - sizes
            common = np.add.reduceat(mark[items[np.arange(sizes.sum()) + np.repeat(starts[others] - first, sizes)]], first, dtype=np.int64)
            mark[mine] = False
            for b, both in zip(others.tolist(), common.tolist(), strict=True):
                if (100 + percent) * both >= percent * (n[k] + n[b]) and group[b] != group[k]:
                    group[group == group[b]] = group[k]
                    x, y = min(k, b), max(k, b)
                    out.append((ids[x], ids[y], n[x], n[y], both))
    return pd.DataFrame(out, columns=["a", "b", "na", "nb", "common"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """Groups of documents linked by word n-gram sets with 100 * |intersection| >= percent * |union|.

    ``docs`` has doc_id and text; other columns are not read. Returns (documents, links): documents has doc_id, n_shingles,
    class_id (smallest doc_id with the very same set), component_id (smallest doc_id reachable by links) and kept (whether that
    is the document itself); links has confirmed pairs of class ids (a, b) that connect each component, with sizes and overlap.

    1. Each set becomes a HyperMinHash sketch: 240 buckets that keep the smallest hash as a leading-zero count and ten bits of
       mantissa. One document stands for all with the same set.
    2. Bands of registers propose pairs; how many bands there are depends on the size of the sets (see ``levels``), so small
       sets that link always share bands, and of large ones at the limit about one pair in 200,000 shares none.
    3. A key first links its documents to one only, that with most company in all its keys. Then those of a key that are not
       connected yet are compared by their sketches, blockwise within a task. A key of over ``wide`` documents or WIDE_ITEMS
       n-grams is compared by pairs of parts, each in a task of its own.
    4. Estimates, with the expected chance agreements taken off, pass over pairs that lie 4 standard errors below the limit;
       the rest is confirmed on full sets, so every link returned is exact. Of a key's documents each one's set is fetched
       once and all its pairs are confirmed blockwise too: what is shuffled grows with documents, not with pairs.

    Null or empty texts have no n-grams and no links, and are their own component; a text with fewer words than ``words`` has one
    n-gram. Rows without a doc_id are kept with null ids; a doc_id that comes with several different texts gives one row with
    the largest of their sets, which alone is compared. An empty table gives no rows."""
    modest_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = stash(texts.mapInPandas(lambda x: _profile(x, words), "doc_id long, n long, f1 long, f2 long, regs binary"), "profile")
    own = profile.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("s"), F.count("*").alias("copies")).select("doc_id", "copies", "s.*")
    own = stash(own, "own")
    classes = own.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "copies")).alias("d"))
    classes = stash(classes.select("n", "f1", "f2", F.col("d.doc_id").alias("id"), "d.copies"), "classes")
    sketches = profile.withColumnRenamed("doc_id", "id").join(classes, ["id", "n", "f1", "f2"], "left_semi").dropDuplicates(["id"])
    # two different sets of n items have n + 1 at least together
    sketches = stash(sketches.where((F.col("n") * 100) >= percent * (F.col("n") + 1)), "sketches")

    banded = sketches.select("id", "n", "regs").mapInPandas(lambda x: _banded(x, percent), "key long, id long, n long")
    banded = stash(banded, "bands")
    several = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    banded = stash(banded.join(several, "key"), "bands")
    company = banded.groupBy("id").agg(F.sum("size").alias("company"))
    # the central document of a group of copies links to most of them
    known = stash(banded.join(company, "id"), "known")
    hubs = known.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"), "n")).alias("hub"))
    star = known.join(hubs, "key").select(F.col("id").alias("x"), (-F.col("hub.minus")).alias("y"), F.col("n").alias("nx"), F.col("hub.n").alias("ny"))
    star = star.where((F.col("x") != F.col("y")) & _comparable(F.col("nx"), F.col("ny"), percent))
    star = star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("nb"))
    star = stash(star.distinct(), "star")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = stash(pairs, "likely")
        ends = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        wanted = stash(classes.withColumnRenamed("id", "doc_id").join(ends, "doc_id", "left_semi"), "wanted")
        sets = cut_sets(texts, small(wanted), words, segments=1)
        return _overlaps(likely, sets).where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb")))

    links = stash(confirmed(_likely(star, sketches, percent)), "links")
    roots = components(links)

    rooted = banded.select("key", "id", "n").join(roots.withColumnRenamed("root", "found"), "id", "left").select("key", "id", "n", F.coalesce("found", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("items"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    # large keys in parts, and every pair of parts
    parts = F.ceil(F.greatest(F.col("size") / F.lit(wide), F.col("items") / F.lit(WIDE_ITEMS))).cast("int")
    open_ = rooted.join(mixed.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    open_ = stash(open_.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "n", "root"), "open")
    dealt = lambda buckets: F.pmod(F.xxhash64("key", "p", "q"), F.lit(buckets)).alias("bucket")
    buckets = max(partitions(docs.sparkSession), open_.count() // BUCKET_ROWS)
    met = stash(open_.join(sketches.select("id", "regs"), "id").groupBy(dealt(buckets)).applyInPandas(lambda x: _meet(x, percent), _NEAR), "met")
    buckets = max(partitions(docs.sparkSession), (met.agg(F.sum("n")).first()[0] or 0) // WIDE_ITEMS)
    wanted = stash(classes.withColumnRenamed("id", "doc_id").join(met.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "wanted")
    sets = cut_sets(texts, small(wanted), words, segments=1).select(F.col("doc_id").alias("id"), "grams")
    more = stash(met.join(sets, "id").groupBy(dealt(buckets)).applyInPandas(lambda x: _confirm(x, percent), "a long, b long, na long, nb long, common long").distinct(), "links")
    links = links.unionByName(more)
    if more.limit(1).count():
        roots = components(links)

    named = classes.join(roots, "id", "left").select("n", "f1", "f2", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component_id"))
    out = own.join(named, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = profile.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(nameless.withColumn("kept", F.lit(True))), links


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word sets at 80 percent over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)[0]
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")
