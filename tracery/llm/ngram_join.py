"""Self-join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, modest_batches, partitions, pieces, small, stash, table
from .shingles import mix64, shingle_hashes, word_hashes

#: N-grams that one fragment of the global order holds, about; bounds the memory of a task.
FRAGMENT_ITEMS = 1_000_000
#: Parts into which the order is cut when overlaps of candidate pairs are counted.
SEGMENTS = 8
#: Stands for several documents of one batch where an owner is meant.
NOBODY = np.iinfo(np.int64).min
#: Documents whose counts one task sums up, and characters of texts that it cuts at once.
BUCKET_DOCS, PIECE = 50_000, 3 << 20
_BITS = np.uint64((1 << 56) - 1)


def _sets(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as 56-bit numbers, ordered by text and number, and the text of each."""
    grams, text = [], []
    for a in range(0, len(texts), 256):
        hashes, _, _, counts, _ = word_hashes(texts[a : a + 256])
        h, t = shingle_hashes(hashes, counts, words)
        key = np.unique((t.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))
        grams.append(key & _BITS)
        text.append((key >> np.uint64(56)).astype(np.int64) + a)
    return (np.concatenate(grams), np.concatenate(text)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fingerprints(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set of n-grams; with its size they tell sets apart."""
    ends, out = np.cumsum(sizes), []
    for mixed in (mix64(grams + np.uint64(1)), mix64(grams ^ np.uint64(0x5DEECE66D << 8))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _by_bucket(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket of documents that occurs, and the places of its documents."""
    bucket = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(ids) else []
    for own in np.split(order, starts[1:]) if len(ids) else ():
        yield int(bucket[own[0]]), own


def _profile(batches: Iterator[pd.DataFrame], words: int, fragments: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Each batch's n-grams by fragment; one that several texts of the batch hold goes out once, without owner. Sizes and
    sums of the sets go to buckets of documents, which count as fragments below 0."""
    for batch in pieces(batches, size=PIECE):
        ids = batch["doc_id"].to_numpy(np.int64)
        grams, text = _sets(batch["text"].tolist(), words)
        sizes = np.bincount(text, minlength=len(ids))
        sets = np.stack([sizes, *fingerprints(grams, sizes)])
        order = np.argsort(grams)
        ordered = grams[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        shared = np.zeros(len(grams), bool)
        shared[order] = many
        known = np.bincount(text[shared], minlength=len(ids))
        rows = [(-1 - k, ids[own].tobytes(), known[own].astype(np.int32).tobytes(), sets[:, own].tobytes()) for k, own in _by_bucket(ids, buckets)]
        # owner 0 is no text; the others are places in the batch from 1
        values = np.concatenate([ordered[many & new], grams[~shared]])
        owner = np.concatenate([np.zeros(int((many & new).sum()), np.int64), text[~shared] + 1])
        fragment = (((values >> np.uint64(24)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(fragment.astype(np.uint16) if fragments < 65536 else fragment, kind="stable")
        values, owner, fragment = values[by].astype(np.uint32), owner[by], fragment[by]
        names = np.concatenate([[NOBODY], ids])
        cuts = np.searchsorted(fragment, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[f], cuts[f + 1]
            start = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
            rows.append((int(f), names[owner[a + start]].tobytes(), np.diff(np.concatenate([start, [b - a]])).astype(np.int32).tobytes(), values[a:b].tobytes()))
        if rows:
            yield pd.DataFrame(rows, columns=["frag", "docs", "counts", "grams"])


def _shared_in_fragment(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """How many n-grams of each document of one fragment another document holds too, packed by buckets of documents."""
    frag = int(rows["frag"].iloc[0])
    if frag < 0:
        sets = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in rows["grams"]], axis=1)
        out = [(-1 - frag, b"".join(rows["docs"]), b"".join(rows["counts"]), sets.tobytes())]
    else:
        docs = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for d, c in zip(rows["docs"], rows["counts"], strict=True)])
        grams = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["grams"]])
        order = np.argsort(grams)
        ordered = grams[order]
        group = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) - 1
        owners = docs[order]
        several = (np.bincount(group) > 1) | (np.bincount(group, weights=owners == NOBODY) > 0)
        ids, counts = np.unique(owners[several[group] & (owners != NOBODY)], return_counts=True)
        out = [(k, ids[own].tobytes(), counts[own].astype(np.int32).tobytes(), b"") for k, own in _by_bucket(ids, buckets)]
    return pd.DataFrame(out, columns=["bucket", "docs", "counts", "sets"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The profile of each document of a bucket: its set's size and sums, and its shared n-grams in all fragments."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["docs"]])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in rows["counts"]])
    distinct, back = np.unique(ids, return_inverse=True)
    shared = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
    own = np.concatenate([np.frombuffer(d, np.int64) for d, s in zip(rows["docs"], rows["sets"], strict=True) if s])
    sets = np.concatenate([np.frombuffer(s, np.int64).reshape(3, -1) for s in rows["sets"] if s], axis=1)
    order = np.lexsort((sets[2], sets[1], sets[0], own))
    last = order[np.flatnonzero(np.concatenate([own[order][1:] != own[order][:-1], [True]]))]
    copies = np.diff(np.concatenate([[0], np.flatnonzero(np.concatenate([own[order][1:] != own[order][:-1], [True]])) + 1]))
    return pd.DataFrame({"doc_id": distinct, "copies": copies, "n": sets[0, last], "f1": sets[1, last], "f2": sets[2, last], "shared": shared})


def _grams(batches: Iterator[pd.DataFrame], words: int, segments: int) -> Iterator[pd.DataFrame]:
    """The n-grams of each text by segment, if they are the set that its document goes by."""
    for batch in pieces(batches, size=PIECE):
        grams, text = _sets(batch["text"].tolist(), words)
        cuts = np.searchsorted(text, np.arange(len(batch) + 1))
        f1, f2 = fingerprints(grams, np.diff(cuts))
        chosen = (np.diff(cuts) == batch["n"]) & (f1 == batch["f1"]) & (f2 == batch["f2"])
        rows = []
        for k in np.flatnonzero(chosen):
            doc, copies, n = batch["doc_id"].iloc[k], batch["copies"].iloc[k], batch["n"].iloc[k]
            own = grams[cuts[k] : cuts[k + 1]]
            segment = np.searchsorted(own, (np.arange(segments + 1, dtype=np.uint64) << np.uint64(56)) // np.uint64(segments))
            rows += [(doc, copies, n, s, own[segment[s] : segment[s + 1]].astype(np.int64)) for s in range(segments) if segment[s] < segment[s + 1]]
        yield pd.DataFrame(rows, columns=["doc_id", "copies", "n", "segment", "grams"])


def cut_sets(texts: DataFrame, wanted: DataFrame, words: int, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, n, segment, grams), once for each document of ``wanted`` (doc_id, copies, n, f1, f2): of rows that repeat its id,
    those that hold other sets are passed over, and those that hold the same one count once."""
    sets = texts.join(wanted, "doc_id").select("doc_id", "copies", "n", "f1", "f2", "text")
    sets = stash(sets.mapInPandas(lambda x: _grams(x, words, segments), "doc_id long, copies long, n long, segment int, grams array<long>"), "sets")
    once = sets.where("copies > 1").dropDuplicates(["doc_id", "segment"])
    return sets.where("copies = 1").unionByName(once).drop("copies")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Common n-grams of each pair (a, b): counted in every segment of the order on its own, then summed."""
    left = segments.select(F.col("doc_id").alias("a"), "segment", F.col("grams").alias("ga"))
    right = segments.select(F.col("doc_id").alias("b"), F.col("segment").alias("s"), F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, (pairs.b == right.b) & (left.segment == right.s))
    part = part.select("a", pairs.b, "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))


def ngram_jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Groups of documents linked by n-gram sets with 100 * |intersection| >= percent * |union|.

    ``docs`` has doc_id and text; other columns are not read. Returns (documents, links):
    documents has doc_id, n_shingles, class_id (smallest doc_id with the very same set), component_id
    (smallest doc_id reachable by links); links has pairs of class ids (a, b) that connect each
    component, with their sizes and overlap.

    1. One pass cuts the n-grams of all texts by the ranges of a global (hash) order into fragments;
       each fragment counts, per document, the n-grams that some other document holds. A document
       with fewer than ``percent`` of its n-grams so shared can have no link and goes no further.
       N-grams that a batch holds more than once leave it once, so frequent ones stay small.
    2. Of the rest, one document for each distinct set is joined on its prefix in rare-first order
       (prefix, length and position filters, all exact). Each n-gram first proposes only links to its
       most shared document; then only pairs that still lie in different components.
    3. Overlaps of candidates are counted segment by segment of the order and summed per pair.

    Null or empty texts have no n-grams and no links, and are their own component; a text with fewer
    words than ``words`` has one n-gram. Rows without a doc_id are kept with null ids; a doc_id that comes with several
    different texts gives one row with the largest of their sets, which alone is compared. An empty table gives no rows.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = texts.where("doc_id is not null")
    size, number = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(partitions(spark), number // BUCKET_DOCS)
    fragments = max(partitions(spark), size // 5 // FRAGMENT_ITEMS)
    cut = named.mapInPandas(lambda x: _profile(x, words, fragments, buckets), "frag int, docs binary, counts binary, grams binary")
    counted = cut.groupBy("frag").applyInPandas(lambda x: _shared_in_fragment(x, buckets), "bucket int, docs binary, counts binary, sets binary")
    profile = stash(counted.groupBy("bucket").applyInPandas(_summed, "doc_id long, copies long, n long, f1 long, f2 long, shared long"), "profile")

    found = profile.where((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))).groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "copies")).alias("d"))
    found = stash(found.select("d.doc_id", "d.copies", "n", "f1", "f2"), "found")
    sets = cut_sets(named, small(found), words)

    items = sets.select("doc_id", "n", F.explode("grams").alias("g"))
    common = items.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = items.join(common, "g").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("ranked"))
    # n-grams of one set only come first in the order and match nothing
    ranked = ranked.withColumn("alone", F.col("n") - F.size("ranked"))
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    reach = F.greatest(F.lit(0), F.col("n") - need + 1 - F.col("alone")).cast("int")
    prefix = ranked.where(F.size("ranked") >= need).select("doc_id", "n", "alone", F.posexplode(F.slice("ranked", F.lit(1), reach)).alias("k", "item"))
    prefix = stash(prefix.select("doc_id", "n", F.col("item.g").alias("g"), (F.col("n") - F.col("alone") - F.col("k")).cast("long").alias("rest"), (F.col("alone") / F.col("n")).alias("share")), "prefix")

    def linkable(na, nb, ra, rb):
        return (100 + percent) * F.least(ra, rb) >= percent * (na + nb)

    hub = prefix.groupBy("g").agg(F.min(F.struct("share", "doc_id", "n", "rest")).alias("h"))
    star = prefix.join(hub, "g").where(F.col("doc_id") != F.col("h.doc_id")).where(linkable(F.col("n"), F.col("h.n"), F.col("rest"), F.col("h.rest")))
    star = star.select(F.col("doc_id").alias("a"), F.col("h.doc_id").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb")).distinct()

    def verified(pairs):
        return _overlaps(pairs, sets).where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb")))

    links = stash(verified(star), "links")
    roots = components(links)
    # now the pairs whose documents are not yet together
    open_ = prefix.join(roots, prefix.doc_id == roots.id, "left").select("g", "doc_id", "n", "rest", F.coalesce("root", "doc_id").alias("root"))
    mixed = open_.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
    open_ = stash(open_.join(mixed, "g"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    cross = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root")) & linkable(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest")))
    cross = cross.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stash(verified(cross.join(tried, ["a", "b"], "left_anti")), "links")
    links = links.unionByName(more)
    if more.limit(1).count():
        roots = components(links)

    classes = profile.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(roots, classes.class_id == roots.id, "left").select("f1", "f2", "n", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    out = profile.join(classes, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(_unnamed(texts, words)), links


def _unnamed(texts: DataFrame, words: int) -> DataFrame:
    def sizes(batches):
        for batch in pieces(batches):
            text = _sets(batch["text"].tolist(), words)[1]
            yield pd.DataFrame({"n_shingles": np.bincount(text, minlength=len(batch))})

    rest = texts.where("doc_id is null").select("text").mapInPandas(sizes, "n_shingles long")
    return rest.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word sets at 85 percent over all documents."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), 4, 85)[0]
