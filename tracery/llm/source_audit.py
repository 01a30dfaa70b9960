"""How far the sources of a language diverge in their terms, counted over distinct whitespace chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_memory, modest_batches, partitions, small, stash, table

#: Bytes of texts whose chunks are listed together, and cells of a table of sources and terms that one task compares.
BLOCK, CELLS = 16 << 20, 2_000_000
#: What a term is, smoothing and scale of shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMOOTH, SCALE = 5, 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCKS = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("groups", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("chunks", pa.list_(pa.string())), ("held", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed with all first bytes first, as most have few."""
    data = np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(np.int64).ravel()


def _block(number: int, rows: pa.Table) -> pa.RecordBatch:
    """The distinct chunks of some texts, and for each document which it holds (a key of document and chunk) and how often."""
    split = pc.ascii_split_whitespace(rows["text"].combine_chunks())
    words = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    size = max(1, len(words.dictionary))
    keys, counts = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    pairs, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    langs, sources = lang.dictionary.take(pa.array(pairs // len(source.dictionary))), source.dictionary.take(pa.array(pairs % len(source.dictionary)))
    row = [number, langs.to_pylist(), sources.to_pylist(), _pack(group), _pack(np.diff(keys, prepend=0)), _pack(counts), words.dictionary, pa.array(np.bincount(keys % size, minlength=len(words.dictionary)))]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each ``size`` bytes of texts, or for each batch of rows if that is more."""
    number, held, total = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        held.append(batch)
        total += pc.sum(pc.binary_length(batch["text"])).as_py() or 0
        if total >= size:
            yield _block(number, pa.Table.from_batches(held))
            number, held, total = number + 1, [], 0
    if sum(map(len, held)):
        yield _block(number, pa.Table.from_batches(held))
    free_memory()


def _counted(block: pa.Table, cut: pa.Table) -> pa.Table:
    """Occurrences and documents of each term in each (lang, source) of a block."""
    if not len(block) or not len(cut):
        return _COUNTS.empty_table()
    own = {c: block[c][0].as_py() for c in ("langs", "sources", "groups", "keys", "counts")}
    size = max(1, block["size"][0].as_py())
    group, keys, counts = _unpack(own["groups"]), np.cumsum(_unpack(own["keys"])), _unpack(own["counts"])
    doc, ids = keys // size, keys % size
    # the terms of chunk c: flat[first[c] : first[c] + many[c]]
    words = cut["term"].combine_chunks().dictionary_encode()
    chunk, names = cut["id"].to_numpy(), words.dictionary
    flat = words.indices.to_numpy()[np.argsort(chunk, kind="stable")].astype(np.int64)
    many = np.bincount(chunk, minlength=size)
    first = np.cumsum(many) - many
    each = many[ids]
    entry = np.repeat(np.arange(len(ids)), each)
    term = flat[np.repeat(first[ids] - np.cumsum(each) + each, each) + np.arange(len(entry))]
    doc = doc[entry]
    key, back = np.unique(group[doc] * len(names) + term, return_inverse=True)
    n = np.bincount(back, weights=counts[entry], minlength=len(key)).astype(np.int64)  # exact below 2**53
    once = np.unique(doc * len(names) + term)
    docs = np.unique(group[once // len(names)] * len(names) + once % len(names), return_counts=True)[1]  # in the order of key
    of = pa.array(key // len(names))
    return pa.table([pa.array(own["langs"]).take(of), pa.array(own["sources"]).take(of), names.take(pa.array(key % len(names))), n, docs.astype(np.int64)], schema=_COUNTS)


def term_counts(docs: DataFrame, least_docs: int = 1, block: int = BLOCK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group of documents, and documents that hold it. Of terms
    in fewer than ``least_docs`` documents of any language some are left out: those whose chunks together have fewer.

    Texts are cut at white space, which no term spans, and each document's chunks are counted. Every distinct chunk of the
    corpus is cut into terms once, in one row of a table; that table is joined back to the lists of distinct chunks of blocks
    of documents, so that a frequent chunk has a row for each block rather than for each document, and each block adds up
    occurrences and documents before they are shuffled."""
    modest_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    schema = "block long, langs array<string>, sources array<string>, groups binary, keys binary, counts binary, chunks array<string>, held array<long>"
    blocks = stash(named.mapInArrow(lambda x: _blocks(x, block), schema), "blocks", "zstd")
    own = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("chunks", "held")).alias("id", "x")).select("of", "id", F.col("x.chunks").alias("chunk"), F.col("x.held").alias("held"))
    distinct = own.groupBy("chunk").agg(F.sum("held").alias("held"))
    cut = distinct.select("chunk", "held", F.regexp_extract_all(F.translate("chunk", _UPPER, _LOWER), F.lit(TERM), F.lit(0)).alias("terms")).where(F.size("terms") > 0)
    cut = stash(cut, "cut", "zstd")
    # a term is in no more documents than its chunks are
    bound = cut.select("held", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("held").alias("held"))
    wanted = stash(bound.where(F.col("held") >= least_docs).select("term"), "wanted")
    joined = own.select("of", "id", "chunk").join(cut.select("chunk", F.explode("terms").alias("term")).join(small(wanted), "term"), "chunk").select("of", "id", "term")
    slim = blocks.select("block", "langs", "sources", "groups", "keys", "counts", F.size("chunks").alias("size"))
    found = slim.groupBy("block").cogroup(joined.groupBy("of")).applyInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers."""
    d = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", d(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), d(total + SMOOTH * terms))
    return F.when(terms > 0, 1 + whole)


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Between each two sources of a language, the absolute differences over the terms of one bucket, added up."""
    base = rows[rows["term"].isna()].sort_values("source")
    held = rows[rows["term"].notna()]
    sources = base["source"].to_numpy()
    term, names = pd.factorize(held["term"])
    shares = np.repeat(base["p"].to_numpy(np.int64)[:, None], len(names), axis=1)
    shares[pd.Index(sources).get_indexer(held["source"]), term] = held["p"].to_numpy(np.int64)
    out = []
    for k in range(len(sources) - 1):
        far = np.abs(shares[k + 1 :] - shares[k]).sum(axis=1)
        out += [(sources[k], s, v) for s, v in zip(sources[k + 1 :], far, strict=True)]
    return pd.DataFrame([(rows["lang"].iloc[0], *x) for x in out], columns=["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, block: int = BLOCK) -> DataFrame:
    """How far each source's shares of a language's terms lie from those of its other sources, and its most typical terms.

    ``docs`` has text, lang and source; other columns are not read. A language keeps the terms in at least ``least_docs`` of
    its documents. Returns (lang, source, part, item, value, rank): part "pair" has every other source of the language and the
    sum of absolute differences of smoothed shares; part "term" has the ``top`` terms whose share exceeds the language's most,
    and by how much. Shares are whole billionths, all arithmetic is exact; ranks go by value descending, then item.

    Nulls in any column read as ''. A row is a document of its own, also if it repeats another's id. Texts without terms
    count for their group, which then has smoothed shares only. A language that keeps no term has pairs of value 0 and no
    part "term"; one with a single source has no pairs. Texts of any length are cut whole; a text longer than a block is a
    block of its own. An empty table gives no rows."""
    spark = docs.sparkSession
    counts = stash(term_counts(docs, least_docs, block), "counts", "zstd")
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    own = stash(counts.select("lang", "source", "term", F.col("n").alias("own")).join(kept, ["lang", "term"]), "own")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(langs, "lang", "left").join(own.groupBy("lang", "source").agg(F.sum("own").alias("total")), ["lang", "source"], "left").fillna(0)
    groups = stash(groups, "groups")
    cells = groups.groupBy("lang").agg((F.count("*") * F.max("v")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    buckets = partitions(spark) + cells // CELLS

    shares = own.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("own"), F.col("total"), F.col("v")).alias("p"), _share(F.col("n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    # every task gets all sources of its language with the share of a term that they lack, and the terms of a bucket
    base = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "source", F.lit(None).cast("string").alias("term"), F.coalesce(_share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).alias("p"))
    rows = base.unionByName(shares.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "source", "term", "p"))
    near = rows.groupBy("lang", "bucket").applyInPandas(_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = near.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", by).unionByName(terms.withColumn("rank", by).where(F.col("rank") <= top))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, terms of 30 documents at least."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), own AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms
) WHERE rank <= 50
"""
