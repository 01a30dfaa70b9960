"""From raw documents to packed training sequences: five stages, each by one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.common import small, stash, table
from tracery.llm.decontaminate import find_leaks
from tracery.llm.line_dedup import drop_lines, line_bitmaps
from tracery.llm.ngram_join import ngram_jaccard_join
from tracery.llm.packing import pack_documents
from tracery.llm.quality import score_quality


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that an operator would replace under other names, and how to name them back."""
    taken = {c: f"_own_{c}" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; nulls and empty texts are scored like any other."""
    own, back = _aside(docs, "held_out", "score", "predicted")
    scored = score_quality(own, table(spark, sf_dir, "labels")).where("predicted = 1")
    return scored.drop("held_out", "score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id has; a document may end up empty, but stays. n_chars is counted anew."""
    own, back = _aside(docs, "n_lines", "n_dropped")
    cut = drop_lines(own, line_bitmaps(own)).drop("n_lines", "n_dropped").withColumnsRenamed(back)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of five-word sets at 80 percent; documents without words or id all stay. Rows that
    repeat a doc_id are one document: they stay or go together."""
    found, _ = ngram_jaccard_join(docs, words=5, percent=80)
    gone = stash(found.where("doc_id <> component_id").select("doc_id"), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = stash(find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(small(leaks), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 2048 tokens."""
    return pack_documents(docs, 2048)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the classifier, the fingerprints or the packing; the stages and run() are tested against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name.replace(" ", "-"))
    return docs
