"""Importance resampling and the source audit against brute force, with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import sentence
from tracery.llm import importance, source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_span_crcs():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 60_000).astype(np.uint8)
    size = np.concatenate([r.integers(1, 65, 800), r.integers(60, 500, 100), [1, 63, 64, 65, 127, 128, 129, 30_000]])
    begin = (r.random(len(size)) * (len(data) - size)).astype(np.int64)
    assert importance.span_crcs(data, begin, size).tolist() == [zlib.crc32(data[b : b + s].tobytes()) for b, s in zip(begin, size, strict=True)]
    assert len(importance.span_crcs(data, begin[:0], size[:0])) == 0


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent=5, least=20):
    found = [(doc, *brute_features(text)) for doc, text in rows]
    s, t = Counter(b for _, _, own in found for b in own), Counter(b for text in target for b in brute_features(text)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for doc, words, own in found:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((doc, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = percent * len(able) // 100
    return sorted([(*x, k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x, None) for x in out if x[1] < least], key=repr)


def rows_of(texts):
    rows = list(enumerate(texts))
    return [*rows, rows[0], rows[0], (3, "another text of this id " * 9), (None, sentence(9, 40)), (None, None)]


@pytest.mark.parametrize("percent", [5, 60])
def test_importance_resample(spark, percent):
    target = [sentence(k, 50) for k in range(4)] + [None, ""]
    texts = [sentence(k, 25 + k) for k in range(60)] + [" ".join(["same words"] * 12)] * 5
    texts += [None, "", " \t", "one", "Ünï 123 ABC-def_x", "w" * 5000 + " b " + "é" * 900, sentence(77, 30_000), "a b c\nd,e;f" * 4, " x　y " * 12]
    rows = rows_of(texts)
    df = spark.createDataFrame([(d, t, "clash", 1.5, "own") for d, t in rows], "doc_id long, text string, rank string, score double, bucket string")
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, weight string")
    found = importance.importance_resample(df.repartition(3), goal, percent)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_resample(rows, target, percent)


def test_importance_resample_of_nothing(spark):
    empty, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(k, sentence(k, 30)) for k in range(40)], "doc_id long, text string")
    assert importance.importance_resample(empty, some).count() == 0
    assert sorted(map(tuple, importance.importance_resample(some, empty).collect()), key=repr) == brute_resample([tuple(r) for r in some.collect()], [])


def test_op13_registered(spark, tmp_path):
    rows = rows_of([sentence(k, 30) for k in range(50)])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(3, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = importance.op13_importance_resample(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((d, n, w, s, r) for d, _, n, w, s, r in brute_resample(rows, [sentence(3, 60)])), key=repr)
    assert {t for _, t in found.dtypes} == {"bigint"}


def brute_audit(rows, least, top=50):
    docs = [(la or "", so or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for t, la, so in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        df = Counter(t for x in own for t in x[2])
        kept = sorted(t for t in df if df[t] >= least)

        def shares(counters, kept=kept):
            n = Counter()
            for c in counters:
                n.update(c)
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        _, q = shares([x[2] for x in own])
        groups = {s: shares([x[2] for x in own if x[1] == s]) for s in {x[1] for x in own}}
        for s, (n, p) in groups.items():
            pairs = [(sum(abs(p[t] - p2[t]) for t in kept), s2) for s2, (_, p2) in groups.items() if s2 != s]
            terms = [(p[t] - q[t], t) for t in kept if n[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audit_rows():
    rows = [(f"{sentence(k % 7, 25)} the-the The, (the) it's {'Ünï' * (k % 3)}", ("en", "de")[k % 2], f"s{k % 5}") for k in range(90)]
    rows += [(None, "en", "s1"), ("", None, None), (" \n\t", "fr", None), ("12 34 !?", "fr", "b"), ("A B　c \x1ca", "fr", "b"), (None, None, "x"), ("the " * 4000 + "z" * 20_000, "en", "long")]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize(("least", "block"), [(3, 300), (30, 4 << 20), (1, 50)])
def test_source_divergence(spark, monkeypatch, least, block):
    monkeypatch.setattr(source_audit, "CELLS", 20)
    rows = audit_rows()
    df = spark.createDataFrame([(*r, "clash", 7, "own") for r in rows], "text string, lang string, source string, term string, n int, part string").repartition(7)
    found = source_audit.source_divergence(df, least, block=block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, least)


def test_source_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.source_divergence(df).count() == 0


def test_each_chunk_is_cut_once(spark):
    df = spark.createDataFrame([("a-b a-b x", "en", "s"), ("a-b", "en", "t")] * 50, "text string, lang string, source string")
    found = source_audit.term_counts(df, block=10)
    assert {tuple(r) for r in found.collect()} == {("en", "s", "a", 100, 50), ("en", "s", "b", 100, 50), ("en", "s", "x", 50, 50), ("en", "t", "a", 50, 50), ("en", "t", "b", 50, 50)}
    assert found.agg(F.sum("n")).first()[0] == 350
