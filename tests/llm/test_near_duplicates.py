"""HyperMinHash near duplicates, and repeated rows in the n-gram join, against brute force."""

import numpy as np
import pandas as pd
import pytest

from test_operators import BASE, TEXTS, brute_components, docs, edited, sentence, sets
from tracery.llm import minhash, ngram_join


def group(seed, words, copies):
    """Copies of a text, each with a few words changed, some further away than the limit."""
    r = np.random.default_rng(seed)
    base = sentence(seed, words)
    return [base, *[edited(base, *r.choice(words, r.integers(1, max(2, words // 9)), replace=False)) for _ in range(copies)]]


@pytest.mark.parametrize(("words", "percent", "wide"), [(2, 80, 4096), (5, 80, 3), (2, 90, 1)])
def test_near_duplicates(spark, words, percent, wide):
    texts = TEXTS + group(11, 60, 30) + group(12, 400, 25) + group(13, 12, 20) + group(14, 2000, 6)
    texts += [f"{sentence(900, 60)} {sentence(1000 + k, 60)}" for k in range(25)] + [sentence(100 + k, 30) for k in range(10)]
    # small sets, all close to each other
    texts += [" ".join(w for j, w in enumerate(sentence(300 + k, 9).split()) if j != drop) for k in range(8) for drop in (99, 0, 8, 4)]
    found, links = minhash.near_duplicates(docs(spark, *texts), words, percent, wide)
    rows = found.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    s = sets(texts, words)
    for r in links.collect():
        both = len(s[r["a"]] & s[r["b"]])
        assert r["common"] == both and 100 * both >= percent * len(s[r["a"]] | s[r["b"]])


@pytest.mark.parametrize("join", [ngram_join.ngram_jaccard_join, minhash.near_duplicates])
def test_repeated_ids(spark, join):
    half = f"{' '.join(BASE.split()[:90])} {sentence(50, 30)}"
    # the same text twice under either id: they share half of their n-grams and no link
    found = join(docs(spark, BASE, BASE, half, half, edited(half, 3), ids=[1, 1, 2, 2, 3]), 4, 85)[0]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == [(1, 117, 1), (2, 117, 2), (3, 117, 2)]
    # different texts under one id: its largest set alone is compared
    long = sentence(51, 200)
    rows = [(1, BASE), (1, long), (2, BASE), (2, BASE), (3, edited(long, 5)), (3, "one two"), (4, long), (4, long), (5, None), (5, BASE)]
    found = join(docs(spark, *[t for _, t in rows], ids=[i for i, _ in rows]), 4, 85)[0]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == [(1, 197, 1), (2, 117, 2), (3, 197, 1), (4, 197, 1), (5, 117, 2)]


def test_near_duplicates_without_ids_or_rows(spark):
    found, _ = minhash.near_duplicates(docs(spark, BASE, "one two", BASE, None, ids=[None, None, 3, 4]), 4)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["kept"]) for r in found.collect()) == [(-1, 1, True), (-1, 117, True), (3, 117, True), (4, 0, True)]
    assert minhash.near_duplicates(docs(spark, "x").limit(0))[0].count() == 0


def test_unlinked_pairs_of_a_key_leave_it_by_documents():
    """40 texts at about the limit from each other: many pairs meet, and no more rows than documents go on to be confirmed."""
    texts = [edited(sentence(60, 120), *range(k, 120, 24)) for k in range(24)] + [edited(sentence(60, 120), *range(k, 120, 20)) for k in range(16)]
    grams, text = ngram_join._sets(texts, 2)
    n = np.bincount(text)
    regs = minhash.registers(grams, text, len(texts))
    keys = minhash._all_keys(regs, n, 80)
    # the first column in which many have one key: those pairs come with it
    groups = [np.unique(c[c != 0], return_counts=True) for c in keys.T]
    column = next(k for k, (_, counts) in enumerate(groups) if len(counts) and counts.max() > 15)
    key = groups[column][0][groups[column][1].argmax()]
    at = np.flatnonzero(keys[:, column] == key)
    rows = pd.DataFrame({"key": key, "p": 0, "q": 0, "part": 0, "id": at, "n": n[at], "root": at, "regs": [regs[k].tobytes() for k in at]})
    assert len(minhash._meet(rows, 80)) <= len(rows)


def test_estimates():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 56, 20_000).astype(np.uint64)
    for n, part in ((50, 0.8), (400, 0.8), (5000, 0.5), (5000, 0.0)):
        far = []
        for k in range(60):
            common = int(round(2 * n * part / (1 + part)))
            a = r.permutation(pool)
            x, y = a[:n], np.concatenate([a[:common], a[n : 2 * n - common]])
            regs = minhash.registers(np.concatenate([x, y]), np.repeat([0, 1], [n, n]), 2)
            found, error = minhash.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]), max(part, 0.2))
            far.append((found[0] - common / (2 * n - common)) / max(error[0], 0.01))
        assert abs(np.mean(far)) < 0.5 and max(map(abs, far)) < 4.5
    assert minhash.registers(pool[:0], np.zeros(0, np.int64), 1).tolist() == [[minhash.EMPTY] * minhash.REGISTERS]


def test_levels_cover_pairs_at_the_limit():
    for percent in (80, 90):
        steps = minhash.levels(percent)
        for n in range(1, 200):
            own = next(k for k, (s, _) in enumerate(steps) if n <= s)
            largest = n * 100 // percent
            other = next(k for k, (s, _) in enumerate(steps) if largest <= s)
            assert other - own <= 1


def test_op11_on_given_documents(spark):
    """Every group of the given table that brute force finds among candidates by any shared rare n-gram."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = table.collect()
    want = brute_components([r["text"] for r in rows], 2, 80)
    found = minhash.op11_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    place = {r["doc_id"]: k for k, r in enumerate(rows)}
    assert {place[r["doc_id"]]: (r["n_shingles"], place[r["component_id"]]) for r in found} == want
