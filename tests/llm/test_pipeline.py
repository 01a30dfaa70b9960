"""The pipeline, stage by stage, against brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_operators import brute_components, brute_lines, edited, sentence, sets
from tracery.llm import packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, predicted double, n_lines string"
ITEMS = [sentence(700 + k, 30 + k) for k in range(4)]


def prose(seed, n=60):
    words = sentence(seed, n).split()
    return "\n".join(" ".join(words[a : a + 12]).capitalize() + "." for a in range(0, n, 12))


def fixture_rows():
    hot = "A line that very many documents have in common."
    texts = [prose(k) for k in range(60)]
    texts += [f"{hot}\n{prose(100 + k)}\n{hot}" for k in range(15)]
    texts += [edited(texts[3], 40), texts[5], texts[5].upper(), edited(texts[6], 1, 30), prose(200, 600) + " " + ITEMS[0], edited(ITEMS[1], 0), f"{prose(201)}\n{ITEMS[2]}", prose(202, 5000)]
    texts += [" ".join(w.upper() + "!!" for w in sentence(400 + k, 40).split()) for k in range(40)]
    texts += [None, "", " \n\t\n"]
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t) if t else None, "clash", None, "own") for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, prose(300), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rows = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    labels = [(r[0], int("!!" not in (r[1] or "!!")), 0) for r in rows if r[0] is not None and r[0] % 7] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (9, None), (None, "x")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def key(row):
    return tuple(repr(x) for x in row)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted(map(tuple, docs.collect()), key=key)
    accepted = {(r["doc_id"], r["text"]): r["predicted"] for r in quality.score_quality(docs.drop("predicted", "n_lines"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    steps = dict(corpus_pipeline.STAGES)

    # 5: rejected documents go, all others stay as they are
    docs = spark.createDataFrame(steps["quality"](spark, docs, folder).collect(), SCHEMA)
    rows = [r for r in rows if accepted[r[0], r[1]]]
    assert sorted(map(tuple, docs.collect()), key=key) == rows
    assert not any("!!" in (r[1] or "") for r in rows)
    assert sum(r[0] is not None and r[0] < 75 for r in rows) == 76

    # 2: lines that a smaller doc_id has go
    docs = spark.createDataFrame(steps["line dedup"](spark, docs, folder).collect(), SCHEMA)
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts[r[0]] = r[1]
    order = sorted(texts)
    brute = brute_lines([texts[d] for d in order])
    kept = {d: brute[k][0] for k, d in enumerate(order)}
    rows = sorted(((r[0], kept.get(r[0], r[1]), *r[2:4], len(kept.get(r[0], r[1])), *r[5:]) for r in rows), key=key)
    assert sorted(map(tuple, docs.collect()), key=key) == rows

    # 1: one document of each group stays
    docs = spark.createDataFrame(steps["near duplicates"](spark, docs, folder).collect(), SCHEMA)
    order = sorted({r[0] for r in rows if r[0] is not None})
    own = {r[0]: r[1] for r in rows}
    roots = brute_components([own[d] for d in order], 5, 80)
    first = {d: order[roots[k][1]] for k, d in enumerate(order)}
    before = len(rows)
    rows = [r for r in rows if r[0] is None or first[r[0]] == r[0]]
    assert len(rows) < before
    assert sorted(map(tuple, docs.collect()), key=key) == rows

    # 7: documents with a window like an item go
    docs = spark.createDataFrame(steps["decontamination"](spark, docs, folder).collect(), SCHEMA)

    def leaks(text):
        words = (text or "").lower().split()
        for item in ITEMS:
            (wanted,) = sets([item], 5)
            n = len(item.split())
            for a in range(max(len(words) - n, 0) + 1):
                window = {tuple(words[i : i + 5]) for i in range(a, min(a + n, len(words)) - 4)}
                if window and len(window & wanted) >= 0.8 * len(window | wanted):
                    return True
        return False

    before = len(rows)
    rows = [r for r in rows if r[0] is None or not leaks(r[1])]
    assert before - len(rows) == 3
    assert sorted(map(tuple, docs.collect()), key=key) == rows

    # 8: every id of every document that is left lies in one piece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    packed = steps["packing"](spark, docs, folder).collect()
    expected = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in rows if len(r[1] or "") < 3000)
    whole = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"]) for r in packed if r["length"] == r["doc_tokens"])
    assert set(whole) <= set(expected) | {w for w in whole if w[0] in {r[0] for r in rows if len(r[1] or "") >= 3000}}
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in packed) == total

    # the whole run gives what the stages give one after the other
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(key, found)) == sorted(map(key, packed))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
