"""Each operator against brute force or planted cases, with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.llm import common, decontaminate, html_extract, license_scan, line_dedup, ngram_join, packing, quality, suffix_dedup, topk_search, toxicity
from tracery.llm.shingles import word_hashes

SCHEMA = "doc_id long, text string, n long, score double, start int, key string"


def docs(spark, *texts, ids=None):
    rows = [(i, t, 1, 0.5, 7, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(n))


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = "changed"
    return " ".join(words)


BASE, OTHER = sentence(1, 120), sentence(2, 150)
TEXTS = [BASE, BASE.upper(), edited(BASE, 5), edited(BASE, 5, 90), edited(BASE, 20, 40, 60, 80), None, "", "  \n\t", "one two", "one  TWO", OTHER, edited(OTHER, 149), sentence(3, 3000), "é ü", BASE]


def sets(texts, words):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_components(texts, words, percent):
    s = sets(texts, words)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in range(len(s))}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, words, percent):
    hub = [edited(BASE, *places) for places in [(1,), (30,), (60, 61), (100, 20), (2, 50, 77), (9, 29, 49, 69)]]
    texts = TEXTS + hub + [sentence(100 + k, 30) for k in range(10)]
    found, links = ngram_join.ngram_jaccard_join(docs(spark, *texts), words, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_components(texts, words, percent)
    s = sets(texts, words)
    for r in links.collect():
        assert r["common"] == len(s[r["a"]] & s[r["b"]])


def test_ngram_join_without_ids_or_rows(spark):
    found, _ = ngram_join.ngram_jaccard_join(docs(spark, BASE, "one two", BASE, ids=[None, None, 3]))
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found.collect()) == [(-1, 1), (-1, 117), (3, 117)]
    assert ngram_join.ngram_jaccard_join(docs(spark, "x").limit(0))[0].count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3)]
    found = common.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r["id"]: r["root"] for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_lines(texts):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    where = {}
    for d, t in enumerate(texts):
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(where[key(x)]) > 1 and min(where[key(x)]) < d)]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(spark):
    hot = "a line that everybody has"
    texts = [f"{hot}\nown {i}\n\nshort\nshort\n{hot.upper()} \nlines of pair {i // 2}" for i in range(40)] + [None, "", "\n", "éééééééééé\nx", " éééééééééé\t", "only\n" + hot]
    df = docs(spark, *texts)
    found = line_dedup.drop_lines(df, line_dedup.line_bitmaps(df)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found} == brute_lines(texts)
    assert found[0]["key"] == "x"


def test_line_dedup_of_long_texts_and_clashing_columns(spark):
    lines = [f"line number {k % 900} of a very long text" for k in range(20_000)]
    texts = ["\n".join(lines[:1000]), "\n".join(lines), "x" * 300_000 + "\n" + lines[5]]
    df = docs(spark, *texts).withColumn("n_lines", F.lit("clash")).withColumn("version", F.lit(3)).withColumn("keep", F.lit("own"))
    found = line_dedup.drop_lines(df, line_dedup.line_bitmaps(df)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found} == brute_lines(texts)
    assert {(r["version"], r["keep"]) for r in found} == {(3, "own")}


def test_line_dedup_repeated_rows(spark):
    df = docs(spark, "a long line of text\nb", "a long line of text\nb", "a long line of text", ids=[4, 4, None])
    found = line_dedup.drop_lines(df, line_dedup.line_bitmaps(df)).collect()
    assert [r["n_dropped"] for r in found] == [0, 0, 0]
    empty = docs(spark, "x").limit(0)
    assert line_dedup.drop_lines(empty, line_dedup.line_bitmaps(empty)).count() == 0


def test_bitmap_round_trip():
    assert line_dedup.unpack_bits(11, line_dedup.pack_bits(11, [0, 10])).tolist() == [False] + [True] * 9 + [False]


def test_topk(spark):
    r = np.random.default_rng(4)
    vectors = r.standard_normal((400, 64))
    vectors[50:90] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, [1.0] * 3), (None, vectors[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.topk_search(df, df.where("vec_id % 20 = 0"), 10).collect()
    bits = vectors > 0
    for q in range(0, 400, 20):
        d = (bits != bits[q]).sum(axis=1)
        expected = sorted((int(d[i]), i) for i in range(400) if i != q)[:10]
        assert [(x["distance"], x["neighbor_id"]) for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == q] == expected
    assert {x["query_id"] for x in found} == set(range(0, 400, 20))
    assert topk_search.topk_search(df.limit(0), df.limit(0)).count() == 0


def test_topk_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_CODES", 60)
    monkeypatch.setattr(topk_search, "LEAST_CODES", 20)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(11)
    vectors = r.standard_normal((500, 64))
    vectors[100:200] = vectors[100] + 0.3 * r.standard_normal((100, 64))
    vectors[300:330] = vectors[300]
    df = spark.createDataFrame([(i, v.tolist(), 9) for i, v in enumerate(vectors)] + [(20, vectors[300].tolist(), 9), (20, vectors[20].tolist(), 9)], "vec_id long, embedding array<double>, bound long")
    found = topk_search.topk_search(df, df.where("vec_id % 20 = 0"), 10).collect()
    bits = np.concatenate([vectors, vectors[300:301]]) > 0
    ids = [*range(500), 20]
    for q in range(0, 500, 20):
        least = {}
        for own in [k for k, i in enumerate(ids) if i == q]:
            for k, d in enumerate((bits != bits[own]).sum(axis=1).tolist()):
                if ids[k] != q:
                    least[ids[k]] = min(d, least.get(ids[k], 65))
        expected = sorted((d, i) for i, d in least.items())[:10]
        assert [(x["distance"], x["neighbor_id"]) for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == q] == expected


def test_index_compares_codes_of_one_segment_piece_by_piece(monkeypatch):
    """Codes that are alike in all segments but one all meet at once; they are compared in bounded memory."""
    monkeypatch.setattr(topk_search, "MEETINGS", 1 << 16, raising=False)
    codes = np.arange(0, 40_000, 2, dtype=np.uint64)
    queries = np.concatenate([codes[:200], np.random.default_rng(2).integers(0, 1 << 62, 20).astype(np.uint64)])
    index = topk_search.MultiIndex(codes)
    tracemalloc.start()
    q, c, d = index.search(queries, 11, np.ones(len(codes), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    for k in range(0, len(queries), 10):
        far = np.bitwise_count(codes ^ queries[k]).astype(int)
        near = np.flatnonzero(far <= np.sort(far)[10])
        assert sorted(c[q == k].tolist()) == near.tolist() and (d[q == k] == far[c[q == k]]).all()


PAGE = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; more&am</h1><p><b>First <i>li</i>ne<br>goes on.<p>{}</p></article><footer>&copy; us</footer></body></html>'


def test_html(spark):
    body = sentence(8, 60) + "."
    rows = [(i, "u", PAGE.format(body), "clash", 3) for i in range(30)] + [(90, None, None, None, None), (91, "u", "", "", 0), (92, "u", PAGE.format(body)[:400], "", 0), (93, "u", "plain", "", 0)]
    found = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()}
    assert found[3]["text"] == f"Head & more&am First line goes on. {body}"
    assert found[3]["n_chars"] == len(found[3]["text"])
    assert (found[90]["text"], found[91]["text"], found[90]["n_chars"]) == ("", "", 0)
    assert found[92]["text"].startswith("Head & more&am First")
    assert html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").limit(0)).count() == 0


def test_html_layouts():
    crf = html_extract.ChainCRF(html_extract.labelled_pages([PAGE.format(sentence(k, 50)) for k in range(20)]))
    wrong = total = 0
    for layout in html_extract.LAYOUTS:
        page = re.sub(r"\{([psw])\}", lambda m: {"p": sentence(77, 50) + ".", "s": sentence(78, 9) + ".", "w": sentence(79, 2)}[m[1]], layout)
        blocks = html_extract.leaf_blocks(page)
        labels = crf.viterbi([crf.emission(html_extract.path_features(b.path) + html_extract.text_features(b, k / len(blocks))) for k, b in enumerate(blocks)])
        wrong += sum(x != (b.label or 0) for x, b in zip(labels, blocks, strict=True))
        total += len(blocks)
    assert wrong / total < 0.05


@pytest.mark.parametrize("page, texts", [
    ('<p>one<svg class="i"/>two</p><article><p>three</article>', ["onetwo", "three"]),
    ("<nav><button>menu</nav><article><p>one <button>share</button>two<p>three</article>", ["menu", "one two", "three"]),
    ("<body><select><option>a<article><p>one<p>two</article></body>", ["a", "one", "two"]),
    ("<p>a<svg><svg>x</svg>y<title>t</title></svg>b</p>", ["ab"]),
    ("<p>a <object><div>x<object><p>y</object><p>z</div></object>b</p><p>c", ["a b", "c"]),
    ("<p>a<button><div>x<p>y</button>b<noscript><p>n</noscript></p>c", ["ab", "c"]),
    ("<svg><style/><script/></svg>a<script>b</script>c", ["ac"]),
    ("a<a href=x>l<canvas>no</canvas></a>b</svg>c</button>", ["albc"]),
])
def test_hidden_elements(page, texts):
    assert [b.text for b in html_extract.leaf_blocks(page)] == texts


def labelled_docs(spark):
    good = [sentence(200 + k, 80).capitalize() + "." for k in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(400 + k, 40).split()) for k in range(60)]
    texts = [*good, *bad, None, "", "x" * 50_000]
    return docs(spark, *texts), spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 1, 0), (500, None, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    df, labels = labelled_docs(spark)
    found = quality.score_quality(df, labels).collect()
    assert len(found) == df.count()
    for r in found:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 180]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] < 120) for r in held) / len(held) > 0.95
    assert {r["score"] for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), labels).count() == 0


def test_toxicity(spark):
    insults = ["idiot", "stupid", "worthless"]
    clean = [sentence(600 + k, 60) for k in range(120)]
    toxic = [sentence(800 + k, 30) + f". {sentence(k, 1)} {insults[k % 3]} {insults[(k + 1) % 3]}. " + sentence(900 + k, 30) for k in range(60)]
    odd = [sentence(5, 40) + " st.upid idi-ot here. " + sentence(6, 20), sentence(7, 40) + ". an i d i o t and stupiid", "nothing to see", None, ""]
    df = docs(spark, *clean, *toxic, *odd)
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(180)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [r for r in found.values() if r["held_out"] and r["doc_id"] < 180]
    assert sum(r["predicted"] == (r["doc_id"] >= 120) for r in held) / len(held) > 0.95
    assert found[180]["score"] > 0.5
    assert found[181]["score"] > 0.5
    assert all(found[i]["score"] < 0.5 for i in (182, 183, 184))
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0


def test_kernel_tolerates_gaps():
    kernel = toxicity.Kernel(["idiot"])
    same, gap, other = kernel.similarity(["idiot", "idxiot", "banana"])[:, 0]
    assert same == pytest.approx(1)
    assert gap > 0.4 > other


@pytest.mark.parametrize("insult, written", [("scum", "sxcxum"), ("fool", "fxoxol"), ("idiot", "idxxiot")])
def test_two_inserted_characters_count(insult, written):
    at, rows = toxicity.WordMachine([insult]).rows([written, "walk"])
    assert at.tolist() == [0]
    assert rows[0, 0] >= toxicity.FLOOR**2


def slow_kernel(a, b):
    """All subsequences of three characters with their gaps, one by one."""

    def weights(word):
        word, out = f"\2{word}\3", Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, len(word)):
                    if k - i - 2 <= toxicity.SKIPS:
                        out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    return sum(x[c] * y[c] for c in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_against_all_subsequences():
    landmarks = ["idiot", "scum", "worthless"]
    words = ["idxxiot", "sxcxum", "banana", "a" * 20, "worth", "idiotidiotidiot", "aba", "ab", "tulip"]
    kernel = toxicity.Kernel(landmarks)
    expected = np.array([[slow_kernel(w, x) for x in landmarks] for w in words])
    assert kernel.similarity(words) == pytest.approx(expected, abs=1e-5)
    known = kernel.similarity(words, 0.3)
    assert (expected[known.max(axis=1) == 0].max(axis=1) < 0.3 + 1e-6).all()
    long = "x" * 60 + "idiot" + "y" * 60
    assert kernel.similarity([long, "idiot"])[1, 0] == pytest.approx(1)
    assert 0 < kernel.similarity([long])[0, 0] < 0.3


def test_svm_finds_the_least_loss():
    r = np.random.default_rng(1)
    x, up, down = r.standard_normal((80, 5)), r.integers(0, 3, 80).astype(float), r.integers(0, 3, 80).astype(float)
    w, b = toxicity.fit_svm(x, up, down, 50.0)

    def loss(w, b):
        f = x @ w + b
        return (w @ w + 1e-3 * b * b) / 2 + 25 / up.sum() * (up * np.maximum(0, 1 - f) ** 2).sum() + 25 / down.sum() * (down * np.maximum(0, 1 + f) ** 2).sum()

    assert all(loss(w, b) <= loss(w + 0.01 * r.standard_normal(5), b + 0.01 * r.standard_normal()) for _ in range(200))


def decided(landmarks):
    own = toxicity.WordMachine(landmarks, np.eye(1, len(landmarks))[0])
    own.bias = -0.1
    return own


def test_toxicity_takes_all_sentences_and_words():
    own = decided(["idiot", "grape"])
    signs = ["", *",;:()[]'\""]
    forms = [f"{a}idiot{b}" for a in signs for b in signs]
    texts = [" ".join(["grape walk."] * 500 + forms), "You idiot idxiot. Idiot here!\nAn idiot", "nothing", "", "i d i o t"]
    n = len(toxicity.STEPS)
    found = own.features(texts)
    assert found[0, n] == pytest.approx(np.log1p(len(forms)))
    each = toxicity.Kernel(["idiot"]).similarity(["idxiot"])[0, 0] ** 2 - 0.1
    assert found[1, -1] == pytest.approx(np.log1p(0.9 + each), abs=1e-5)
    assert found[1, n : 2 * n] == pytest.approx([np.log1p(3 * min((0.9 - s) / 0.2, 1) + np.clip((each - s) / 0.2, 0, 1)) for s in toxicity.STEPS], abs=1e-5)
    assert (found[2:4, :-2] == 0).all()
    assert found[4, n] == pytest.approx(np.log1p(1))


def test_similarities_to_landmarks_take_no_table_of_all():
    """Brute force over all subsequences of a word, and memory that doesn't grow with landmarks times subsequences."""
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in r.integers(0, 9, r.integers(1, 20))) for _ in range(4096)]
    landmarks = list(dict.fromkeys(w for w in words if 5 <= len(w)))[: toxicity.LANDMARKS]

    def vector(word):
        out, w = {}, f"\2{word}\3"
        for a in range(1, toxicity.SKIPS + 2):
            for b in range(1, toxicity.SKIPS + 3 - a):
                for k in range(len(w) - a - b):
                    key = w[k] + w[k + a] + w[k + a + b]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (a + b - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    kernel = toxicity.Kernel(landmarks)
    tracemalloc.start()
    found = kernel.similarity(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    others = [vector(w) for w in landmarks]
    for k in range(60):
        own = vector(words[k])
        assert np.allclose(found[k], [sum(v * o.get(c, 0) for c, v in own.items()) for o in others], atol=1e-5)


def test_toxic_words_that_end_sentences_count_alike():
    again = decided(["idiot"])
    again.features(["an idiot here"])
    for own in (decided(["idiot"]), again):
        first, second = own.features(["What an idiot. All is well? idi-ot!\n\nBye now.", "What an idiot now. All is well? idi-ot!\n\nBye"])
        assert first.tolist() == second.tolist()


def test_toxicity_edges(spark):
    words = sentence(3, 400)
    texts = [f"{sentence(k, 20)} idiot stupid" if k % 3 == 0 else sentence(k, 20) for k in range(60)] + [None, "", "x " * 200_000, f"{words} idiot {words}"]
    df = docs(spark, *texts, *texts[:2], ids=[*range(62), None, 63, 0, 1]).withColumn("held_out", F.lit("old")).withColumn("predicted", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1), (3, 0)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(df, labels).collect()
    assert len(found) == len(texts) + 2
    assert len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert {r["score"] for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score_toxicity(df, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = common.table(spark, folder, "labels").select("doc_id", "toxic")
    texts = common.table(spark, folder, "documents").select("doc_id", "lang", F.lower("text").alias("text"))
    found = toxicity.op9_toxicity(spark, folder).where("held_out").join(labels, "doc_id").join(texts, "doc_id").toPandas()
    toxic, hit = found["toxic"] == 1, found["predicted"] == 1
    assert (toxic & hit).sum() / hit.sum() > 0.93
    assert (toxic & hit).sum() / toxic.sum() > 0.87
    # English documents that are labelled toxic but hold no insult are noise
    insult = found["text"].str.contains("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron")
    assert (hit & insult).sum() / (toxic & insult).sum() > 0.97
    for lang in ("en", "de", "fr", "es"):
        own = toxic & (found["lang"] == lang)
        assert (own & hit).sum() / own.sum() >= 0.8


def test_toxicity_is_the_same_for_any_order(spark):
    insults = ["idiot", "stupid", "worthless"]
    texts = [sentence(600 + k, 60) for k in range(60)] + [sentence(800 + k, 30) + f". You {insults[k % 3]}. " + (f"{insults[(k + 1) % 3]} here" if k % 2 else "") for k in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(100)], "doc_id long, quality int, toxic int")
    df = docs(spark, *texts)
    scores = []
    for own in (df.repartition(1, "doc_id").sortWithinPartitions("doc_id"), df.repartition(1, "doc_id").sortWithinPartitions(F.desc("doc_id")), df.repartition(7, "text")):
        toxicity._MACHINES.clear()
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(own, labels).collect()})
    assert scores[0] == scores[1] == scores[2]


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out[k] = (len(d), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [3000, 2])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", most)
    passage = sentence(5, 90)
    texts = [sentence(20 + k, 40) + passage[k : 330 + k] + sentence(60 + k, 30) for k in range(8)]
    texts += [BASE, BASE, edited(BASE, 60), None, "", "a" * 700, "ab" * 400, "é" * 150, sentence(6, 80) + sentence(6, 80), passage[:199], passage[:200], "short"]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs(spark, *texts), 200).collect()}
    assert found == brute_removed(texts, 200)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.remove_repeats(docs(spark, "x").limit(0)).count() == 0
    found = suffix_dedup.remove_repeats(docs(spark, BASE, ids=[None])).first()
    assert (found["doc_id"], found["n_removed"]) == (None, 0)


def test_suffix_dedup_takes_each_row_as_a_document(spark):
    texts = [BASE, BASE, OTHER, sentence(40, 60) + BASE[:250], sentence(41, 60), sentence(42, 30_000) + OTHER[:230]]
    df = docs(spark, *texts, ids=[1, 1, 2, 2, 2, 3]).withColumn("version", F.lit("clash")).withColumn("n_bytes", F.lit(None))
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df, 200).collect())
    brute = brute_removed(texts, 200)
    assert found == sorted((d, brute[k][0], brute[k][1], brute[k][3]) for k, d in enumerate([1, 1, 2, 2, 2, 3]))


@pytest.mark.parametrize("most", [3000, 2])
def test_suffix_dedup_with_one_string_in_most_rows(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", most)
    passage = sentence(50, 45)
    texts = [sentence(100 + k, 20) + passage + sentence(100 + k // 3, 20) for k in range(40)] + [sentence(300 + k, 50) for k in range(10)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs(spark, *texts), 200).collect()}
    assert found == brute_removed(texts, 200)


def test_minimizers_depend_on_the_window_alone(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 101, 4000).astype(np.uint8)
    of = suffix_dedup.Rolling.of
    # hashes that differ in their lowest bits only
    monkeypatch.setattr(suffix_dedup.Rolling, "of", lambda self, a, b: of(self, a, b) >> np.uint64(60))
    at, _, first, last, _ = suffix_dedup.minimizers(data, np.array([0]), np.array([4000]), 200, 50)
    hashes = suffix_dedup.Rolling(data).of(np.arange(3951), np.arange(3951) + 50)
    owner = {w: int(p) for p, a, b in zip(at, first, last, strict=True) for w in range(a, b + 1)}
    assert owner == {w: w + int(np.argmin(hashes[w : w + 151])) for w in range(3801)}


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    s = r.integers(1, 4, r.integers(1, 200))
    s = np.append(np.tile(s, 1 + seed % 4), 0)
    sa = suffix_dedup.suffix_array(s, 258)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    lcp = suffix_dedup.permuted_lcp(s.astype(np.uint8), sa, 50)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        n = 0
        while n < 50 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert lcp[b] == n


def test_leaks(spark):
    items = [sentence(30, 40), sentence(31, 12), "tiny item", None, "", sentence(32, 60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{BASE} {items[0].upper()} {OTHER}", items[1], BASE, f"x {edited(items[5], 0)} y", f"{items[0]} {items[0]}", None, "", "a tiny item here", sentence(32, 30)]
    found = decontaminate.find_leaks(docs(spark, *texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in found) == [(0, 0, 120), (1, 1, 0), (3, 5, 1), (4, 0, 0), (4, 0, 40)]
    assert decontaminate.find_leaks(docs(spark, "x").limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, "x"), bench.limit(0)).count() == 0


def test_leaks_against_all_windows(spark):
    r = np.random.default_rng(5)
    vocabulary = sentence(77, 60).split()
    items = [" ".join(r.choice(vocabulary, n)) for n in (6, 9, 14, 20, 33)] + ["aa bb aa bb aa bb aa bb", "one two three"]
    texts = []
    for k in range(60):
        words = items[k % len(items)].split()
        for _ in range(k // len(items) % 4):
            p = int(r.integers(len(words)))
            words[p : p + 1] = [] if k % 2 else [words[p], str(r.choice(vocabulary))]
        texts.append(" ".join([*r.choice(vocabulary, k % 13), *words, *r.choice(vocabulary, k % 7)]))
    texts += [None, "", sentence(78, 20_000) + " " + items[4].upper()]

    def bags(text):
        words = (text or "").lower().split()
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])

    def alike(a, b):
        x, y = Counter(a), Counter(b)
        return sum((x & y).values()) / sum((x | y).values())

    expected = set()
    for d, text in enumerate(texts[:-1]):
        own = bags(text)
        for i, item in enumerate(items):
            wanted = bags(item)
            starts = range(max(len(own) - len(wanted), 0) + 1)
            if own and max(alike(own[a : a + len(wanted)], wanted) for a in starts) >= 0.8:
                expected.add((d, i))
    expected.add((len(texts) - 1, 4))
    df = docs(spark, *texts, ids=None).withColumn("similarity", F.lit("clash")).withColumn("item_id", F.lit(None))
    df = df.unionByName(df.where("doc_id = 0")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    found = decontaminate.find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    for r in found:
        window = bags(texts[r["doc_id"]])[r["start_word"] :][: len(bags(items[r["item_id"]]))]
        assert r["similarity"] == pytest.approx(alike(window, bags(items[r["item_id"]])))


def test_hamming_blocks():
    r = np.random.default_rng(9)
    prints, queries = r.integers(0, 1 << 63, 300).astype(np.uint64), r.integers(0, 1 << 63, 100).astype(np.uint64)
    queries[:50] = prints[:50] ^ np.uint64(0b1011)
    q, p = decontaminate.HammingBlocks(prints).within(queries)
    d = np.bitwise_count(queries[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= decontaminate.RADIUS), strict=True)}


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "<|endoftext|> it's O'Neil <|startoftext|>", "naïve İstanbul ΣΑΣ é   x y", "a" * 5000]
    rows = packing.pack_documents(docs(spark, *texts), 64).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            piece = ids[d][at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids[d])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack_documents(docs(spark, "x").limit(0)).count() == 0
    assert [r["doc_id"] for r in packing.pack_documents(docs(spark, "x", ids=[None])).collect()] == [None]


ODD_TEXTS = ["", " ", "\n", "Été ÉTÉ, été; E\u0301te\u0301. ÀÖØÞ ßÿ÷×", "don't 'S o'Neil's", "a.b, ..., a... (a), a,)\u0301 a,\u0301", "x\x00y z\t\ty\u00a0z\r", "ΣΑΣ σας, Ωmega", "İstanbul ŉ œuvre, Œuvre", "文字 文字, ！ 😀😀 ٣4½", "<|endoftext|> a<|endoftext|>", "ĳ ﬁx ǅ ǅa"]


def test_packing_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    words = packing.WordEncoder(packing.default_tokenizer())
    assert words.encode([]) == []
    rng = np.random.default_rng(5)
    signs = list("aébcßÉZœσ  \n.,;:!?%#*$&|'-0")
    texts = [*ODD_TEXTS, *("".join(rng.choice(signs, size=40)) for _ in range(300))]
    for k in range(0, len(texts), 30):
        for t, found in zip(texts[k : k + 30], words.encode(texts[k : k + 30]), strict=True):
            assert found.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_words_are_learnt_once_whatever_follows_them():
    words = packing.WordEncoder(packing.default_tokenizer())
    calls, tokenize = [], words.tokenize
    words.tokenize = lambda w: calls.append(w) or tokenize(w)
    words.encode(["word word, word. été", "Word; ÉTÉ! Été"])
    words.encode(["word? word... été|"])
    assert len(calls) == len(words.known) == 2


def test_packing_ranges_stay_small_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 2000)
    df = docs(spark, *[sentence(k % 700, 60) for k in range(2000)])
    found = packing.pack_documents(df, 64).groupBy(F.shiftright("sequence_id", 32).alias("range")).agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in found)
    assert len(found) > total / 4000
    assert max(r["n"] for r in found) < 8000


def test_packing_repeated_and_long_rows(spark):
    df = docs(spark, BASE, BASE, "", None, sentence(9, 40_000), ids=[5, 5, 5, None, 8]).withColumn("sequence_id", F.lit("clash")).withColumn("length", F.lit(None))
    rows = packing.pack_documents(df, 2048).collect()
    whole = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert whole == {5: 3, 8: 1, None: 1}
    for doc in (5, 8, None):
        own = [r for r in rows if r["doc_id"] == doc]
        assert sum(r["length"] for r in own) == sum(r["doc_tokens"] for r in own if r["start"] == 0)
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_quality_edges(spark):
    df, labels = labelled_docs(spark)
    more = df.where("doc_id in (1, 2)").unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    df = df.unionByName(more).withColumn("predicted", F.lit("clash")).withColumn("label", F.lit("own"))
    found = quality.score_quality(df, labels).collect()
    assert len(found) == df.count()
    for k in (1, 2):
        assert len({r["score"] for r in found if r["doc_id"] == k}) == 1
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert {r["label"] for r in found} == {"own"}


def test_html_edges(spark):
    body = " ".join(f"<p>{sentence(k, 30)}.</p>" for k in range(400))
    long = PAGE.format(body)
    rows = [(1, long), (1, long), (None, PAGE.format(sentence(2, 50))), (2, "<p>" * 3000), (3, "<div " + "a" * 100_000), (4, "&" * 50_000)]
    found = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(5))).collect()
    assert len(found) == len(rows)
    assert len({r["text"] for r in found if r["page_id"] == 1}) == 1
    assert next(r["n_chars"] for r in found if r["page_id"] == 1) > 60_000


def test_viterbi_and_marginals_against_all_labellings():
    crf = html_extract.ChainCRF(html_extract.labelled_pages([PAGE.format(sentence(k, 50)) for k in range(5)]), epochs=5)
    r = np.random.default_rng(2)
    emissions = [tuple(x) for x in r.standard_normal((6, 2)) * 3]

    def score(labels):
        total = crf.first[labels[0]] + sum(e[x] for e, x in zip(emissions, labels, strict=True))
        return total + sum(crf.step[a, b] for a, b in zip(labels[:-1], labels[1:], strict=True))

    every = list(product((0, 1), repeat=6))
    assert tuple(crf.viterbi(emissions)) == max(every, key=score)
    weights = np.exp([score(x) for x in every])
    node, _ = crf._marginals(np.array([emissions]), np.ones((1, 6), bool))
    expected = [[sum(w for w, x in zip(weights, every, strict=True) if x[t] == k) / weights.sum() for k in (0, 1)] for t in range(6)]
    assert node[0] == pytest.approx(np.array(expected))


def test_hilbert_is_a_curve():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    order = points[np.argsort(packing.hilbert_key(points, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.py", "code\n# Released under the MIT License.\nmore"), ("a/b/c/y.py", "code only"), ("a/b/COPYING-2", "nothing"),
        ("z.py", None), ("z/w.py", ""), ("a/dup.py", "one"), ("a/dup.py", "one"), (None, "Released under the MIT License."), ("q/LICENSE.txt", "released UNDER the mit licence"),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")
    found = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.license_scan(df).collect()}
    assert found["a/LICENSE"] == ("Apache-2.0", "Apache-2.0", None)
    assert found["a/b/x.py"] == ("MIT", "MIT", None)
    assert found["a/b/c/y.py"] == (None, "Apache-2.0", "a")
    assert found["a/dup.py"] == (None, "Apache-2.0", "a")
    assert found["z.py"] == found["z/w.py"] == (None, None, None)
    assert None not in found
    assert license_scan.license_scan(df.limit(0)).count() == 0


GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  13. Use with the GNU Affero General Public License.
  Notwithstanding any other provision of this License, you have permission to link or combine any covered work.
"""
MIT = license_scan.TEMPLATES["MIT"][2]
BSD2, BSD3 = license_scan.TEMPLATES["BSD-2-Clause"][-1], license_scan.TEMPLATES["BSD-3-Clause"][-1]
CODE = "\n\nimport os\n\ndef main():\n    return os.getcwd()\n"


def commented(text, sign="#", width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(f"{sign} {line}")
            line = ""
        line += word + " "
    return "\n".join([*lines, f"{sign} {line}"])


LICENSED = [
    (GPL3, "GPL-3.0"), (GPL3.replace("Version 3, 29 June 2007", "Version 2, June 1991"), "GPL-2.0"),
    (GPL3.replace("GENERAL PUBLIC LICENSE\n", "LESSER GENERAL PUBLIC LICENSE\n"), "LGPL-3.0"),
    ("MIT License\n\nCopyright (c) 2020 Some Body\n\n" + MIT, "MIT"), ("Copyright 2001 A. Person\n\n" + MIT, "MIT"),
    ("Copyright (c) 1999, People\nAll rights reserved.\n\n" + BSD2, "BSD-2-Clause"), ("Copyright (c) 1999, People\nAll rights reserved.\n\n" + BSD3, "BSD-3-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n\n1.1. Contributor means each one", "MPL-2.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    (commented("Copyright 2020 Someone. " + license_scan.TEMPLATES["Apache-2.0"][2]) + CODE, "Apache-2.0"),
    (commented(license_scan.TEMPLATES["GPL-3.0"][2], "//") + CODE, "GPL-3.0"), (commented(license_scan.TEMPLATES["GPL-2.0"][2], " *") + CODE, "GPL-2.0"),
    (commented(license_scan.TEMPLATES["LGPL-2.1"][1]) + CODE, "LGPL-2.1"), (commented(license_scan.TEMPLATES["MPL-2.0"][2]) + CODE, "MPL-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only" + CODE, "GPL-2.0"), ("# SPDX-License-Identifier: MIT" + CODE, "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */" + CODE, "Apache-2.0"), ("# SPDX-License-Identifier: LicenseRef-Own-7" + CODE, None),
    ("This is free and unencumbered software released into the public domain.\n\n" + license_scan.TEMPLATES["Unlicense"][1], "Unlicense"),
    ("The law of the land is free and open to all.", None), ("Permission was granted to the general public.", None), (sentence(3, 30_000) + "\n# Released under the MIT License.\n" + sentence(4, 30_000), "MIT"),
]


def test_licenses_of_whole_files(spark):
    df = spark.createDataFrame([(f"{k}/f", text) for k, (text, _) in enumerate(LICENSED)], "path string, text string")
    found = {r["path"]: r["own_license"] for r in license_scan.license_scan(df).collect()}
    assert found == {f"{k}/f": expected for k, (_, expected) in enumerate(LICENSED)}


def test_license_ties_and_folders(spark):
    line = {"A": ["alpha beta gamma delta"], "B": ["alpha beta gamma epsilon", "omega psi chi phi"]}
    rows = [
        ("x", "alpha beta gamma"), ("y", "alpha beta gamma\n\nomega psi chi phi too"), ("d/LICENSE", "words of no licence"), ("d/e/f.py", "code"), ("LICENSE", "omega psi chi phi"),
        ("g/LICENCE-2", "omega psi chi phi"), ("g/LICENSE", "alpha beta gamma delta"), ("g/f.py", "code"),
    ]
    found = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string"), line).collect()}
    assert found["x"][0] == "A"
    assert found["y"][0] == "B"
    # a licence file that says nothing known is passed over; of two in a folder the smallest path counts
    assert found["d/e/f.py"] == (None, "B", "")
    assert found["g/f.py"] == (None, "B", "g")


def test_license_bound_passes_over_nothing(spark, monkeypatch):
    r = np.random.default_rng(8)
    texts = [t for own in license_scan.with_tags(license_scan.TEMPLATES).values() for t in own]
    rows = []
    for k in range(150):
        words = texts[k % len(texts)].split()
        some = [w for w in words if r.random() < 0.35 + 0.6 * (k % 7) / 6]
        rows.append((str(k), " ".join(some + sentence(k, k % 9 + 1).split())))
    df = spark.createDataFrame(rows, "path string, text string")
    fast = license_scan.license_scan(df).orderBy("path").collect()
    monkeypatch.setattr(license_scan, "needed_terms", lambda weights, threshold: ([w[2] for w in weights], []))
    assert license_scan.license_scan(df).orderBy("path").collect() == fast
    assert len({x["own_license"] for x in fast}) > 10


def test_word_hashes_agree_across_batches():
    one = [word_hashes([t])[0].tolist() for t in TEXTS]
    hashes, _, _, counts, _ = word_hashes(TEXTS)
    assert [x.tolist() for x in np.split(hashes, np.cumsum(counts)[:-1])] == one


def test_clashing_columns_stay(spark):
    df = docs(spark, BASE, "one").withColumn("held_out", F.lit("old"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert dict(quality.score_quality(df, labels).dtypes)["held_out"] == "boolean"
