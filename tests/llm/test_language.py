import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataloom.llm import crf_lang
from strataloom.llm.textscan import Words, text_buffers

from .data import edge_docs, empty_docs, words_of

VOCABULARY = {
    "en": "the and of with thing other there when house water night eight would could".split(),
    "fr": "le la de avec être où maison chose eau lequel toujours été voilà pourquoi".split(),
    "de": "der die und mit über möchte haus wasser nicht schön straße wieder zwischen".split(),
}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        out.append((i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    k, t = 3, rng.normal(size=(3, 3))
    lengths = [1, 4, 0, 5]
    e = rng.normal(size=(sum(lengths), k)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(lengths)])
    pairs = np.zeros((k, k))
    got = crf_lang.marginals(e, first, t, pairs)
    want_pairs = np.zeros((k, k))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        total, sums, inner = 0.0, np.zeros((hi - lo, k)), np.zeros((k, k))
        for path in np.ndindex(*[k] * (hi - lo)) if hi > lo else ():
            # The first word comes from a uniform state before it.
            w = np.log(np.exp(t)[:, path[0]].mean()) + sum(e[lo + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False))
            w = np.exp(w)
            total += w
            for i, y in enumerate(path):
                sums[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                inner[a, b] += w
        if hi > lo:
            assert np.allclose(got[lo:hi], sums / total, atol=1e-5)
            want_pairs += inner / total
    assert np.allclose(pairs, want_pairs, atol=1e-5)


def test_blocks_don_t_change_long_documents():
    rng = np.random.default_rng(1)
    n, k = 1000, 4
    e, t = rng.normal(size=(n, k)).astype(np.float32), rng.normal(size=(k, k))
    got = crf_lang.marginals(e, np.array([0, n]), t)
    x, tr = np.exp(e.astype(float)), np.exp(t)
    f, a = [], np.full(k, 1 / k)
    for i in range(n):
        a = (a @ tr) * x[i]
        a /= a.sum()
        f.append(a)
    b, out = np.ones(k), np.empty((n, k))
    for i in reversed(range(n)):
        out[i] = f[i] * b / (f[i] * b).sum()
        b = tr @ (x[i] * b)
        b /= b.sum()
    assert np.allclose(got, out, atol=1e-6)


def test_held_out_accuracy_and_code_switching(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = crf_lang.train(docs.where("doc_id % 3 != 0"))
    held = docs.where("doc_id % 3 = 0")
    out = {r.doc_id: r.lang_pred for r in crf_lang.predict(held, crf).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows if i % 3 == 0]) > 0.97
    mixed = " ".join(VOCABULARY["en"]) + " " + " ".join(VOCABULARY["fr"])
    runs = crf_lang.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), crf).first().runs
    assert [r.lang for r in runs] == ["en", "fr"] and abs(runs[1].start - len(VOCABULARY["en"])) <= 1


def test_edge_cases(spark):
    docs = edge_docs(spark)
    crf = crf_lang.train(spark.createDataFrame(corpus(60), "doc_id long, text string, lang string"))
    rows = crf_lang.predict(docs, crf).collect()
    assert len(rows) == docs.count()
    texts = docs.select("doc_id", "text").collect()
    for r, x in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(texts, key=lambda r: str(r.doc_id)), strict=True):
        letters = any(c.isalpha() for c in x.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    kept = crf_lang.keep(docs, crf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert crf_lang.predict(empty_docs(spark), crf).count() == 0 and crf_lang.keep(empty_docs(spark), crf).count() == 0
    nothing = crf_lang.train(empty_docs(spark))
    assert {r.lang_pred for r in crf_lang.predict(docs, nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "the and", "en") for i in range(50)], "doc_id long, text string, lang string")
    assert crf_lang.train(docs, most_rows=7).languages == ["en"]
    assert crf_lang.train(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_rare_languages_and_long_texts_are_learned(spark):
    rows = corpus(3000) + [(10_000 + i, " ".join(VOCABULARY["de"][::-1] * 900), "xx") for i in range(2)] + [(20_000, "the and of", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = crf_lang.train(docs, most_rows=200, most_bytes=4096)
    assert crf.languages == ["de", "en", "fr", "xx"]


def test_unlabelled_and_mislabelled_corpora(spark):
    crf = crf_lang.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    french = spark.createDataFrame([(i, " ".join(VOCABULARY["fr"]), "en" if i % 2 else None) for i in range(20)], "doc_id long, text string, lang string")
    assert [r.lang for r in crf_lang.keep(french, crf).collect()] == ["fr"] * 20
    plain = french.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(crf_lang.keep(plain, crf_lang.train(plain)).collect()) == sorted(plain.collect())
    assert crf_lang.keep(french.drop("lang"), crf).count() == 20


def test_the_fit_holds_distinct_words_only(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=1500)) for _ in range(300)]
    tracemalloc.start()
    crf = crf_lang.fit(["a", "b"], texts, [i % 2 for i in range(300)], epochs=0)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert peak < 195, peak
    monkeypatch.setattr(crf_lang, "FIT_WORDS", 7)
    few = [" ".join(x.split()[:100]) for x in texts[:40]]
    one = crf_lang.fit(["a", "b"], few, [i % 2 for i in range(40)], epochs=1)
    monkeypatch.setattr(crf_lang, "FIT_WORDS", 10**6)
    two = crf_lang.fit(["a", "b"], few, [i % 2 for i in range(40)], epochs=1)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.transitions, two.transitions) and crf.languages == ["a", "b"]


def test_hashes_don_t_depend_on_chunks():
    rng = random.Random(6)
    text = "".join(rng.choice("abc \n") for _ in range(700_000)) + " " + "x" * 400_000 + " abc"
    words = Words(*text_buffers(pa.array([text])))
    want = {}
    for a, b, h in zip(words.start.tolist(), words.stop.tolist(), words.hashes.tolist(), strict=True):
        assert want.setdefault(text[a:b], h) == h
    assert len(set(want.values())) == len(want)
    alone = Words(*text_buffers(pa.array(["x" * 400_000])))
    same = want["x" * 400_000] == alone.hashes[0]
    assert same
    assert want["abc"] == Words(*text_buffers(pa.array(["abc"]))).hashes[0]


def test_word_scan():
    texts = ["a b\tc", None, "", " x\n\n yy ", "é\x0bf"]
    data, offsets = text_buffers(pa.array(texts))
    words = Words(data, offsets, lower=False)
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.stop, strict=True)]
    assert got == [w for t in texts for w in words_of(t)]
    assert np.diff(words.first).tolist() == [len(words_of(t)) for t in texts]
    same = Words(*text_buffers(pa.array(["x y x", "x"])))
    assert len(set(same.hashes.tolist())) == 2 and same.hashes[0] == same.hashes[2] == same.hashes[3]
