import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import kneser_ney as kn

from .data import edge_docs, empty_docs, lowered, words_of

END, START = "</s>", "<s>"


def brute(train):
    """The model in plain Python: (counts, tokens, words, p(word | two before), lower orders' p)."""
    seqs = [[*words_of(lowered(x)), END] for x in train]
    c1 = Counter(w for s in seqs for w in s)
    c3 = Counter(t for s in seqs for t in zip([START, START, *s], [START, *s], s, strict=False))
    c2 = Counter()
    for (t, u, w), c in c3.items():
        # Distinct words before; what starts a text has its count.
        c2[u, w] += c if (t, u) == (START, START) else 1
    cont = Counter(w for _, w in c2)

    def stats(table):
        followers, sums = defaultdict(Counter), Counter()
        for (*u, _), c in table.items():
            followers[tuple(u)][min(c, 3)] += 1
            sums[tuple(u)] += c
        return followers, sums

    d3, d2, d1 = (kn.discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (c3, c2, cont))
    f3, s3 = stats(c3)
    f2, s2 = stats(c2)
    n, v, total = sum(c1.values()), len(c1), sum(cont.values())
    spare = sum(d1[min(c, 3)] for c in cont.values()) / total if total else 1.0

    def low(w):
        c = cont.get(w, 0)
        return (max(c - d1[min(c, 3)], 0) / total if total else 0) + spare / (v + 1)

    def one(u, w):
        if (u,) not in s2:
            return low(w)
        c = c2.get((u, w), 0)
        return max(c - d2[min(c, 3)], 0) / s2[u,] + sum(d2[k] * m for k, m in f2[u,].items()) / s2[u,] * low(w)

    def p(t, u, w):
        if (t, u) not in s3:
            return one(u, w)
        c = c3.get((t, u, w), 0)
        return max(c - d3[min(c, 3)], 0) / s3[t, u] + sum(d3[k] * m for k, m in f3[t, u].items()) / s3[t, u] * one(u, w)

    return c1, n, v, p, one, low


def test_scores_equal_brute_force(spark):
    docs = edge_docs(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = kn.train(docs.where(~held))
    rows = kn.score(docs, model, held_out=held).collect()
    texts = docs.select("doc_id", "text").collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c1, n, v, p, *_ = brute([r.text for r in texts if not out(r.doc_id)])
    want = []
    for r in texts:
        s = [*words_of(lowered(r.text)), END]
        want.append((r.doc_id, out(r.doc_id), len(s), sum(w in c1 for w in s), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s), sum(math.log10(p(*x)) for x in zip([START, START, *s], [START, *s], s, strict=False))))
    key = lambda r: (r[0] if r[0] is not None else -1, r[2], r[5])
    assert any(r.held_out for r in rows)
    for a, b in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= a[2] / kn.STEPS + 1e-5


def test_a_context_sums_to_one():
    train = ["a b a c a b d", "b a c c", "d d a b", ""]
    c1, _, _, p, one, low = brute(train)
    for u in [START, "a", "b", "never"]:
        assert math.isclose(sum(one(u, w) for w in c1) + one(u, "<unk>"), 1.0, rel_tol=1e-9)
        for t in [START, "a", "d"]:
            assert math.isclose(sum(p(t, u, w) for w in c1) + p(t, u, "<unk>"), 1.0, rel_tol=1e-9)
    assert math.isclose(sum(map(low, c1)) + low("<unk>"), 1.0, rel_tol=1e-9)


def test_counts_beyond_a_byte_and_many_slices(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["the same words again and again"] * 700 + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "the same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(kn, "SLICE", 1 << 10)
    model = kn.train(docs.repartition(3))
    *_, p, _, _ = brute(texts)
    assert model.shards > 1
    for r in kn.score(docs, model).collect():
        s = [*words_of(texts[r.doc_id]), END]
        assert abs(r.score - sum(math.log10(p(*x)) for x in zip([START, START, *s], [START, *s], s, strict=False))) <= len(s) / kn.STEPS + 1e-5


def test_empty_tables(spark):
    model = kn.train(empty_docs(spark))
    assert model.vocabulary == 0
    rows = kn.score(edge_docs(spark), model).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.n_tokens * math.log10(model.unknown) for r in rows)
    assert kn.score(empty_docs(spark), model).count() == 0


def test_blocks_merge():
    a = (np.array([1, 5, 2**63], np.uint64), np.array([1, 2, 3], np.uint32))
    b = (np.array([5, 9], np.uint64), np.array([4, 1], np.uint64))
    keys, counts = kn._merge([kn._pack(kn._steps(k), c) for k, c in (a, b)])
    assert keys.tolist() == [1, 5, 9, 2**63] and counts.tolist() == [1, 6, 1, 3]


def test_triples_merge_from_slices():
    rng = np.random.default_rng(3)
    contexts, words = rng.integers(0, 40, 5000).astype(np.uint64) << np.uint64(32), rng.integers(0, 5, 5000).astype(np.uint64)
    contexts[:2000], words[:2000] = contexts[0], 3
    want = Counter(zip(contexts.tolist(), words.tolist(), strict=True))
    got, blocks = Counter(), defaultdict(list)
    for lo in range(0, 5000, 1700):
        for shard, block in kn._triple_blocks(contexts[lo : lo + 1700], words[lo : lo + 1700], 7):
            blocks[shard].append(block)
    for shard, parts in blocks.items():
        keys, bounds, third, counts = kn._merge_triples(parts)
        assert (kn.shard_of(keys, 7) == shard).all() and (np.diff(keys) > 0).all()
        for k, a, b in zip(keys.tolist(), bounds[:-1], bounds[1:], strict=True):
            assert (np.diff(third[a:b].astype(int)) > 0).all()
            got.update({(k, int(w)): int(c) for w, c in zip(third[a:b], counts[a:b], strict=True)})
    assert got == want
