import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import minhash
from strataloom.llm.components import connected_components

from .data import edge_docs, empty_docs, lowered, words_of


def shingles(text, k):
    w = words_of(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {}
    for i, x in rows:
        sets.setdefault(i, set()).update(shingles(x, k))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(n=140, seed=1):
    """A family of edits of one text, so that buckets hold several components, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append((1000 - i, " ".join(w)))
    return out + [(2000 + i, " ".join(f"u{rng.randrange(3000)}" for _ in range(80))) for i in range(40)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=k, threshold=percent / 100).collect()}
    assert got == brute(rows, k, percent)


def test_edge_cases(spark):
    docs = edge_docs(spark)
    rows = minhash.near_duplicates(docs, shingle=3, threshold=0.85).collect()
    assert len(rows) == docs.count()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("doc_id is not null").collect()], 3, 85)
    for r in rows:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = minhash.keep_one(docs, shingle=3, threshold=0.85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(docs, shingle=3, threshold=0.85).where("kept").collect()}


def test_posterior_table_prunes_at_the_chosen_miss_probability():
    plan = minhash.Plan.of(3, 0.85, 1e-6, 5)
    rng = np.random.default_rng(0)
    left = rng.integers(0, 1 << 32, (4000, plan.length), dtype=np.uint32)
    for similarity, least, most in ((0.86, 1.0, 1.0), (0.3, 0.0, 0.0)):
        right = np.where(rng.random(left.shape) < similarity, left, left + 1)
        share = len(minhash.survivors(left, right, plan.least_matches())) / len(left)
        assert least - 0.001 <= share <= most + 0.001


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_connected_components(spark, pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
