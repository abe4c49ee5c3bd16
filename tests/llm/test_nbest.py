import zlib

import numpy as np
import public_tokenizers
import pytest

from strataloom.llm import nbest

from .data import edge_docs, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice(PATH, 4)


def brute(lattice, text):
    into, _ = lattice.edges(text)
    paths = [[(0.0, ())]]
    for j in range(1, len(into)):
        paths.append([(a + s, x + ids) for i, s, ids in into[j] for a, x in paths[i]])
    return sorted(paths[-1], key=lambda r: (-r[0], r[1][::-1]))


@pytest.mark.parametrize("word", ["▁hello", "▁é", "▁aaaa", "zorb▁", "▁internat", "▁x😀y", "▁▁▁ab", "a"])
def test_search_equals_enumeration(lattice, word):
    assert lattice.search(word, 4) == brute(lattice, word)[:4]


@pytest.mark.parametrize("text", ["the cat", "a é b", "hi  yo\nno", "", " x", "日本", "a. b", "hé, x.", "\x01a, b", "ab."])
def test_texts_equal_enumeration(lattice, text):
    full = brute(lattice, ("▁" if text else "") + text.replace(" ", "▁"))
    got = lattice.segmentations(text)
    assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in full[:4]]
    every = {ids: s for s, ids in full}
    for score, ids in got:
        assert lattice.decode(ids) == text and round(every[tuple(ids)], 6) == round(score, 6)
    assert len({tuple(ids) for _, ids in got}) == len(got)


def test_the_table_may_be_cleared(lattice, monkeypatch):
    want = lattice.nbest("some words in a text")
    monkeypatch.setattr(nbest, "MOST_WORDS", 0)
    assert lattice.nbest("some words in a text") == want


def test_round_trip_and_edge_cases(spark):
    docs = edge_docs(spark)
    rows = nbest.encode(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert all(r.scores == sorted(r.scores, reverse=True) and len(r.scores) <= 4 for r in rows)
    empty = [r for r in rows if r.doc_id in (0, 1)]
    assert [(r.n_pieces, r.scores) for r in empty] == [(0, [0.0]), (0, [0.0])]
    back = nbest.decode(nbest.segment(docs, PATH).where("rank = 0"), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert nbest.encode(empty_docs(spark), PATH).count() == 0


def test_round_trip_is_of_the_row_itself(spark):
    rows = [(0, "plain text"), (1, "a literal \u2581 mark"), (2, "plain text"), (3, "\u2581"), (4, " é 😀\nx.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.round_trip for r in nbest.encode(docs, PATH).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_a_wrong_part_fails_its_own_text_only(monkeypatch):
    lattice = nbest.Lattice(PATH, 4)
    lattice.bytes_of[lattice.search("▁zebra", 1)[0][1][0]] = b"?"
    assert [lattice.digests(x)[3] for x in ("a cat", "a zebra", "a cat")] == [True, False, True]
    monkeypatch.setattr(nbest, "MOST_WORDS", 0)
    assert [lattice.digests(x)[3] for x in ("a zebra", "a cat", "a zebra")] == [False, True, False]


def test_every_segmentation_has_its_digest(spark):
    docs = edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {}
    for r in nbest.segment(docs, PATH).orderBy("doc_id", "rank").collect():
        want.setdefault(r.doc_id, []).append((len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())))
    got = nbest.encode(docs, PATH).collect()
    assert {r.doc_id: list(zip(r.nbest_pieces, r.nbest_crc32, strict=True)) for r in got} == want
    assert all((r.n_pieces, r.ids_crc32) == (r.nbest_pieces[0], r.nbest_crc32[0]) for r in got)
    assert any(len(set(r.nbest_crc32)) == 4 for r in got)
