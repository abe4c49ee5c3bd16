import functools
import json
import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import packing, tokens, vbyte
from strataloom.llm.shared import new_path
from strataloom.llm.tokens import Encoder

from .data import edge_docs, empty_docs

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@functools.cache
def library(name):
    """The tokenizer as its file has it."""
    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(name, text, end):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", FILES)
def test_chunks_give_the_librarys_ids(name):
    rng = random.Random(1)
    parts = ["a", "B", " ", ".", ",", "\n", "é", "e\u0301", "\u00a0", "  ", "\t", "!", "'s", "1", "x.", "\u2003", "Σ", "İ", "漢", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x1c", "the ", "word, ", "\r\n", "\0"]
    enc = Encoder(public_tokenizers.path(name), most_chunks=50)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for lo in range(0, len(texts), 500):
        want = [np.array(x.ids, "<u4").tobytes() for x in library(name).encode_batch(texts[lo : lo + 500], add_special_tokens=False)]
        assert enc.encode(texts[lo : lo + 500]) == want


@pytest.mark.parametrize("name", FILES)
def test_special_strings_are_read_as_the_library_does(name):
    enc = Encoder(public_tokenizers.path(name))
    marks = [x.content for x in library(name).get_added_tokens_decoder().values()]
    assert marks
    for mark in [*marks, *(x.upper() for x in marks), "<|", "<|x|>"]:
        for text in (mark, f"a {mark} b", f"a{mark}b.", f"{mark}{mark}", f"one {mark}\ntwo"):
            assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == library(name).encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", FILES)
def test_parts_of_a_call_change_no_id(name, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 3)
    monkeypatch.setattr(tokens, "PART_TEXTS", 2)
    rng = random.Random(2)
    words = ["the", "Ab.", "été", "e\u0301t", "漢字", "x,", "a\nb", "  ", "\t", "<|endoftext|>", "\u00a0", "İ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    enc = Encoder(public_tokenizers.path(name), most_chunks=7)
    want = [np.array(x.ids, "<u4").tobytes() for x in library(name).encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts[::-1]) == want[::-1]


WORKER = """
import json, random, re, sys, pyarrow as pa
from strataloom.llm import packing
path, limits = json.loads(sys.argv[1])
def status(key):
    return int(re.search(key + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 12))) for _ in range(60_000)]
def batches():
    for _ in range(3):
        texts = [" ".join(rng.choices(words, k=500)) for _ in range(1000)]
        yield pa.record_batch([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
run = packing._pieces(path, 1024, 0, **limits)
list(run([pa.record_batch([pa.array([0]), pa.array(["one"])], names=["doc_id", "text"])]))
before = status("VmRSS")
rows = sum(x.num_rows for x in run(batches()))
print(json.dumps([rows, status("VmHWM") - before]))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="no figures of memory here")
def test_a_worker_of_the_pipelines_packing_takes_little(monkeypatch):
    monkeypatch.setattr(packing, "pack", lambda docs, path, **limits: [path, limits])
    args = json.dumps(corpus_pipeline.pack(None, None, ""))
    here = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", WORKER, args], env=os.environ | {"PYTHONPATH": here}, capture_output=True, text=True, timeout=120, check=True)
    rows, mb = json.loads(out.stdout)
    assert rows >= 3000 and mb < 95, mb


def test_packing_holds_each_id_once(spark):
    docs = edge_docs(spark)
    rows = packing.pack(docs, public_tokenizers.path(FILES[0])).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *x) for r in docs.collect() for ids in [direct(FILES[0], r.text, 0)] for x in [(at, len(ids[at : at + 1024]), zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 1024)])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(empty_docs(spark), public_tokenizers.path(FILES[0])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_place_every_length(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = {}
    for count, pattern in patterns:
        assert count > 0 and sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == histogram
    # As one by one: each into the shortest pack that fits.
    packs = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [i for i, p in enumerate(packs) if p + n <= 64]
            if fits:
                packs[min(fits, key=lambda i: packs[i])] += n
            else:
                packs.append(n)
    assert sorted(packs) == sorted(sum(n * k for n, k in p) for c, p in patterns for _ in range(c))


def test_token_files_round_trip(spark):
    docs = edge_docs(spark)
    folder = new_path(spark, "t")
    manifest = vbyte.write(docs, public_tokenizers.path(FILES[1]), folder, shard_tokens=500)
    assert manifest.count() > 3
    got = sorted(vbyte.read(manifest, folder).collect(), key=lambda r: r.start)
    ids = sorted(((r.doc_id if r.doc_id is not None else -1, direct(FILES[1], r.text, 2)) for r in docs.collect()), key=lambda x: (x[0], len(x[1])))
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in ids]
    start = 0
    for r in got:
        mine = [x for i, x in ids if i == (r.doc_id if r.doc_id is not None else -1)]
        assert r.start == start and r.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in mine}
        start += r.n_tokens
    assert vbyte.round_trip(empty_docs(spark), public_tokenizers.path(FILES[1])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=8))
def test_control_bytes(docs):
    counts = np.array([len(x) for x in docs], np.int64)
    values = np.array([v for x in docs for v in x], np.uint32)
    control, data, sizes = vbyte.encode(values, counts)
    assert len(control) == sum(-(-len(x) // 4) for x in docs) and sizes.sum() == len(data)
    assert vbyte.decode(control, data, counts).tolist() == values.tolist()
    at = 0
    for v in values.tolist():  # one value after the other
        n = max(1, (v.bit_length() + 7) // 8)
        assert int.from_bytes(data[at : at + n].tobytes(), "little") == v
        at += n


def test_hot_ids_are_several_shards(spark):
    rows = [(7 if i % 3 else i, f"some words {i}") for i in range(900)] + [(None, "no id here")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "t")
    manifest = vbyte.write(docs, public_tokenizers.path(FILES[1]), folder, shard_tokens=200)
    assert max(r.tokens for r in manifest.collect()) < 900 and manifest.count() > 15
    got = sorted(vbyte.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + sorted(i for i, _ in rows if i is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    want = sorted(zlib.crc32(np.array(direct(FILES[1], x, 2), "<u4").tobytes()) for _, x in rows)
    assert sorted(r.ids_crc32 for r in got) == want


def test_unknown_file():
    with pytest.raises(ValueError):
        vbyte.read_shard(b"NOPE\0\0\0\0" + struct.pack("<QQQ", 0, 0, 0))
