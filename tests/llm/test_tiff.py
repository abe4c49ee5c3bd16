import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import tiff

from .data import edge_docs, empty_docs

CODES = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.tuples(st.integers(0, 255), st.integers(1, 400)), max_size=20).map(lambda x: b"".join(bytes([v]) * n for v, n in x)))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_vectors():
    packed = bytes.fromhex("feaa02800 02afdaa0380002a22f7aa".replace(" ", ""))
    assert tiff.unpack_bits(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    # 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257, nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert list(tiff.lzw_decode(raw)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


def test_long_lzw_fills_the_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("code", CODES)
@pytest.mark.parametrize("predictor", [1, 2, None])
@pytest.mark.parametrize("tile", [None, (16, 32), (64, 64)])
def test_files_round_trip(code, predictor, tile):
    rng = np.random.default_rng(code)
    pages = [rng.integers(0, 30, shape).astype(np.uint8) for shape in ((5, 64, 1), (100, 33, 3), (1, 1, 1), (300, 64, 4))]
    got = tiff.read(tiff.write(pages, code, predictor, tile, chunk=3000))
    assert [(p.width, p.height, p.samples) for p in got] == [(x.shape[1], x.shape[0], x.shape[2]) for x in pages]
    assert [p.pixels for p in got] == [x.tobytes() for x in pages]


def handmade(order, values, bits, predictor, planar=1, big=False):
    """A file of one strip for each plane, written field by field."""
    height, width, samples = values.shape
    dtype = np.dtype({8: "u1", 16: "u2", 32: "f4" if predictor == 3 else "u4"}[bits]).newbyteorder(order)
    strips = []
    for plane in range(samples if planar == 2 else 1):
        x = values[:, :, plane : plane + 1] if planar == 2 else values
        if predictor == 2:
            x = np.diff(x, axis=1, prepend=np.zeros((height, 1, x.shape[2]), x.dtype))
        if predictor == 3:
            raw = x.astype(">f4").reshape(height, -1).view(np.uint8).reshape(height, -1, 4).transpose(0, 2, 1).reshape(height, -1, x.shape[2])
            x = np.diff(raw, axis=1, prepend=np.zeros((height, 1, x.shape[2]), np.uint8))
            strips.append(zlib.compress(x.astype(np.uint8).tobytes()))
        else:
            strips.append(zlib.compress(x.astype(dtype).tobytes()))
    off, head = ("Q", 16) if big else ("I", 8)
    body, at = b"", []
    for s in strips:
        at.append(head + len(body))
        body += s
    fields = {256: [width], 257: [height], 258: [bits], 259: [8], 277: [samples], 278: [height], 284: [planar], 317: [predictor], 273: at, 279: [len(s) for s in strips]}
    entries = b""
    for tag in sorted(fields):
        v = fields[tag]
        raw = struct.pack(f"{order}{len(v)}{off}", *v)
        if len(raw) > struct.calcsize(off):
            place = head + len(body)
            body += raw
            raw = struct.pack(order + off, place)
        entries += struct.pack(order + "HH" + off, tag, 16 if big else 4, len(v)) + raw
    start = struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, head + len(body)) if big else (42, head + len(body))))
    return {"<": b"II", ">": b"MM"}[order] + start + body + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + struct.pack(order + off, 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("bits", "predictor", "planar", "big"), [(8, 1, 1, False), (8, 2, 2, False), (16, 2, 1, False), (16, 1, 2, True), (32, 2, 1, True), (32, 3, 1, False)])
def test_foreign_files(order, bits, predictor, planar, big):
    rng = np.random.default_rng(bits)
    values = rng.normal(size=(6, 10, 3)).astype("<f4") if predictor == 3 else rng.integers(0, 1 << min(bits, 31), (6, 10, 3)).astype({8: "<u1", 16: "<u2", 32: "<u4"}[bits])
    page = tiff.read(handmade(order, values, bits, predictor, planar, big))[0]
    assert page.pixels == values.tobytes()


def test_a_loop_of_directories_ends():
    data = bytearray(tiff.write([np.zeros((2, 64), np.uint8)] * 2))
    first = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, first)[0]
    second = struct.unpack_from("<I", data, first + 2 + 12 * n)[0]
    m = struct.unpack_from("<H", data, second)[0]
    struct.pack_into("<I", data, second + 2 + 12 * m, first)
    assert len(tiff.read(bytes(data))) == 2


def test_bad_files_are_rows_with_an_error(spark):
    good = tiff.write([np.zeros((2, 64), np.uint8), np.ones((3, 5), np.uint8)])
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(b"")), (5, bytearray(good[:60]))], "doc_id long, media binary")
    rows = sorted(tiff.pages(media, keep=["doc_id"]).collect(), key=lambda r: (r.doc_id, r.page or 0))
    assert [(r.doc_id, r.page, r.error is None) for r in rows] == [(1, 0, True), (1, 1, True), (2, None, False), (3, None, False), (4, None, False), (5, None, False)]
    assert tiff.pages(media.limit(0), keep=["doc_id"]).count() == 0


def test_texts(spark):
    docs = edge_docs(spark)
    got = tiff.digests(docs).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((r.doc_id or -1, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert tiff.digests(empty_docs(spark)).count() == 0
