"""TIFF media columns: write pages losslessly, walk image directories, decode strips and tiles, one row per page.

The reader takes either byte order, classic and big files, several directories (a chain or a loop ends at the first one seen
again), strips or tiles, chunky or planar samples of 8, 16 or 32 bits, no compression, LZW, deflate (both codes) or
PackBits, and horizontal differencing or floating-point prediction.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textscan import slices, text_buffers, tidied

# Fixed values of the file format: compression codes, and byte sizes and struct codes of field types.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES = 317, 322, 323, 324, 325
CHUNK_BYTES = 1 << 16
MOST_PIXELS = 1 << 31


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count n under 128 copies n + 1 bytes, one over 128 repeats a byte 257 - n times, 128 does nothing."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """The inverse of unpack_bits: runs of 3 or more as repeats, the rest as copies."""
    out, raw = bytearray(), np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]])) if len(raw) else np.zeros(0, int)
    pending = bytearray()

    def flush() -> None:
        for lo in range(0, len(pending), 128):
            part = pending[lo : lo + 128]
            out.append(len(part) - 1)
            out.extend(part)
        pending.clear()

    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(raw)], strict=False):
        n = hi - lo
        if n < 3:
            pending += data[lo:hi]
            continue
        flush()
        while n:
            take = min(n, 128)
            out += bytes([257 - take, data[lo]]) if take > 1 else bytes([0, data[lo]])
            n -= take
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, 256 clears, 257 ends, codes widen one entry early."""
    out, table, width = bytearray(), [], 9
    held, bits, before = 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not before:
            if code >= len(table):
                raise ValueError("LZW data doesn't start with a clear code")
            before = table[code]
            out += before
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        table.append(before + entry[:1])
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of lzw_decode."""
    out, held, bits = bytearray(), 0, 0
    table, width, size = {bytes([i]): i for i in range(256)}, 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        elif size == 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def _decompress(data: bytes, code: int, size: int) -> bytes:
    if code == NONE:
        out = data
    elif code == LZW:
        out = lzw_decode(data)
    elif code in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif code == PACKBITS:
        out = unpack_bits(data)
    else:
        raise ValueError(f"compression {code} isn't supported")
    if len(out) < size:
        raise ValueError(f"a strip or tile has {len(out)} of {size} bytes")
    return out[:size]


def _compress(data: bytes, code: int) -> bytes:
    if code in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    return {NONE: lambda x: x, LZW: lzw_encode, PACKBITS: pack_bits}[code](data)


@dataclass
class Page:
    """One image: its place in the chain of directories and its samples, little-endian, row by row."""

    index: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    pixels: bytes


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list], int]:
    """(values by tag, place of the next directory)."""
    count_code, entry, inline, off = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    n = struct.unpack_from(order + count_code, data, at)[0]
    at += struct.calcsize(count_code)
    out: dict[int, list] = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at + entry * i)
        count = struct.unpack_from(order + off, data, at + entry * i + 4)[0]
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        place = at + entry * i + 4 + struct.calcsize(off)
        if size * count > inline:
            place = struct.unpack_from(order + off, data, place)[0]
        if place + size * count > len(data):
            raise ValueError("a field points past the end of the file")
        values = struct.unpack_from(f"{order}{count}{code}", data, place)
        out[tag] = list(values)
    return out, struct.unpack_from(order + off, data, at + entry * n)[0]


def _unpredict(rows: np.ndarray, predictor: int, samples: int, dtype: np.dtype) -> np.ndarray:
    """Rows of samples from rows of stored bytes."""
    if predictor == 3:
        # Bytes are differenced over the row, then stand by significance, most significant first.
        n = rows.shape[0]
        raw = rows.reshape(n, -1, samples).copy()
        np.cumsum(raw, axis=1, dtype=np.uint8, out=raw)
        planes = raw.reshape(n, dtype.itemsize, -1)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).view(dtype.newbyteorder("<")).reshape(n, -1)
    values = rows.view(dtype)
    if predictor == 2:
        shaped = values.astype(dtype.newbyteorder("=")).reshape(len(rows), -1, samples)
        values = np.cumsum(shaped, axis=1, dtype=shaped.dtype).reshape(len(rows), -1)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return values


def read(data: bytes) -> list[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    version = struct.unpack_from(order + "H", data, 2)[0] if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    pages: list[Page] = []
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        fields, at = _fields(data, at, order, big)
        one = lambda tag, default=None, fields=fields: fields.get(tag, [default])[0]
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, code, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if bits not in (8, 16, 32) or not width or not height or width * height * samples * bits // 8 > MOST_PIXELS:
            raise ValueError("a page has a shape that isn't supported")
        dtype = np.dtype({8: "u1", 16: "u2", 32: "f4" if predictor == 3 else "u4"}[bits]).newbyteorder(order)
        planar = one(PLANAR, 1) == 2 and samples > 1
        tiled = TILES in fields
        w, h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(STRIP_ROWS, height), height))
        offsets, sizes = (fields[TILES], fields[TILE_BYTES]) if tiled else (fields[STRIPS], fields[STRIP_BYTES])
        per, planes = (1, samples) if planar else (samples, 1)
        across, down = -(-width // w), -(-height // h)
        if len(offsets) < across * down * planes or len(sizes) < len(offsets):
            raise ValueError("a page lacks strips or tiles")
        image = np.zeros((height, width, samples), dtype.newbyteorder("<"))
        for i in range(across * down * planes):
            plane, cell = divmod(i, across * down)
            y, x = cell // across * h, cell % across * w
            rows = h if tiled else min(h, height - y)
            stored = _decompress(data[offsets[i] : offsets[i] + sizes[i]], code, rows * w * per * bits // 8)
            values = _unpredict(np.frombuffer(stored, np.uint8).reshape(rows, -1), predictor, per, dtype).reshape(rows, w, per)
            part = values[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1], plane : plane + per] = part
        pages.append(Page(len(pages), width, height, bits, samples, code, predictor, image.tobytes()))
    return pages


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int | None = None, tile: tuple[int, int] | None = None, chunk: int = CHUNK_BYTES) -> bytes:
    """A little-endian file of 8-bit pages (height, width) or (height, width, samples).

    Strips have `chunk` bytes or less (at least a row); tile is a (width, length) in multiples of 16. Without a predictor
    given, a page is differenced if that lowers the entropy of its bytes.
    """
    body, directories = bytearray(b"II*\0\0\0\0\0"), []
    for page in pages:
        page = page.reshape(*page.shape[:2], -1)
        height, width, samples = page.shape
        diffs = np.diff(page, axis=1, prepend=np.zeros((height, 1, samples), np.uint8))
        chosen = predictor or (2 if _entropy(diffs) < _entropy(page) else 1)
        w, h = tile or (width, max(1, chunk // (width * samples)))
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = page[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if chosen == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1, samples), np.uint8))
                stored = _compress(part.tobytes(), compression)
                offsets.append(len(body))
                sizes.append(len(stored))
                body += stored + b"\0" * (len(stored) % 2)
        tags = {WIDTH: [width], LENGTH: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [chosen]}
        tags |= {TILE_WIDTH: [w], TILE_LENGTH: [h], TILES: offsets, TILE_BYTES: sizes} if tile else {STRIPS: offsets, STRIP_ROWS: [h], STRIP_BYTES: sizes}
        directories.append(tags)
    link = 4
    for tags in directories:
        entries = bytearray()
        for tag in sorted(tags):
            values = tags[tag]
            raw = struct.pack(f"<{len(values)}I", *values) if tag not in (BITS,) else struct.pack(f"<{len(values)}H", *values)
            kind = 3 if tag == BITS else 4
            if len(raw) > 4:
                raw, place = struct.pack("<I", len(body)), raw
                body += place + b"\0" * (len(place) % 2)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(tags)) + entries
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def _entropy(x: np.ndarray) -> float:
    p = np.bincount(x.ravel(), minlength=256)
    p = p[p > 0] / max(1, x.size)
    return float(-(p * np.log2(p)).sum())


def text_page(data: bytes) -> np.ndarray:
    """Bytes as an image 64 wide, closed with zeros to a positive multiple of 64."""
    size = max(64, -(-len(data) // 64) * 64)
    return np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, 64)


def _store():
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                raw, sizes, media = data[offsets[lo] : offsets[hi]].tobytes(), [], []
                for a, b in zip((offsets[lo:hi] - offsets[lo]).tolist(), (offsets[lo + 1 : hi + 1] - offsets[lo]).tolist(), strict=True):
                    sizes.append(b - a)
                    # Texts of several chunks are tiled, so that a reader can take a part of them.
                    media.append(write([text_page(raw[a:b])], tile=(64, 1024) if b - a > CHUNK_BYTES else None))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return tidied(run)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text in UTF-8 as a one-page file; a null text is empty, one row of zeros."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store(), "doc_id long, n_bytes long, media binary")


#: Output columns of pages(), after the ones kept.
PAGE = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, feature string, error string"


def feature(page: Page) -> str:
    """Shape, mean, and counts of samples in eight equal ranges (of the upper byte)."""
    x = np.frombuffer(page.pixels, {8: "<u1", 16: "<u2", 32: "<u4"}[page.bits])
    upper = (x >> (page.bits - 3)).astype(np.uint8)
    counts = np.bincount(upper, minlength=8)
    return f"{page.width}x{page.height}x{page.samples};mean={int(x.sum(dtype=np.uint64)) * 1000 // max(1, len(x))};hist={'-'.join(map(str, counts))}"


def _pages(media: int, keep: list[int]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, rows = [], []
                for i, blob in enumerate(part.column(media)):
                    data = blob.as_py()
                    try:
                        found, error = ([], None) if data is None else (read(data), None)
                    except (ValueError, KeyError, TypeError, struct.error, zlib.error) as e:
                        found, error = [], str(e)[:200]
                    for p in found:
                        owner.append(i)
                        rows.append((p.index, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.pixels, feature(p), None))
                    if not found:
                        owner.append(i)
                        rows.append((*[None] * 9, error or "no page"))
                kinds = [*[pa.int32()] * 7, pa.binary(), pa.string(), pa.string()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                kept = [part.column(c).take(pa.array(owner, pa.int64())) for c in keep]
                yield pa.record_batch(kept + made, names=[str(i) for i in range(len(keep) + len(made))])

    return tidied(run)


def pages(media: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each file: the columns in `keep`, then page, width, height, bits, samples, compression,
    predictor, pixels, feature, error.

    A null file, an empty one or one that can't be read gives one row with no page and an error. Repeated rows give
    repeated pages. Columns not in `keep` are dropped, so their names can't clash.
    """
    keep = keep or []
    rows = media.select(*keep, F.col(media_col).alias("_media"))
    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), PAGE])
    return rows.mapInArrow(_pages(len(keep), list(range(len(keep)))), shape)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored texts."""
    stored = store_texts(docs, id_col, text_col).select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    rows = pages(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.expr("crc32(substring(pixels, octet_length(pixels) - 63, 64))")
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
