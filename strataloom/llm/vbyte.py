"""Token-id files: ids ranked by frequency, byte-aligned variable length, control bytes apart from data bytes.

A shard file holds a header, the documents' ids and lengths, their control bytes (one for each four tokens, two bits a
token: its rank's bytes less one; a document's last one is filled up with zeros) and the ranks' bytes. Frequent ids have
small ranks, so most take one byte. A reader looks up each control byte in a table of lengths and gathers the bytes with
numpy; it needs no loop over tokens.

Documents stand in ascending id order. Shards are ranges of ids, cut by quantiles of the ids alone; the rows of one id, or of
no id, that are too many for a shard are several shards. Files are written and read by any path that Arrow and Spark know.

File: b"SLVB", version (1 byte), 3 zero bytes, documents, control bytes, data bytes (8 bytes each); then doc ids (8 bytes
each), null flags (1 each), token counts (8 each), control bytes, data bytes. All little-endian. "ranks" holds the ids by
rank.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import _hadoop_path, get, materialize, new_path, put, release, small_batches
from .textscan import slices, text_buffers, tidied
from .tokens import SLICE, encoder

SHARD_TOKENS = 4_000_000
MOST_PARTITIONS = 20_000
MAGIC = b"SLVB\x01\0\0\0"
#: For each control byte, the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + n[i] - 1 for every i."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each document) of documents of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    padded[_ranges(4 * (np.cumsum(quads) - quads), counts)] = code
    padded = padded.reshape(-1, 4)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= code[:, None]]
    ends = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return control, data, np.diff(ends[bounds])


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All values of encode(), document after document."""
    quads = -(-counts // 4)
    lengths = LENGTHS[control].ravel()[_ranges(4 * (np.cumsum(quads) - quads), counts)]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[starts].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(lengths > j)
        if len(more):
            out[more] |= data[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def shard_file(docs: list, nulls: list, counts: list, controls: list[bytes], data: list[bytes]) -> bytes:
    """The bytes of one shard file, given each document's control and data bytes."""
    control, data = b"".join(controls), b"".join(data)
    head = MAGIC + struct.pack("<QQQ", len(docs), len(control), len(data))
    return head + np.array(docs, "<i8").tobytes() + np.array(nulls, np.uint8).tobytes() + np.array(counts, "<i8").tobytes() + control + data


def read_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, null flags, token counts, ranks) of a shard file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, quads, size = struct.unpack_from("<QQQ", blob, 8)
    raw, at = np.frombuffer(blob, np.uint8), 32
    docs, at = raw[at : at + 8 * n].copy().view("<i8"), at + 8 * n
    nulls, at = raw[at : at + n], at + n
    counts, at = raw[at : at + 8 * n].copy().view("<i8"), at + 8 * n
    return docs, nulls, counts, decode(raw[at : at + quads], raw[at + quads : at + quads + size], counts)


def _tokenized(path: str, end_id: int, wide: bool):
    """Each document's ids, in two bytes each if the vocabulary allows."""

    def run(batches):
        enc, tail = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                ids = [x + tail for x in enc.encode([x or "" for x in texts])]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                every = np.frombuffer(b"".join(ids), "<u4")
                raw, size = (every.tobytes(), 4) if wide else (every.astype("<u2").tobytes(), 2)
                bounds = np.concatenate([[0], np.cumsum(size * counts)]).astype(np.int64)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(counts), blobs.cast(pa.binary())], names=["doc_id", "tokens", "ids"])

    return tidied(run)


def _frequencies(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = text_buffers(batch.column(0))
            seen = np.bincount(data.view(kind))
            size = max(len(seen), len(total))
            total = np.pad(seen, (0, size - len(seen))) + np.pad(total, (0, size - len(total)))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    return tidied(run)


@dataclass(frozen=True)
class Shards:
    """Which shard a document goes to: buckets of ids, the first for null ids, and how many shards each bucket is."""

    bounds: np.ndarray  # the least id of each bucket after the second
    parts: np.ndarray  # shards of each bucket

    @property
    def count(self) -> int:
        return int(self.parts.sum())

    def bucket(self, ids: pa.Array) -> np.ndarray:
        at = 1 + np.searchsorted(self.bounds, ids.fill_null(0).to_numpy(), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at)

    def shard(self, ids: pa.Array, salt: np.ndarray) -> np.ndarray:
        bucket = self.bucket(ids)
        return (np.cumsum(self.parts) - self.parts)[bucket] + salt % self.parts[bucket]

    def numbered(self):
        """(bucket, doc_id, tokens) rows of (doc_id, tokens)."""

        def run(batches):
            for batch in batches:
                yield pa.record_batch([pa.array(self.bucket(batch.column(0)), pa.int64()), batch.column(0), batch.column(1)], names=["bucket", "doc_id", "tokens"])

        return tidied(run)


def _cuts(values: list[int]) -> np.ndarray:
    """Bounds from quantiles; a value that is several quantiles is a bucket of its own."""
    several = {x for x, y in zip(values, values[1:], strict=False) if x == y}
    return np.array(sorted(set(values) | {x + 1 for x in several}), np.int64)


def _quantiles(rows: DataFrame, n: int):
    at = [k / n for k in range(1, n)]
    return F.percentile_approx("doc_id", at, 20 * n) if at else F.array().cast("array<bigint>")


def _shards(tokens: DataFrame, shard_tokens: int) -> Shards:
    """Shards of about shard_tokens tokens for (doc_id, tokens).

    Quantiles of quantiles: each sketch holds the square root of the number of shards. What goes to the driver is a row for each shard.
    """
    rows = tokens.select("doc_id", "tokens")
    n = max(1, (rows.agg(F.sum("tokens").alias("n")).first().n or 0) // shard_tokens)
    k = math.ceil(math.sqrt(n))
    shape = "bucket long, doc_id long, tokens long"
    coarse = Shards(_cuts(rows.agg(_quantiles(rows, k).alias("q")).first().q or []), np.ones(1, np.int64))
    fine = rows.where("doc_id is not null").mapInArrow(coarse.numbered(), shape).groupBy("bucket").agg(_quantiles(rows, math.ceil(n / k)).alias("q")).collect()
    bounds = np.union1d(coarse.bounds, np.concatenate([np.zeros(0, np.int64), *(_cuts(r.q) for r in fine)]))
    cut = Shards(bounds, np.ones(len(bounds) + 2, np.int64))
    sizes = rows.mapInArrow(cut.numbered(), shape).groupBy("bucket").agg(F.sum("tokens").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    for r in sizes:
        if r.lo == r.hi:
            cut.parts[r.bucket] = max(1, r.n // shard_tokens)
    return cut


def _coded(kind: str, rank_of: np.ndarray, shards: Shards):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for lo, hi in slices(offsets):
                ids, counts = batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_numpy()
                shard = shards.shard(ids, batch.column(1).slice(lo, hi - lo).to_numpy())
                control, coded, sizes = encode(rank_of[data[offsets[lo] : offsets[hi]].view(kind)], counts)
                controls, coded, blobs, c, d = control.tobytes(), coded.tobytes(), [], 0, 0
                for n, size in zip((-(-counts // 4)).tolist(), sizes.tolist(), strict=True):
                    blobs.append(controls[c : c + n] + coded[d : d + size])
                    c, d = c + n, d + size
                yield pa.record_batch([ids, pa.array(shard, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "shard", "tokens", "code"])

    return tidied(run)


def write(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files of docs into a shared folder; returns the manifest (shard, file, docs, tokens).

    Documents stand in ascending id order, null ids first; rows of an equal id stand in any order, fixed once written. A
    null or empty text is its end id alone. Other columns are ignored; an empty table gives no file but the ranks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wide = _vocabulary(path) > 1 << 16
    kind = "<u4" if wide else "<u2"
    # The ids are kept for the second pass, because to tokenize again costs more than to read them.
    tokens = materialize(rows.mapInArrow(_tokenized(path, end_id, wide), "doc_id long, tokens long, ids binary"), "ids", "zstd")
    counted = tokens.select("ids").mapInArrow(_frequencies(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row for each id of the vocabulary.
    table = counted.orderBy(F.desc("n"), "id").select("id").toPandas().id.to_numpy(np.int64)
    ranks = np.zeros(int(table.max()) + 1 if len(table) else 1, np.uint32)
    ranks[table] = np.arange(len(table), dtype=np.uint32)
    fs, there = _hadoop_path(spark, folder)
    fs.mkdirs(there)
    put(f"{folder}/ranks", table.astype("<u4").tobytes())

    shards = _shards(tokens, shard_tokens)
    # A written row's place is the same whenever it is read, and differs for equal rows.
    salt = F.shiftrightunsigned(F.xxhash64("_metadata.file_name", "_metadata.row_index"), 1)
    coded = tokens.select("doc_id", salt.alias("salt"), "tokens", "ids").mapInArrow(_coded(kind, ranks, shards), "doc_id long, shard long, tokens long, code binary")

    def save(batches):
        open_, docs_, nulls, counts, controls, data = None, [], [], [], [], []

        def close():
            name = f"{open_:08d}.slvb"
            put(f"{folder}/{name}", shard_file(docs_, nulls, counts, controls, data))
            row = [pa.array([open_], pa.int64()), pa.array([name]), pa.array([len(docs_)], pa.int64()), pa.array([sum(counts)], pa.int64())]
            return pa.record_batch(row, names=["shard", "file", "docs", "tokens"])

        for batch in batches:
            for doc, s, tokens, code in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != open_:
                    if open_ is not None:
                        yield close()
                    open_, docs_, nulls, counts, controls, data = s, [], [], [], [], []
                quads = -(-tokens // 4)
                docs_.append(doc or 0)
                nulls.append(doc is None)
                counts.append(tokens)
                controls.append(code[:quads])
                data.append(code[quads:])
        if open_ is not None:
            yield close()

    # A partition for each shard, or for a few neighbours where there are very many.
    partitions = min(shards.count, MOST_PARTITIONS)
    placed = coded.repartitionById(partitions, F.expr(f"cast(shard * {partitions} div {shards.count} as int)"))
    ordered = placed.sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tokens", "code")
    manifest = materialize(ordered.mapInArrow(save, "shard long, file string, docs long, tokens long"), "manifest")
    release(tokens)
    return manifest


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def _read(folder: str):
    def run(pdfs):
        table = np.frombuffer(get(f"{folder}/ranks"), "<u4")
        for pdf in pdfs:
            for start, blob in zip(pdf.start, pdf.content, strict=True):
                docs, nulls, counts, ranks = read_shard(blob)
                ids, ends = table[ranks].astype("<u4"), np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                begins = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": start + begins, "n_tokens": counts, "ids_crc32": crc})
                out.loc[nulls.astype(bool), "doc_id"] = pd.NA
                yield out

    return tidied(run)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone but for the shards' order."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.slvb").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # One row for each shard file: the order is over files, not over documents.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("start"))
    return files.join(starts, "file").select("start", "content").mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs, written into a new shared folder and read back from its files.

    Nulls, repeated rows, other columns and empty tables are as in write().
    """
    folder = new_path(docs.sparkSession, "tokens")
    return read(write(docs, path, folder, **options), folder)
