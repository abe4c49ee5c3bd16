"""Sequence packing: shortest-pack-first over the length histogram, patterns joined back to documents by rank.

Documents are tokenized, closed with an end id and cut at multiples of the sequence length; what is left of each is
shorter than a sequence. The driver sees only the histogram of piece lengths, at most `capacity` rows whatever the corpus.
It places lengths longest first, each into the shortest pack that still fits, for all documents of a length at once, so
that it updates counts of packing patterns and never sees a document. Each piece then gets its rank within its length
(counted within hash buckets of the written rows' places, so that neither the most frequent length nor a repeated id is a
single task), and rank ranges map pieces to slots.
"""

from __future__ import annotations

import zlib
from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, small_batches
from .textscan import slices, text_buffers, tidied
from .tokens import MOST_CHUNKS, SLICE, encoder

PIECES_PER_BUCKET = 250_000
MIN_BUCKETS = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end_id: int, most_chunks: int = MOST_CHUNKS, most_bytes: int = SLICE):
    def run(batches):
        enc, tail = encoder(path, most_chunks), end_id.to_bytes(4, "little")
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, most_bytes):
                ids, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                rows = []
                for doc, tokens in zip(ids, enc.encode([x or "" for x in texts]), strict=True):
                    tokens = memoryview(tokens + tail)
                    n = len(tokens) // 4
                    for at in range(0, n, capacity):
                        part = tokens[4 * at : 4 * (at + capacity)]
                        rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return tidied(run)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(count, ((length, copies), ...)), ...]: how many packs follow each pattern."""
    packs: dict[int, list[tuple[int, tuple]]] = {}
    totals: list[int] = []

    def add(total: int, count: int, pattern: tuple) -> None:
        if count:
            if total not in packs:
                packs[total] = []
                insort(totals, total)
            packs[total].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            if totals and totals[0] + length <= capacity:
                total = totals[0]
                count, pattern = packs[total].pop()
                if not packs[total]:
                    del packs[total]
                    totals.pop(0)
                take = min(count, left)
                add(total, count - take, pattern)
                same = pattern[-1][0] == length
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if same else (*pattern, (length, 1))
                add(total + length, take, grown)
                left -= take
            else:
                # One by one, the next piece of this length would join the pack just opened, as the shortest.
                each = capacity // length
                add(each * length, left // each, ((length, each),))
                add(left % each * length, 1 if left % each else 0, ((length, left % each),))
                left = 0
    return [x for total in sorted(packs, reverse=True) for x in packs[total]]


def _slots(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, copies, first sequence, offset) for each length of each pattern."""
    out, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        at = 0
        for length, copies in pattern:
            lo = ranks.get(length, 0)
            ranks[length] = lo + count * copies
            out.append((length, lo, ranks[length], copies, sequence, at))
            at += length * copies
        sequence += count
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, most_chunks: int = MOST_CHUNKS, most_bytes: int = SLICE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of docs.

    A null or empty text is its end id alone. A document longer than `capacity` gives several pieces. Equal rows give
    equal pieces in different slots; which of them gets which is arbitrary but fixed once written. A null id stays null;
    other columns are ignored; an empty table gives an empty result. most_chunks bounds what a worker remembers, most_bytes the
    texts that it encodes together; neither changes a result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(path, capacity, end_id, most_chunks, most_bytes), PIECE), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(shortest_pack_first(histogram, capacity))
    buckets = max(MIN_BUCKETS, sum(histogram.values()) // PIECES_PER_BUCKET)
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A written row's file and place in it are the same whenever it is read, and differ for equal rows.
    pieces = pieces.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("file", "row"), F.lit(buckets)))
    before = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = before.select("bucket", "length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "length").orderBy("file", "row")
    ranked = pieces.withColumn("place", F.row_number().over(inside) - 1).join(before, ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    table = spark.createDataFrame(slots, "slot_length long, lo long, hi long, copies long, first_sequence long, at long")
    # At most a few entries for each of `capacity` lengths, so its size doesn't follow the corpus.
    table = F.broadcast(table) if len(slots) <= 64 * capacity else table
    placed = ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    within = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - lo) div copies")).alias("sequence_id"),
        (F.col("at") + within % F.col("copies") * F.col("length")).alias("offset"),
    )
