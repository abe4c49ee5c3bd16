"""Interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted arrays, memory-mapped by workers.

The vocabulary is a sorted array of 64-bit word hashes, cut into shards by hash range, with each word's id. Frequent words have
small ids, so that blocks of them are compressed well: ids go by quarters of the count's logarithm, shard and hash. A
bigram's key is (id of its first word) * 2^32 + (id of its second); its shard is a hash of the key, so that neither a
frequent word nor a frequent pair makes a large shard. A shard has its bigrams' sorted keys, and for each the range of its
followers in the shard's array of trigrams, which are sorted third words. Texts start with two start signs and close with one end.

Tasks count within a slice of text and send each shard one compressed block, so that a frequent n-gram is one entry for each
slice, not one for each use. Trigrams have their counts; a bigram has the number of distinct words before it, or its count
where it starts a text; a word has the number of distinct words before it. Log-probabilities and backoff weights are
16-bit fixed-point arrays beside the keys. Workers map the arrays of a shard when they look something up; none is loaded, sent
to the driver or broadcast. What goes to the driver is a few rows of totals for each shard.
"""

from __future__ import annotations

import contextlib
import math
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import brief_shuffles, local_shared_path, new_path, small_batches
from .textscan import Words, mix, slices, stream, text_buffers, tidied

END = stream(11, 1)[0]
WORDS_PER_SHARD = 4_000_000
MIN_SHARDS = 16
SLICE = 1 << 22
MOST_MAPS = 20_000
#: Fixed-point steps of a unit of log10; 16 bits reach down to 10^-32.
STEPS = 2048
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
_CODEC = "zstd"


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BQ", x.dtype.itemsize, len(x)) for x in arrays)
    planes = np.concatenate([x.astype(f"<u{x.dtype.itemsize}").view(np.uint8).reshape(len(x), x.dtype.itemsize).T.ravel() for x in arrays])
    return head + pa.Codec(_CODEC, 1).compress(planes.tobytes(), asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = blob[0]
    shapes = [struct.unpack_from("<BQ", blob, 1 + 9 * i) for i in range(n)]
    raw = np.frombuffer(pa.Codec(_CODEC).decompress(blob[1 + 9 * n :], sum(a * b for a, b in shapes), asbytes=True), np.uint8)
    out, at = [], 0
    for size, length in shapes:
        out.append(np.ascontiguousarray(raw[at : at + size * length].reshape(size, length).T).view(f"<u{size}").ravel())
        at += size * length
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _heads(x: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_heads(x)]


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    heads = _heads(x)
    return x[heads], np.diff(np.append(heads, len(x)))


def _merge(blobs) -> tuple[np.ndarray, np.ndarray]:
    """The sum of blocks of (steps of keys, counts), as sorted keys and counts."""
    parts = [_unpack(x) for x in blobs]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = _heads(keys)
    return keys[heads], np.add.reduceat(counts, heads)


def _ranged(keys: np.ndarray, cuts: np.ndarray, *values: np.ndarray):
    """(shard, block) rows of sorted keys; cuts has the first key of each shard after the first."""
    at = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    for s in range(len(cuts) + 1):
        lo, hi = at[s], at[s + 1]
        if hi > lo:
            yield s, _pack(_steps(keys[lo:hi]), *(v[lo:hi] for v in values))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys) >> HALF) * np.uint64(shards) >> HALF).astype(np.uint16 if shards <= 1 << 16 else np.uint32)


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by their shards, ends of the shards in it); keys stay sorted within a shard."""
    of = shard_of(keys, shards)
    return np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=shards))])


def _split(keys: np.ndarray, counts: np.ndarray, shards: int):
    """(shard, block) rows of sorted keys and their counts."""
    order, at = _dealt(keys, shards)
    keys, counts = keys[order], counts[order].astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)
    for s in np.flatnonzero(np.diff(at)).tolist():
        yield s, _pack(_steps(keys[at[s] : at[s + 1]]), counts[at[s] : at[s + 1]])


def _bytes_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, count of at most 255, index of the value): a larger count is several values."""
    if not len(counts) or counts.max() <= 255:
        return words, counts.astype(np.uint8), np.arange(len(counts))
    n = -(-counts // 255)
    index = np.repeat(np.arange(len(counts)), n)
    part = np.full(len(index), 255, np.int64)
    ends = np.cumsum(n)
    part[ends - 1] = counts - 255 * (n - 1)
    return words[index], part.astype(np.uint8), index


def _triple_blocks(contexts: np.ndarray, words: np.ndarray, shards: int):
    """(shard, block) of a slice's trigrams: steps of distinct contexts, entries of each, third words, counts."""
    if not len(words):
        return
    distinct, place = np.unique(contexts, return_inverse=True)
    order, at = _dealt(distinct, shards)
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    both, counts = _counted((rank[place] << HALF) | words)
    both, counts, _ = _bytes_of(both, counts)
    place = (both >> HALF).astype(np.int64)
    sizes = np.bincount(place, minlength=len(order)).astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    words, keys = (both & LOW).astype(np.uint32), distinct[order]
    for s in np.flatnonzero(np.diff(at)).tolist():
        lo, hi = at[s], at[s + 1]
        yield s, _pack(_steps(keys[lo:hi]), sizes[lo:hi], words[ends[lo] : ends[hi]], counts[ends[lo] : ends[hi]])


def _merge_triples(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted contexts, bounds of their entries, third words, counts) of blocks; at most 2^24 contexts."""
    parts = [_unpack(x) for x in blobs]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in parts]
    contexts = _distinct(np.concatenate(keys))
    if len(contexts) >= 1 << 24:
        raise ValueError("a shard has too many contexts; WORDS_PER_SHARD is too large")
    # Place, word and count of an entry are one number, so that one sort of plain numbers merges all.
    values = np.concatenate([(np.repeat(np.searchsorted(contexts, k).astype(np.uint64), x[1]) << np.uint64(40)) | (x[2].astype(np.uint64) << np.uint64(8)) | x[3] for k, x in zip(keys, parts, strict=True)])
    values.sort()
    counts = (values & np.uint64(255)).astype(np.uint64)
    values >>= np.uint64(8)
    heads = _heads(values)
    counts, values = np.add.reduceat(counts, heads), values[heads]
    bounds = np.searchsorted(values, np.arange(len(contexts) + 1, dtype=np.uint64) << HALF)
    return contexts, bounds, (values & LOW).astype(np.uint32), counts


def _save(path: str, **arrays: np.ndarray) -> None:
    """Write arrays under path-name; a rename makes each file appear whole, also if a task runs twice."""
    for name, x in arrays.items():
        part = f"{path}.{name}.{uuid.uuid4().hex}"
        x.tofile(part)
        os.replace(part, f"{path}.{name}")


def _save_counts(path: str, counts: np.ndarray) -> None:
    """Counts in a byte each; those of 255 or more stand again in full."""
    many = np.flatnonzero(counts >= 255)
    _save(path, count=np.minimum(counts, 255).astype(np.uint8), many=many.astype(np.uint64), full=counts[many].astype(np.uint64))


def _counts(path: str) -> np.ndarray:
    out = np.array(_map(path, "count", np.uint8)).astype(np.float64)
    out[_map(path, "many", np.uint64).astype(np.int64)] = _map(path, "full", np.uint64)
    return out


def _map(path: str, name: str, kind) -> np.ndarray:
    file = f"{path}.{name}"
    return np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind)


def _rank(counts: np.ndarray) -> np.ndarray:
    """Quarters of the logarithm of counts of 1 or more."""
    return np.floor(4 * np.log2(counts.astype(np.float64))).astype(np.int16)


def _fixed(log: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEPS * log), 65535).astype(np.uint16)


@dataclass
class Model:
    """Where the arrays are, and the totals. Sent to workers.

    Arrays of a shard: v hash, count and id of words; u by word id log-probability, backoff weight and sum of counts; c the keys of
    bigrams that something follows; e those of bigrams that only an end makes; t the third words.
    """

    folder: str
    word_shards: int
    shards: int
    vocabulary: int = 0
    tokens: int = 0
    unknown: float = 0.0

    @property
    def start(self) -> np.uint64:
        """The key of the two start signs."""
        return np.uint64(self.vocabulary << 32 | self.vocabulary)

    @property
    def hash_cuts(self) -> np.ndarray:
        n = self.word_shards
        return np.array([(s << 64) // n for s in range(1, n)], np.uint64)

    @property
    def id_cuts(self) -> np.ndarray:
        """The first id of each id shard after the first; ids run to the vocabulary's size, that of the start sign."""
        return np.array([s * (self.vocabulary + 1) // self.shards for s in range(1, self.shards)], np.uint64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, training counts) of sorted distinct hashes; vocabulary + 1 and 0 for unknown words."""
        ids, counts = np.full(len(hashes), self.vocabulary + 1, np.uint64), np.zeros(len(hashes), np.int64)
        at = np.concatenate([[0], np.searchsorted(hashes, self.hash_cuts), [len(hashes)]])
        for s in np.flatnonzero(np.diff(at)).tolist():
            have = self._cached(f"v{s}", "hash", np.uint64)
            if len(have):
                want = hashes[at[s] : at[s + 1]]
                pos = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[pos] == want
                ids[at[s] : at[s + 1]][hit] = self._cached(f"v{s}", "id", np.uint32)[pos[hit]]
                counts[at[s] : at[s + 1]][hit] = self._cached(f"v{s}", "count", np.uint64)[pos[hit]]
        return ids, counts

    def of_ids(self, name: str, kind, ids: np.ndarray, missing) -> np.ndarray:
        """Values that arrays by id hold."""
        out = np.full(len(ids), missing, kind)
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        at = np.concatenate([[0], np.searchsorted(ranked, self.id_cuts), [np.searchsorted(ranked, np.uint64(self.vocabulary + 1))]])
        lows = np.concatenate([[0], self.id_cuts]).astype(np.int64)
        for s in range(self.shards):
            if at[s + 1] > at[s]:
                rows = order[at[s] : at[s + 1]]
                out[rows] = self._cached(f"u{s}", name, kind)[ranked[at[s] : at[s + 1]].astype(np.int64) - lows[s]]
        return out

    def bigrams(self, keys: np.ndarray, followed: bool = False) -> list[np.ndarray]:
        """[log10 probability] of sorted distinct keys, NaN where unseen; with followed also backoff weight, shard and bounds
        of the followers."""
        logp = np.full(len(keys), np.nan, np.float32)
        extra = [np.zeros(len(keys), np.float32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
        order, at = _dealt(keys, self.shards)
        for s in np.flatnonzero(np.diff(at)).tolist():
            rows = order[at[s] : at[s + 1]]
            want = keys[rows]
            for part in ("c", "e"):
                have = self._cached(f"{part}{s}", "key", np.uint64)
                if not len(have) or not len(rows):
                    continue
                pos = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[pos] == want
                found, pos = rows[hit], pos[hit]
                logp[found] = self._cached(f"{part}{s}", "logp", np.uint16)[pos] * np.float32(-1 / STEPS)
                if followed and part == "c":
                    bounds = self._cached(f"c{s}", "bound", np.uint32)
                    extra[0][found] = self._cached(f"c{s}", "back", np.uint16)[pos] * np.float32(-1 / STEPS)
                    extra[1][found], extra[2][found], extra[3][found] = s, bounds[pos], bounds[pos + 1]
                rows, want = rows[~hit], want[~hit]
        return [logp, *extra] if followed else [logp]

    def trigrams(self, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probabilities of words among the followers lo..hi of a bigram of a shard; NaN where unseen."""
        out = np.full(len(words), np.nan, np.float32)
        full = np.flatnonzero(hi > lo)
        full = full[np.argsort(shard[full].astype(np.uint16 if self.shards <= 1 << 16 else np.uint32), kind="stable")]
        at = np.searchsorted(shard[full], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(at)).tolist():
            rows = full[at[s] : at[s + 1]]
            have, a, b, want = self._cached(f"t{s}", "word", np.uint32), lo[rows], hi[rows], words[rows]
            open_ = np.arange(len(rows))
            # All are halved at once; those of few followers are done first.
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                less = have[mid] < want[open_]
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
                open_ = open_[a[open_] < b[open_]]
            end = hi[rows]
            inside = np.flatnonzero(a < end)
            inside = inside[have[a[inside]] == want[inside]]
            out[rows[inside]] = self._cached(f"t{s}", "logp", np.uint16)[a[inside]] * np.float32(-1 / STEPS)
        return out

    def _cached(self, shard: str, name: str, kind) -> np.ndarray:
        maps = _MAPS.setdefault(self.folder, {})
        if (shard, name) not in maps:
            for other in [x for x in _MAPS if x != self.folder]:
                del _MAPS[other]
            if len(maps) >= MOST_MAPS:
                maps.clear()
            maps[shard, name] = _map(f"{self.folder}/{shard}", name, kind)
        return maps[shard, name]


_MAPS: dict[str, dict] = {}


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one end for each document, each document's first token) of a slice."""
    words = Words(data, offsets)
    tokens = np.insert(words.hashes, words.first[1:], END)
    return tokens, words.first + np.arange(len(words.first))


def _count_words(cuts: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in slices(offsets, SLICE):
                keys, counts = _counted(_sequences(data, offsets[lo : hi + 1])[0])
                for shard, block in _ranged(keys, cuts, counts.astype(np.uint32)):
                    yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.binary())], names=["shard", "block"])

    return tidied(run)


def _ids_of(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of distinct words, their training counts, each token's place among them)."""
    distinct, place = np.unique(tokens, return_inverse=True)
    return *model.ids(distinct), place


def _pairs(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it."""
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[first[:-1]] = model.vocabulary
    return (before << HALF) | ids


def _contexts(model: Model, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The key of the two tokens before each."""
    out = np.empty(len(pairs), np.uint64)
    out[1:] = pairs[:-1]
    out[first[:-1]] = model.start
    return out


def _count_triples(model: Model):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in slices(offsets, SLICE):
                tokens, first = _sequences(data, offsets[lo : hi + 1])
                known, _, place = _ids_of(model, tokens)
                ids = known[place]
                contexts = _contexts(model, _pairs(model, ids, first), first)
                for shard, block in _triple_blocks(contexts, ids, model.shards):
                    yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.binary())], names=["shard", "block"])

    return tidied(run)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(1), D(2), D(3 and more) after Chen and Goodman; (0.5, 1, 1.5) where the counts of counts give none."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (d > 0).all() and d[0] <= 1 and d[1] <= 2 and d[2] <= 3:
            return np.concatenate([[0.0], d])
    return np.array([0.0, 0.5, 1.0, 1.5])


def _grouped(rows: DataFrame, key: str, parts: int, step, schema: str) -> DataFrame:
    """step(pandas rows of one key) for each key; keys are numbered, and each of `parts` tasks has one, or a few in turn."""
    names = rows.columns

    def run(batches):
        at, held = None, []
        for batch in batches:
            keys = batch.column(names.index(key)).to_numpy()
            bounds = np.append(_heads(keys), len(keys))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if keys[lo] != at and held:
                    yield from done(held)
                    held = []
                at = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(held)

    def done(held):
        out = step(pa.Table.from_batches(held).to_pandas())
        yield from pa.Table.from_pandas(out, _arrow(schema), preserve_index=False).to_batches()

    return rows.repartitionById(parts, F.pmod(key, F.lit(parts)).cast("int")).sortWithinPartitions(key).mapInArrow(tidied(run), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


ROW = "to int, kind int, block binary, total long, n1 long, n2 long, n3 long, n4 long, more long"
_FIELDS = ["to", "kind", "block", "total", "n1", "n2", "n3", "n4", "more"]
#: `to` of rows that hold an order's totals and go on to the driver.
TOTALS = -1


def _totals(order: int, counts: np.ndarray) -> tuple:
    return (TOTALS, order, None, int(counts.sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()))


def _blocks_to(kind: int, blocks) -> list[tuple]:
    return [(s, kind, block, 0, 0, 0, 0, 0, 0) for s, block in blocks]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FIELDS).astype({"to": "int32", "kind": "int32"})


def train(texts: DataFrame, column: str = "text") -> Model:
    """The model of all rows of texts (null: empty). An empty table gives a model that knows no word."""
    spark = texts.sparkSession
    small_batches(spark)
    brief_shuffles(spark)
    texts = texts.select(F.col(column).cast("string").alias("text"))
    place = new_path(spark, "kneser-ney")
    folder = local_shared_path(spark, place)
    os.makedirs(folder, exist_ok=True)
    least = max(MIN_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    # Vocabularies grow by a power of the text under one.
    n = max(least, math.ceil((size / (1 << 26)) ** 0.75))
    model = Model(folder, n, least)

    def vocabulary(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.shard.iloc[0])
        keys, counts = _merge(pdf.block)
        _save(f"{folder}/v{s}", hash=keys, count=counts)
        of = _rank(counts)
        sizes = np.bincount(of)
        return pd.DataFrame({"shard": s, "rank": np.arange(len(sizes)), "n": sizes, "tokens": np.bincount(of, counts.astype(np.float64)).astype(np.int64)})

    blocks = texts.mapInArrow(_count_words(model.hash_cuts), "shard int, block binary")
    ranks = _grouped(blocks, "shard", n, vocabulary, "shard int, rank int, n long, tokens long").where("n > 0").collect()
    before, model.tokens = {}, sum(r.tokens for r in ranks)
    for r in sorted(ranks, key=lambda r: (-r.rank, r.shard)):
        before[r.shard, r.rank] = model.vocabulary
        model.vocabulary += r.n
    if model.vocabulary >= (1 << 32) - 2:
        raise ValueError("ids of 32 bits don't hold this vocabulary")
    model.shards = shards = max(least, math.ceil(model.tokens / WORDS_PER_SHARD))
    lows = np.concatenate([[0], model.id_cuts]).astype(np.int64)
    highs = np.append(lows[1:], model.vocabulary + 1)

    def empty(s: int) -> None:
        none = np.zeros(0, np.uint64)
        for part in ("c", "e", "t"):
            _save(f"{folder}/{part}{s}", key=none, word=none, bound=np.zeros(1, np.uint32), logp=none, back=none)
            _save_counts(f"{folder}/{part}{s}", none)
        _save(f"{folder}/u{s}", **{x: np.zeros(highs[s] - lows[s], np.float64 if x == "sum" else np.uint32) for x in ("cont", "sum", "n1", "n2", "n3")})

    def each_shard(step, number: int = shards) -> None:
        """step(s) for every shard, on the cluster."""

        def run(batches):
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    step(s)
                    yield pa.record_batch([pa.array([s], pa.int64())], names=["id"])

        spark.range(0, number, 1, number).mapInArrow(tidied(run), "id long").write.format("noop").mode("overwrite").save()

    def triples(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.shard.iloc[0])
        contexts, bounds, words, counts = _merge_triples(pdf.block)
        _save(f"{folder}/c{s}", key=contexts, bound=bounds.astype(np.uint32))
        _save(f"{folder}/t{s}", word=words)
        _save_counts(f"{folder}/t{s}", counts)
        keys = (np.repeat(contexts & LOW, np.diff(bounds)) << HALF) | words
        rows = [_totals(3, counts)]
        at = np.searchsorted(contexts, model.start)
        if at < len(contexts) and contexts[at] == model.start:
            # What starts a text counts as often as it does so.
            lo, hi = bounds[at], bounds[at + 1]
            rows += _blocks_to(2, _split(keys[lo:hi], counts[lo:hi], shards))
            keys = np.delete(keys, np.s_[lo:hi])
        rows += _blocks_to(2, _split(*_counted(keys), shards))
        return _frame(rows)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.to.iloc[0])
        if s == TOTALS:
            return pdf
        keys, counts = _merge(pdf.block)
        have = np.asarray(_map(f"{folder}/c{s}", "key", np.uint64))
        pos = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        hit = have[pos] == keys if len(have) else np.zeros(len(keys), bool)
        own = np.zeros(len(have), np.uint64)
        own[pos[hit]] = counts[hit]
        _save_counts(f"{folder}/c{s}", own)
        _save(f"{folder}/e{s}", key=keys[~hit])
        _save_counts(f"{folder}/e{s}", counts[~hit])
        before = keys >> HALF
        heads = _heads(before)
        stats = [np.add.reduceat(x.astype(np.uint64), heads) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        words, preceded = _counted(keys & LOW)
        rows = [_totals(2, counts), *_blocks_to(1, _ranged(words, model.id_cuts, preceded.astype(np.uint32)))]
        rows += _blocks_to(0, _ranged(before[heads], model.id_cuts, stats[0], *(x.astype(np.uint32) for x in stats[1:])))
        return _frame(rows)

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.to.iloc[0])
        if s == TOTALS:
            return pdf
        dense = {x: np.zeros(highs[s] - lows[s], np.float64 if x == "sum" else np.uint32) for x in ("cont", "sum", "n1", "n2", "n3")}
        for kind, block in zip(pdf.kind, pdf.block, strict=True):
            steps, *values = _unpack(block)
            at = np.cumsum(steps, dtype=np.uint64).astype(np.int64) - lows[s]
            for name, x in zip(("cont",) if kind == 1 else ("sum", "n1", "n2", "n3"), values, strict=True):
                dense[name][at] += x.astype(dense[name].dtype)
        _save(f"{folder}/u{s}", **dense)
        return _frame([_totals(1, dense["cont"])])

    def numbered(s: int) -> None:
        counts = np.asarray(_map(f"{folder}/v{s}", "count", np.uint64))
        of = _rank(counts)
        order = np.argsort(of, kind="stable")
        ids, sizes = np.empty(len(of), np.uint32), np.bincount(of)
        for rank, (size, end) in enumerate(zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)):
            if size:
                ids[order[end - size : end]] = before[s, rank] + np.arange(size)
        _save(f"{folder}/v{s}", id=ids)

    for s in set(range(n)) - {r.shard for r in ranks}:
        _save(f"{folder}/v{s}", hash=np.zeros(0, np.uint64), count=np.zeros(0, np.uint64))
    each_shard(numbered, n)
    each_shard(empty)
    counted = _grouped(texts.mapInArrow(_count_triples(model), "shard int, block binary"), "shard", shards, triples, ROW)
    counted = _grouped(_grouped(counted, "to", shards, pairs, ROW), "to", shards, words, ROW)
    sums = [r for r in counted.drop("block").collect() if r.to == TOTALS]
    total = {k: {f: sum(r[f] for r in sums if r.kind == k) for f in ("total", "n1", "n2", "n3", "n4", "more")} for k in (1, 2, 3)}
    cut = {k: discounts(*(t[f] for f in ("n1", "n2", "n3", "n4"))) for k, t in total.items()}
    spare = sum(d * total[1][f] for d, f in zip(cut[1][1:], ("n1", "n2", "more"), strict=True))
    model.unknown = (spare / total[1]["total"] if total[1]["total"] else 1.0) / (model.vocabulary + 1)

    def word_logs(s: int) -> None:
        u = {x: np.asarray(_map(f"{folder}/u{s}", x, np.float64 if x == "sum" else np.uint32)).astype(np.float64) for x in ("cont", "sum", "n1", "n2", "n3")}
        p = np.maximum(u["cont"] - cut[1][np.minimum(u["cont"], 3).astype(np.int64)], 0) / max(total[1]["total"], 1) + model.unknown
        back = np.divide(cut[2][1] * u["n1"] + cut[2][2] * u["n2"] + cut[2][3] * u["n3"], u["sum"], out=np.ones(len(p)), where=u["sum"] > 0)
        _save(f"{folder}/u{s}", logp=np.log10(p).astype(np.float32), back=np.log10(back).astype(np.float32))

    def pair_logs(s: int) -> None:
        for part in ("c", "e"):
            path = f"{folder}/{part}{s}"
            keys, counts = np.asarray(_map(path, "key", np.uint64)), _counts(path)
            # Where no bigram came to a shard, its contexts are the start signs alone.
            counts = counts if len(counts) else np.zeros(len(keys))
            before = keys >> HALF
            sums_ = model.of_ids("sum", np.float64, before, 0.0)
            back = 10.0 ** model.of_ids("back", np.float32, before, np.float32(0)).astype(np.float64)
            low = 10.0 ** model.of_ids("logp", np.float32, keys & LOW, np.float32(math.log10(model.unknown))).astype(np.float64)
            p = np.maximum(counts - cut[2][np.minimum(counts, 3).astype(np.int64)], 0) / np.maximum(sums_, 1) + back * low
            _save(path, logp=_fixed(np.log10(p)))

    def triple_logs(s: int) -> None:
        keys, bounds, third = (np.asarray(_map(f"{folder}/{part}{s}", x, kind)) for part, x, kind in (("c", "key", np.uint64), ("c", "bound", np.uint32), ("t", "word", np.uint32)))
        counts, of = _counts(f"{folder}/t{s}"), np.repeat(np.arange(len(keys)), np.diff(bounds.astype(np.int64)))
        less = cut[3][np.minimum(counts, 3).astype(np.int64)]
        sums_ = np.maximum(np.bincount(of, counts, len(keys)), 1)
        back = np.bincount(of, less, len(keys)) / sums_ if len(keys) else np.zeros(0)
        lower = ((keys & LOW)[of] << HALF) | third
        distinct, place = np.unique(lower, return_inverse=True)
        low = 10.0 ** model.bigrams(distinct)[0].astype(np.float64)
        p = np.maximum(counts - less, 0) / sums_[of] + back[of] * low[place] if len(keys) else np.zeros(0)
        _save(f"{folder}/t{s}", logp=_fixed(np.log10(p)))
        _save(f"{folder}/c{s}", back=_fixed(np.log10(back)))

    def only_logs(s: int) -> None:
        for part in ("c", "e", "t", "u"):
            for name in ("count", "many", "full", "cont", "sum", "n1", "n2", "n3"):
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{folder}/{part}{s}.{name}")

    for step in (word_logs, pair_logs, triple_logs, only_logs):
        each_shard(step)
    return model


def _score(model: Model):
    n, v = model.tokens, model.vocabulary

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets, SLICE):
                tokens, first = _sequences(data, offsets[lo : hi + 1])
                known, counts, place = _ids_of(model, tokens)
                base = np.log10((counts + 1) / (n + v + 1))[place]
                seen = (counts > 0)[place]
                ids = known[place]
                pairs = _pairs(model, ids, first)
                distinct, at = np.unique(np.append(pairs, model.start), return_inverse=True)
                logp, back, shard, low, high = model.bigrams(distinct, followed=True)
                # The two tokens before one are the pair of the token before it.
                at, start_at = at[:-1], at[-1]
                context = np.empty(len(at), np.int64)
                context[1:] = at[:-1]
                context[first[:-1]] = start_at
                third = model.trigrams(shard[context], low[context], high[context], ids.astype(np.uint32)).astype(np.float64)
                words = model.of_ids("logp", np.float32, known, np.float32(math.log10(model.unknown)))
                backs = model.of_ids("back", np.float32, known, np.float32(0))
                start = model.of_ids("back", np.float32, np.array([v], np.uint64), np.float32(0))[0]
                before = np.empty(len(ids), np.float64)
                before[1:] = backs[place[:-1]]
                before[first[:-1]] = start
                second = logp[at].astype(np.float64)
                second = np.where(np.isnan(second), before + words[place], second)
                score = np.where(np.isnan(third), back[context] + second, third)
                heads = first[:-1]
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64())]
                columns += [pa.array(np.add.reduceat(seen.astype(np.int64), heads)), pa.array(np.full(hi - lo, n, np.int64))]
                columns += [pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(score, heads))]
                yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tidied(run)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A text's tokens are its A-Z-lower-cased words and one end; a null or empty text is the end alone. score is the model's
    log10 probability of the text (perplexity is 10 ** (-score / n_tokens)), with an error of at most 1 / 2048 a token for
    the fixed point; base_score is that of add-one unigrams. Repeated rows give repeated results, a null id stays null, other
    columns are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = held_out if held_out is not None else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(model), shape)
