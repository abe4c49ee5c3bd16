"""Language identification of each word by a linear-chain conditional random field, and of documents from their words.

A word's features are its affixes of 1 to 4 bytes, its byte 2- and 3-grams, and its place in each language's lexicon,
hashed to a fixed number of weights. Transitions are learned from sequences that switch between languages, made by joining
stretches of the labelled documents. Labels of words come from forward-backward over whole documents, computed in blocks
of words whose transfer matrices are multiplied first, so that a long document is not a long loop.

The field is fitted on the driver to a bounded sample: of each language of all labelled rows an equal part of `most_rows`
rows, but LEAST_ROWS at least, the first in the order of a fixed hash of id and text. A text of more than `most_bytes` bytes
is in the sample with a stretch of it, which the same hash places. All else is computed for every row and every word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_batches
from .textscan import _BASE, _BASE_INVERSE, _BYTE, Words, _powers, mix, slices, stream, text_buffers, tidied, tidy

BITS = 16
BLOCK = 64
MOST_ROWS = 1200
MOST_BYTES = 1 << 14
LEAST_ROWS = 20
MOST_LANGUAGES = 1000
LEXICON = 400
SLICE = 1 << 20
#: Distinct words whose features are made together where the field is fitted.
FIT_WORDS = 10_000


@dataclass
class Crf:
    """Weights by hashed feature, transition scores (from, to), and each language's sorted word hashes."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: list[np.ndarray]

    def emissions(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        feats, owner = _distinct_features(words, hashes, at, self.lexicon)
        out = np.empty((len(at), len(self.languages)), np.float32)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, self.weights[feats, k], len(at))
        return out


def _ranged(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i] .. start[i] + n[i] - 1 for every i, and i for each."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner], owner


def word_features(data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, lexicon: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, the word of each) of words data[start:stop]."""
    terms = _BYTE[data] * _powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    inverse = _powers(_BASE_INVERSE, len(data) + 1)
    tags = stream(21, 16)

    def hashed(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
        return mix((sums[b] - sums[a]) * inverse[a] + tags[tag]) >> np.uint64(64 - BITS)

    n = stop - start
    feats, owners = [hashed(start, stop, 0)], [np.arange(len(n))]
    for k in (1, 2, 3, 4):
        long = np.flatnonzero(n > k)
        feats += [hashed(start[long], start[long] + k, k), hashed(stop[long] - k, stop[long], 4 + k)]
        owners += [long, long]
    for k in (2, 3):
        a, owner = _ranged(start, np.maximum(n - k + 1, 0))
        feats.append(hashed(a, a + k, 8 + k))
        owners.append(owner)
    for k, have in enumerate(lexicon):
        if len(have):
            found = np.flatnonzero(have[np.minimum(np.searchsorted(have, hashes), len(have) - 1)] == hashes)
            feats.append(np.full(len(found), (7919 * (k + 1)) % (1 << BITS), np.uint64))
            owners.append(found)
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners)


def _distinct_features(words: Words, hashes: np.ndarray, at: np.ndarray, lexicon: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """word_features() of the distinct words `at`, from their bytes alone, which are few beside those of all texts."""
    size = words.stop[at] - words.start[at]
    start = np.cumsum(size) - size
    return word_features(words.data[_ranged(words.start[at], size)[0]], start, start + size, hashes, lexicon)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Each word's posterior over languages, given the whole document; first has each document's first word.

    pairs, if given, gets the sum of the posteriors of neighbours' label pairs.
    """
    n, k = emissions.shape
    x = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) if n else emissions
    t = np.exp(transitions - transitions.max())
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    nth, doc = _ranged(np.zeros(len(blocks), np.int64), blocks)
    begin = first[doc] + nth * BLOCK
    size = np.minimum(BLOCK, first[doc + 1] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, place = begin[order], size[order], np.argsort(order)
    active = [int(np.searchsorted(-size, -j, side="left")) for j in range(BLOCK)]  # blocks longer than j
    products = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for j, m in enumerate(active):
        if m:
            p = (products[:m].reshape(-1, k) @ t).reshape(m, k, k) * x[begin[:m] + j][:, None, :]
            products[:m] = p / p.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((len(size), k)), np.empty((len(size), k))
    base = np.cumsum(blocks) - blocks
    a, b = np.full((len(lengths), k), 1.0 / k), np.full((len(lengths), k), 1.0 / k)
    most = int(blocks.max()) if len(blocks) else 0
    by_size = np.argsort(-blocks, kind="stable")
    counts = [int(np.searchsorted(-blocks[by_size], -j, side="left")) for j in range(most)]
    for j in range(most):
        docs = by_size[: counts[j]]
        at = place[base[docs] + j]
        into[at] = a[docs]
        a[docs] = _scaled(np.einsum("di,dij->dj", a[docs], products[at]))
    for j in reversed(range(most)):
        docs = by_size[: counts[j]]
        at = place[base[docs] + j]
        out[at] = b[docs]
        b[docs] = _scaled(np.einsum("dij,dj->di", products[at], b[docs]))
    forward, start, nth = np.empty((n, k)), into.copy(), nth[order]
    for j, m in enumerate(active):
        if m:
            into[:m] = _scaled((into[:m] @ t) * x[begin[:m] + j])
            forward[begin[:m] + j] = into[:m]
    for j in reversed(range(BLOCK)):
        m = active[j]
        if m:
            at = begin[:m] + j
            if pairs is not None:
                joint = (forward[at - 1] if j else start[:m])[:, :, None] * t[None] * (x[at] * out[:m])[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += (joint if j else joint[nth[:m] > 0]).sum(axis=0)
            forward[at] = _scaled(forward[at] * out[:m])
            out[:m] = _scaled((x[at] * out[:m]) @ t.T)
    return forward


def _lettered(words: Words, at: np.ndarray) -> np.ndarray:
    """Whether words have a letter."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    count = np.concatenate([[0], np.cumsum(ascii_letter[words.data])])
    wide = np.concatenate([[0], np.cumsum(words.data >= 128)])
    a, b = words.start[at], words.stop[at]
    out = count[b] > count[a]
    for i in np.flatnonzero(~out & (wide[b] > wide[a])):
        out[i] = any(map(str.isalpha, words.data[a[i] : b[i]].tobytes().decode("utf-8", "replace")))
    return out


def _labelled(crf: Crf, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, has a letter) of each word of a slice."""
    hashes, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    lettered = _lettered(words, at)
    emissions = crf.emissions(words, hashes, at)
    emissions[~lettered] = 0
    return marginals(emissions[back], words.first, crf.transitions), lettered[back]


def fit(languages: list[str], texts: list[str], labels: list[int], epochs: int = 4, rate: float = 0.1, seed: int = 5) -> Crf:
    """The field of labelled texts, by minibatch Adam on the conditional log-likelihood."""
    rng, k = np.random.default_rng(seed), len(languages)
    if not k:
        return Crf([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), [])
    column = pa.array(texts, pa.large_string())
    data, offsets = text_buffers(column)
    words = Words(data, offsets)
    owner = np.repeat(np.array(labels, np.int64), np.diff(words.first))
    hashes, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    lettered = _lettered(words, at)
    seen = np.stack([np.bincount(back[owner == j], minlength=len(hashes)) for j in range(k)], axis=1).astype(float)
    share = seen / np.maximum(seen.sum(axis=0), 1)
    lexicon = []
    for j in range(k):
        own = share[:, j] / np.maximum(share.sum(axis=1), 1e-12)
        good = np.flatnonzero(lettered & (own > 0.6) & (seen[:, j] >= 3))
        lexicon.append(np.sort(hashes[good[np.argsort(-share[good, j], kind="stable")[:LEXICON]]]))
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for lo in range(0, len(at), FIT_WORDS):
        part = slice(lo, lo + FIT_WORDS)
        feats, of = _distinct_features(words, hashes[part], at[part], lexicon)
        keep = lettered[part][of]
        feats, of = feats[keep].astype(np.int32), of[keep]
        parts.append(feats[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=len(hashes[part])))
    feats, ptr = np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    # Stretches of 4 to BLOCK words, from all over each text; pairs of them make sequences that switch.
    stretches = []
    for lo, hi, y in zip(words.first[:-1], words.first[1:], labels, strict=True):
        while lo < hi:
            size = int(rng.integers(4, BLOCK + 1))
            stretches.append((lo, min(hi, lo + size), y))
            lo += size
    model = Crf(languages, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), lexicon)
    moments = [np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros((k, k))]
    step = 0
    for _ in range(epochs if stretches else 0):
        shuffled = rng.permutation(len(stretches))
        for lo in range(0, len(shuffled), 1024):
            batch = [stretches[i] for i in shuffled[lo : lo + 1024]]
            rows = np.concatenate([np.arange(a, b) for a, b, _ in batch])
            gold = np.concatenate([np.full(b - a, y) for a, b, y in batch])
            sizes = np.array([b - a for a, b, _ in batch])
            # Every other pair of neighbours is one sequence.
            cut = np.ones(len(batch), bool)
            cut[1::4] = False
            first = np.concatenate([np.concatenate([[0], np.cumsum(sizes)])[:-1][cut], [len(rows)]])
            used, local = np.unique(back[rows], return_inverse=True)
            span, own = _ranged(ptr[used], ptr[used + 1] - ptr[used])
            f = feats[span]
            e = np.stack([np.bincount(own, model.weights[f, j], len(used)) for j in range(k)], axis=1)
            x = e[local]
            expected = np.zeros((k, k))
            p = marginals(x, first, model.transitions, expected)
            target = np.zeros_like(p)
            target[np.arange(len(gold)), gold] = 1
            g = target - p
            g[~lettered[back[rows]]] = 0
            gu = np.stack([np.bincount(local, g[:, j], len(used)) for j in range(k)], axis=1)
            gw = np.stack([np.bincount(f, gu[own, j], 1 << BITS) for j in range(k)], axis=1)
            inner = np.ones(len(rows), bool)
            inner[first[:-1]] = False
            inner = np.flatnonzero(inner)
            pairs = np.zeros((k, k))
            np.add.at(pairs, (gold[inner - 1], gold[inner]), 1.0)
            gt = (pairs - expected) / max(len(inner), 1)
            step += 1
            for theta, grad, m, v, r in ((model.weights, gw / len(batch), moments[0], moments[1], rate), (model.transitions, gt, moments[2], moments[3], rate)):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                theta += (r * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(theta.dtype)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Crf:
    """The field of a bounded sample of docs.

    Rows of null language or text aren't learned from; equal rows count once. Every language of the labelled rows is
    learned, however rare. Without a labelled row the field has no language.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"), lang.alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} values")
    languages = sorted(counts)
    if not languages:
        return fit([], [], [])
    each = max(LEAST_ROWS, most_rows // len(languages))
    # Hashes up to a bound hold the first `each` of a language but for a chance of some 1e-9; so few rows are sorted.
    share = {x: min(1.0, (each + 6 * each**0.5 + 20) / n) for x, n in counts.items()}
    bound = F.create_map(*(F.lit(v) for x in languages for v in (x, min(int((2 * share[x] - 1) * 2**63), 2**63 - 1))))
    few = rows.where(F.col("h") <= bound[F.col("lang")])
    size, most = F.length("text"), most_bytes // 4
    place = F.when((F.octet_length("text") > most_bytes) & (size > most), F.substring("text", F.pmod("h", size - most + 1).cast("int") + 1, F.lit(most))).otherwise(F.col("text"))
    few = few.select("lang", "h", place.alias("text")).dropDuplicates(["lang", "h", "text"])
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).orderBy("h", "lang", "text").collect()
    crf = fit(languages, [r.text for r in sample], [languages.index(r.lang) for r in sample])
    tidy()  # the driver too outlives this
    return crf


def _predict(crf: Crf):
    def run(batches):
        names = np.array([*crf.languages, "und"], object)
        k = len(crf.languages)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data, offsets[lo : hi + 1])
                d = hi - lo
                if k and len(words.start):
                    p, lettered = _labelled(crf, words)
                    owner = np.repeat(np.arange(d), np.diff(words.first))[lettered]
                    p = p[lettered]
                    totals = np.stack([np.bincount(owner, p[:, j], d) for j in range(k)], axis=1)
                    count = np.bincount(owner, minlength=d)
                    label = p.argmax(axis=1)
                    turn = np.flatnonzero((label[1:] != label[:-1]) & (owner[1:] == owner[:-1]))
                    switches = np.bincount(owner[turn + 1], minlength=d)
                else:
                    totals, count, switches = np.zeros((d, max(k, 1))), np.zeros(d, np.int64), np.zeros(d, np.int64)
                best = totals.argmax(axis=1)
                score = np.where(count > 0, totals[np.arange(d), best] / np.maximum(count, 1), 0.0)
                best = np.where(count > 0, best, k)
                columns = [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(count.astype(np.int64)), pa.array(switches.astype(np.int64))]
                yield pa.record_batch([batch.column(0).slice(lo, d), *columns], names=["doc_id", "lang_pred", "score", "lettered_words", "switches"])

    return tidied(run)


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, lettered_words, switches) for each row of docs.

    lang_pred has the largest mean posterior over the words that have a letter, and score is that mean; switches counts
    neighbouring such words of different labels. A null text, or one without a letter, is `und` with score 0, as is any
    text if no labelled row was there to learn from. Repeated rows give repeated results; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(crf), f"doc_id {kind}, lang_pred string, score double, lettered_words long, switches long")


def _runs(crf: Crf):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data, offsets[lo : hi + 1])
                rows = []
                label = _labelled(crf, words)[0].argmax(axis=1) if len(words.start) and crf.languages else np.zeros(0, int)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    own = label[a:b]
                    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
                    ends = np.append(heads[1:], len(own))
                    rows.append([{"start": int(s), "words": int(e - s), "lang": crf.languages[own[s]]} for s, e in zip(heads, ends, strict=False)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(rows, kind)], names=["doc_id", "runs"])

    return tidied(run)


def label_words(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs): the document's stretches of words of one language, as (first word, words, lang)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_runs(crf), f"doc_id {kind}, runs array<struct<start: bigint, words: bigint, lang: string>>")


def keep(docs: DataFrame, crf: Crf, text_col: str = "text", least: float = 0.5, lang_col: str = "lang") -> DataFrame:
    """The rows of docs in a learned language with a score of `least` or more, with docs' columns, whatever those are called.

    lang_col, where docs has it, gets the predicted language. A null text, or one without a letter, goes; repeated rows stay
    or go together. A field that has learned no language can't tell, so all rows stay as they are.
    """
    if not crf.languages:
        return docs
    small_batches(docs.sparkSession)
    inner = _predict(crf)
    at = docs.columns.index(text_col)
    label = docs.columns.index(lang_col) if lang_col in docs.columns else None
    kind = docs.schema[text_col].dataType.simpleString()
    if kind != "string" or (label is not None and docs.schema[lang_col].dataType.simpleString() != "string"):
        raise ValueError("the text and language columns hold strings")

    def run(batches):
        for batch in batches:
            texts = pa.record_batch([pa.nulls(batch.num_rows), batch.column(at)], names=["doc_id", "text"])
            parts = list(inner([texts]))
            if not parts:
                continue
            said = pa.concat_arrays([b.column(1) for b in parts])
            good = np.concatenate([b.column(2).to_numpy() for b in parts]) >= least
            good &= said.to_numpy(zero_copy_only=False) != "und"
            if label is not None:
                batch = batch.set_column(label, batch.schema.field(label), said.cast(batch.schema.field(label).type))
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id's crc32 leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
