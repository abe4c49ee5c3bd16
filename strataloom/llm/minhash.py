"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each document becomes its set of distinct word shingles (64-bit fingerprints) and a MinHash signature. Equal sets are
   one class from here on, so a group of exact copies of any size costs one row.
2. The signature's bands propose candidates. Within a band's bucket every member is compared with the bucket's smallest
   id only (a star), which is linear in the bucket.
3. Candidates are compared signature batch by batch. With m of n positions equal and a uniform prior, the similarity's
   posterior is Beta(m + 1, n - m + 1); a pair goes as soon as P(similarity >= threshold) falls under `miss`. Survivors
   are confirmed on their full sets.
4. Buckets whose members are still in different components form families. There, every member outside the family's
   largest component is compared, by the same verification, with all members of other components that are near enough in
   size, in bounded blocks, so that no link between components is lost; links within a component change nothing and are
   skipped. Size classes are as wide as the threshold allows, so only neighbouring ones meet.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, small_batches
from .textscan import Words, mix, slices, stream, text_buffers, tidied

BLOCK = 512
CHUNK = 2048
GROUP_ROWS = 500
STEP = 20


@dataclass(frozen=True)
class Plan:
    """Signature layout and pruning table for one threshold; bands follow from the miss probability."""

    shingle: int
    num: int
    den: int
    miss: float
    rows: int
    bands: int

    @staticmethod
    def of(shingle: int, threshold: float, miss: float, rows: int) -> Plan:
        t = Fraction(str(threshold)).limit_denominator(10_000)
        if not 0 < t <= 1 or shingle < 1 or not 0 < miss < 1:
            raise ValueError("threshold is in (0, 1], shingle is 1 or more, miss is in (0, 1)")
        p = min(float(t) ** rows, 1 - 1e-12)
        return Plan(shingle, t.numerator, t.denominator, miss, rows, math.ceil(math.log(miss) / math.log1p(-p)))

    @property
    def length(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, least m) after each batch: with fewer matches the posterior P(similarity >= threshold) is under miss."""
        t, out = self.num / self.den, []
        for n in [*range(STEP, self.length, STEP), self.length]:
            total, m = 0.0, 0
            while m <= n:
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out

    def alike(self, inter: int, a: int, b: int) -> bool:
        return inter * self.den >= self.num * (a + b - inter)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each document of the slice; fewer than k words make one shingle."""
    h, first = words.hashes, words.first
    weights = stream(2, k) | np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        if n > 0:
            grams = h[:n] * weights[0]
            for j in range(1, k):
                grams += h[j : j + n] * weights[j]
            grams = mix(grams)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                values = np.sort(grams[lo : hi - k + 1])
                out.append(values[np.append(True, values[1:] != values[:-1])])
            elif hi > lo:
                part = (h[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                out.append(mix(np.array([part], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of a nonempty set: the least of each hash function a * x + b, its upper 32 bits."""
    best = None
    for lo in range(0, len(values), 4096):
        part = (values[None, lo : lo + 4096] * a[:, None] + b[:, None]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return (best >> np.uint64(32)).astype("<u4")


def _features(plan: Plan):
    def run(batches):
        a, b = stream(3, plan.length) | np.uint64(1), stream(4, plan.length)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                counts, keys, signatures = [], [], []
                for values in shingle_sets(Words(data, offsets[lo : hi + 1]), plan.shingle):
                    counts.append(len(values))
                    keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    signatures.append(signature(values, a, b).tobytes() if len(values) else None)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n", "set_key", "sig"],
                )

    return tidied(run)


def _sets(plan: Plan):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                values = [x.tobytes() for x in shingle_sets(Words(data, offsets[lo : hi + 1]), plan.shingle)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(values, pa.binary())], names=["doc_id", "values"])

    return tidied(run)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    data, _ = text_buffers(column)
    return np.frombuffer(data, "<u4").reshape(-1, k)


def _prune(plan: Plan):
    table = plan.least_matches()

    def run(batches):
        for batch in batches:
            left, right = _matrix(batch.column(2), plan.length), _matrix(batch.column(3), plan.length)
            alive = survivors(left, right, table)
            yield pa.record_batch([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])

    return tidied(run)


def survivors(left: np.ndarray, right: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers that no posterior bound prunes; left is one signature or one for each row of right."""
    alive, matches, done = np.arange(len(right)), np.zeros(len(right), np.int32), 0
    for n, least in table:
        l = left[done:n] if left.ndim == 1 else left[alive, done:n]
        matches = matches + (l == right[alive, done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _confirm(plan: Plan):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if plan.alike(_intersection(x, y), len(x), len(y)):
                    keep.append(i)
            yield pa.record_batch([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return tidied(run)


def _compare_family(plan: Plan):
    """Links between components within the blocks of a group of families."""
    table = plan.least_matches()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in pdf.groupby(["fam", "size", "block", "chunk"], sort=False):
            left, right = g[g.side == 0], g[g.side == 1]
            if not len(left) or not len(right):
                continue
            joined: dict[int, int] = {}

            def root(c: int, joined=joined) -> int:
                while c in joined:
                    c = joined[c]
                return c

            signatures = np.frombuffer(b"".join(right.sig), "<u4").reshape(-1, plan.length)
            ids, n, strays = right.id.to_numpy(), right.n.to_numpy(), right.stray.to_numpy()
            comps = right.component.to_numpy().copy()
            values = [np.frombuffer(x, np.uint64) for x in right["values"]]
            for a, na, ca, sa, va in zip(left.id, left.n, left.component, left.sig, left["values"], strict=True):
                ca, va = root(ca), np.frombuffer(va, np.uint64)
                low, high = np.minimum(n, na), np.maximum(n, na)
                rows = np.flatnonzero((comps != ca) & (low * plan.den >= plan.num * high) & ((ids > a) | ~strays))
                rows = rows[survivors(np.frombuffer(sa, "<u4"), signatures[rows], table)]
                while len(rows):
                    i = rows[0]
                    if plan.alike(_intersection(va, values[i]), na, n[i]):
                        links.append((a, int(ids[i])))
                        old = int(comps[i])
                        if old != ca:
                            joined[old] = ca
                            comps[comps == old] = ca
                    rows = rows[1:]
                    rows = rows[comps[rows] != ca]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, miss: float = 1e-6, rows: int = 5
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    A document's set has its distinct `shingle`-word shingles of the A-Z-lower-cased text; fewer words make one shingle;
    null, empty or blank texts have the empty set, stay alone and are kept. Documents of Jaccard similarity >= threshold
    are linked; component_id is the smallest linked id. Repeated rows give repeated result rows; rows that share an id are
    taken as one document. A null id is never linked: its component is null and it is kept. Other columns, whatever their
    names, are ignored. An empty table gives an empty result. `miss` bounds a true pair's chance to share no band and,
    separately, to be pruned by the posterior bound.
    """
    plan = Plan.of(shingle, threshold, miss, rows)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = materialize(texts.mapInArrow(_features(plan), "doc_id long, n long, set_key binary, sig binary"), "features")
    classes = feats.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = feats.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sig")
    reps = materialize(reps, "representatives")

    width = 4 * plan.rows
    keys = F.expr(f"transform(sequence(0, {plan.bands - 1}), j -> xxhash64(j, substring(sig, j * {width} + 1, {width})))")
    bands = reps.select("id", "n", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(buckets, "key"), "members")
    near = f"least(n, pivot.n) * {plan.den} >= {plan.num} * greatest(n, pivot.n)"
    star = members.where("id != pivot.id").where(near).select(F.col("id").alias("a"), F.col("pivot.id").alias("b")).distinct()
    star = materialize(star, "star")

    sigs = reps.select("id", "sig")
    paired = star.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    kept = materialize(paired.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(plan), "a long, b long"), "survivors")

    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    wanted = materialize(wanted, "wanted")
    values = texts.join(wanted, "doc_id", "left_semi")
    values = materialize(values.mapInArrow(_sets(plan), "doc_id long, values binary"), "sets").withColumnRenamed("doc_id", "id")
    full = kept.join(values.select(F.col("id").alias("a"), F.col("values").alias("va")), "a").join(values.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")
    links = materialize(full.select("a", "b", "va", "vb").mapInArrow(_confirm(plan), "a long, b long"), "links")

    labels = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    open_ = members.where("size > 2").select("key", "id", F.col("pivot.id").alias("pivot")).join(labels, "id", "left")
    open_ = open_.withColumn("component", F.coalesce("component", "id"))
    unsettled = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    edges = materialize(open_.join(unsettled, "key", "left_semi").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct(), "open")
    if not edges.isEmpty():
        more = materialize(_family_links(plan, edges, labels, reps, values), "more")
        links = links.union(more)
        labels = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")

    rep = F.coalesce("rep", "doc_id")
    out = feats.select("doc_id", "n", "set_key").join(classes, "set_key", "left").withColumn("rep", F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(rep))
    out = out.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _family_links(plan: Plan, edges: DataFrame, labels: DataFrame, reps: DataFrame, values: DataFrame) -> DataFrame:
    """Links (a, b) between different components of each family of candidates."""
    family = materialize(connected_components(edges), "family").withColumnRenamed("component", "fam")
    tagged = materialize(family.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "tagged")
    sizes = tagged.groupBy("fam", "component").agg(F.count("*").alias("c")).groupBy("fam").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"))
    sizes = sizes.where("m > top.c").select("fam", F.col("top.component").alias("main"))
    # Two sets whose similarity reaches the threshold are at most one class apart; the factor keeps rounding on that side.
    size = F.floor(F.log("n") / math.log(plan.den / plan.num) * 0.999999) if plan.num < plan.den else F.col("n")
    rows = tagged.join(sizes, "fam").withColumn("stray", F.col("component") != F.col("main")).join(reps.select("id", "n"), "id").withColumn("size", size).drop("main", "n")
    rows = materialize(rows, "open_families")
    near = rows.withColumn("size", F.explode(F.array(*(F.col("size") + k for k in (-1, 0, 1)))))
    parts = near.groupBy("fam", "size").agg(F.count("*").alias("m"))
    parts = rows.where("stray").groupBy("fam", "size").agg(F.count("*").alias("strays")).join(parts, ["fam", "size"])
    parts = materialize(parts.select("fam", "size", "m", F.ceil(F.col("strays") / BLOCK).alias("blocks"), F.ceil(F.col("m") / CHUNK).alias("chunks")), "parts")
    h = F.xxhash64("id", F.lit(7))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("stray").join(parts, ["fam", "size"]).withColumn("side", F.lit(0)).withColumn("block", F.pmod(h, "blocks")).withColumn("chunk", upto("chunks"))
    right = near.join(parts, ["fam", "size"]).withColumn("side", F.lit(1)).withColumn("chunk", F.pmod(h, "chunks")).withColumn("block", upto("blocks"))
    both = left.unionByName(right).select("fam", "size", "block", "chunk", "side", "id", "component", "stray", "m")
    # Parts of a few members share a group; larger ones have a group for each pair of blocks.
    groups = max(4096, near.count() // GROUP_ROWS)
    group = F.when(F.col("m") <= 64, F.pmod(F.xxhash64("fam", "size"), F.lit(groups))).otherwise(F.xxhash64("fam", "size", "block", "chunk"))
    both = both.withColumn("gid", group).join(reps, "id").join(values, "id").drop("m")
    return both.groupBy("gid").applyInPandas(_compare_family(plan), "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with docs' columns, whatever those are called.

    The ids to drop are written first, so Spark broadcasts them only if their size is under its limit. Rows without an id
    stay. Rows that share id and text stay or go together.
    """
    dropped = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_dropped_id")).distinct()
    dropped = materialize(dropped, "dropped")
    return docs.join(dropped, F.col(id_col).cast("long") == F.col("_dropped_id"), "left_anti")
