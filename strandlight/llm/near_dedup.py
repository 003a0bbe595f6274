"""Circulant MinHash near-duplicate detection with exact verification.

Documents with equal shingle sets form a class; only classes are compared. A signature
has K coordinates from two permutations of the 32-bit integers: sigma scatters the
shingles once, and coordinate k is the least value of pi over the scattered shingles
shifted by k places. Bands of coordinates give buckets. In each bucket, members are
compared with pivots and each pair is verified on the full sets; buckets that still
span several components go on with more pivots until all their pairs are decided, by
bounds that need no sets or by the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, row_key, table
from strandlight.llm.components import components

#: 30 bands of 5: a pair at similarity 0.8 shares no bucket with probability 7e-6, one at 0.9 with 2e-12.
BANDS, ROWS = 30, 5
#: Pivots of a bucket in the first round after the comparison with one; each later round has GROWTH times as many.
PIVOTS, GROWTH = 64, 16
#: Members of a bucket beyond which their own shingles are counted, to rule pairs out.
LARGE = 32
#: Shingles of large buckets that a task counts at a time, before they are dealt out.
COUNTED = 1 << 20
#: Longs of a bitmap of a set's shingles, for a bound on what two sets share.
BITMAP = 16
#: Bytes of sets that are broadcast to verify a round's pairs; with more, pairs and sets meet by a shuffle.
SET_BYTES = 8 << 20

_M1, _M2, _FOLD = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text with A-Z in lower case.

    Bytes are lowered in A-Z alone and split at \x20 and \x09-\x0D alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """Signatures of one size, in buffers that stay in the processor's cache.

    pi(x) multiplies by an odd number, folds the high bits down and multiplies again: a
    permutation of the 32-bit integers. Coordinate k is the least pi(sigma(s) + k mod
    2^32) of the shingles s; since the first step is linear, shifting by k adds k * M1.
    """

    CHUNK = 192

    def __init__(self, size: int) -> None:
        self.size = size
        self.shift = (np.arange(size, dtype=np.uint32) * _M1)[:, None]
        self.x, self.t = np.empty((size, self.CHUNK), np.uint32), np.empty((size, self.CHUNK), np.uint32)
        self.low = np.empty(size, np.uint32)

    def __call__(self, sh: np.ndarray) -> np.ndarray:
        sigma = sh * np.uint64(0x9E3779B97F4A7C15)
        scaled = ((sigma ^ (sigma >> np.uint64(31))) >> np.uint64(16)).astype(np.uint32) * _M1
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(scaled), self.CHUNK):
            part = scaled[at : at + self.CHUNK]
            x, t = self.x[:, : len(part)], self.t[:, : len(part)]
            np.add(part[None, :], self.shift, out=x)
            np.right_shift(x, _FOLD, out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, _M2, out=x)
            np.minimum.reduce(x, axis=1, out=self.low)
            np.minimum(out, self.low, out=out)
        return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F)
    for k in range(rows):
        out = (out ^ s[:, k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _sketcher(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands * rows)
        for b in batches:
            n, classes, keys = [], [], []
            for text in b.column("text"):
                sh = shingles(text.as_py(), width)
                n.append(len(sh))
                classes.append(hashlib.md5(sh.tobytes()).digest() if len(sh) else None)
                keys.append(band_keys(sign(sh), bands, rows) if len(sh) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "keys"])

    return run


def bitmap(sh: np.ndarray) -> np.ndarray:
    """A bit for each last ten bits of a hash that the set has, as 16 longs."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(sh & np.uint64(64 * BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _setter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), width) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["id", "set", "bits"])

    return run


def _verifier(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _class_sets(docs: DataFrame, reps: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(id, set, bits) of every class that shares a bucket, made again from one text of each."""
    ids = cut(reps.join(broadcast_if_small(cut(members.select("id").distinct())), "id", "left_semi").select("k1", "k2", "id"))
    n = ids.count()
    sets = cut(docs.join(broadcast_if_small(ids, n), ["k1", "k2"]).select("id", "text").mapInArrow(_setter(width), "id long, set array<long>, bits array<long>"))
    return sets if sets.count() == n else cut(sets.dropDuplicates(["id"]))  # more only where a whole row repeats


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as percent says."""
    asked = cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
    known = sets.join(broadcast_if_small(asked), "id", "left_semi").select("id", "set")
    if 8 * (known.agg(F.sum(F.size("set"))).first()[0] or 0) <= SET_BYTES:
        known = F.broadcast(known)
    with_a = pairs.join(known.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    with_b = with_a.join(known.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return cut(with_b.select("a", "b", "set_a", "set_b").mapInArrow(_verifier(percent), "a long, b long"))


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each shingle stands in the sets of a task, and some id that has it; counted by COUNTED at a time."""

    def counted(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found, at, times = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        owner = np.repeat(np.array(ids, np.int64), [len(x) for x in sets])
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64)), pa.array(owner[at])], names=["shingle", "times", "id"])

    ids, sets, size = [], [], 0
    for b in batches:
        for i, x in zip(b.column("id").to_pylist(), b.column("set"), strict=True):
            ids.append(i)
            sets.append(x.values.to_numpy().copy())
            size += len(sets[-1])
            if size >= COUNTED:
                yield counted(ids, sets)
                ids, sets, size = [], [], 0
    if sets:
        yield counted(ids, sets)


def _open(members: DataFrame, done: int = 0) -> DataFrame:
    """members of the buckets that span several components and have pairs left, with the bucket's size and least n."""
    spans = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"), F.min("n").alias("least_n"))
    spans = cut(spans.filter((F.col("x") != F.col("y")) & (F.col("size") > done + 1)).select("bucket", "size", "least_n"))
    return members.drop("size", "least_n").join(broadcast_if_small(spans), "bucket")


def _bounded(alive: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """alive with own and bits, which bound similarities, without what they rule out at once.

    own is how many of a class's shingles no other class of an open large bucket has;
    those are in no intersection. A class that is too far from the smallest set of its
    bucket, if all its other shingles were shared, leaves the bucket: it has no link
    there. In buckets up to LARGE own is 0. Bits that only one of two classes has each
    stand for a shingle that only one of them has.
    """
    crowd = cut(alive.filter(F.col("size") > LARGE).select("id", "n").distinct())
    shingles_there = crowd.agg(F.sum("n")).first()[0] or 0
    held = sets.join(broadcast_if_small(crowd.select("id")), "id", "left_semi").select("id", "set")
    counts = held.coalesce(max(1, -(-shingles_there // COUNTED))).mapInArrow(_count_shingles, "shingle long, times long, id long")
    once = counts.groupBy("shingle").agg(F.sum("times").alias("times"), F.min("id").alias("id")).filter("times = 1")
    own = cut(once.groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    with_own = alive.join(broadcast_if_small(own), "id", "left").withColumn("own", F.when(F.col("size") > LARGE, F.coalesce("own", F.lit(0))).otherwise(0).cast("long"))
    near = cut(with_own.filter(100 * (F.col("n") - F.col("own")) >= percent * (F.col("own") + F.col("least_n"))))
    near = _open(near)
    wanted = cut(near.select("id").distinct())
    bits = sets.join(broadcast_if_small(wanted), "id", "left_semi").select("id", "bits")
    return cut(near.join(bits, "id").select("bucket", "id", "n", "root", "first", "own", "bits"))


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) of the components that new links and the old components make."""
    edges = links if roots is None else links.unionAll(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return cut(components(edges))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with the root of the class in the links so far."""
    small = broadcast_if_small(roots.select(F.col("node").alias("id"), F.col("root").alias("to")))
    return members.join(small, "id", "left").withColumn("root", F.coalesce("to", "id")).drop("to")


def class_roots(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) for the components of all links among classes that share a bucket; None without links.

    members: (bucket, id, n, first), where first is the bucket's member with most copies.
    Each member is compared with first. Buckets that then still span several components
    go on by rounds of pivots, those with the least own shingles first: the texts that
    others were made from. Pairs in one component, and pairs that the bounds of
    `_bounded` rule out, are left out; all others are verified, so that no pair that can
    change a component is lost. A bucket leaves when its members are one component or
    all have been pivots.
    """
    pairs = cut(members.filter("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct())
    links = _verify(pairs, sets, percent)
    roots = None if links.isEmpty() else _joined(links, None)
    alive = members.withColumn("root", F.col("id")) if roots is None else _rooted(members.withColumn("root", F.col("id")), roots)
    alive = cut(_open(alive))
    if alive.isEmpty():
        return roots
    alive = _bounded(alive, sets, percent)
    done, pivots = 0, PIVOTS
    while not alive.isEmpty():
        by_bucket = Window.partitionBy("bucket").orderBy("own", "id")
        top = alive.withColumn("rank", F.row_number().over(by_bucket)).filter(F.col("rank") <= done + pivots).filter(F.col("rank") > done)
        top = top.select("bucket", *(F.col(c).alias(f"p_{c}") for c in ("id", "n", "root", "own", "bits")))
        apart = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("p_bits", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
        most = F.least(F.col("n") - F.col("own"), F.col("p_n") - F.col("p_own"), F.floor((F.col("n") + F.col("p_n") - apart) / 2))
        fits = 100 * most >= percent * (F.col("n") + F.col("p_n") - most)
        later = F.struct("own", "id") > F.struct("p_own", "p_id")
        before = (F.col("id") == F.col("first")) | (F.col("p_id") == F.col("first"))
        met = alive.join(top, "bucket").filter(later & (F.col("root") != F.col("p_root")) & ~before & fits)
        pairs = cut(met.select(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b")).distinct())
        if not pairs.isEmpty():
            links = _verify(pairs, sets, percent)
            if not links.isEmpty():
                roots = _joined(links, roots)
                alive = _rooted(alive, roots)
        done += pivots
        pivots *= GROWTH
        alive = cut(_open(alive, done).drop("size", "least_n"))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: k1, k2, doc_id, n_shingles, component_id, kept, first.

    component_id is the least doc_id of all documents that links reach, and kept says that
    it is the row's own. first marks the component's least row key, which tells rows apart
    that share an id. Defined cases: a
    text without words (or null) has no shingles and is its own component; with fewer
    words than width, the whole sequence is one shingle; repeated rows and equal texts
    are one class; null ids are passed over by the least id, and a component of null ids
    alone has a null component_id and is kept; an empty table gives an empty table.
    """
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = cut(keyed.select("doc_id", "text", "k1", "k2").mapInArrow(_with_keys(_sketcher(width, bands, rows)), "k1 long, k2 long, doc_id long, n_shingles long, class binary, keys array<long>"))
    classes = sketches.filter("class is not null").groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    reps = cut(classes.select("class", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), "least", "copies", "n", "keys", F.monotonically_increasing_id().alias("id")))
    flat = reps.select("id", "n", "copies", F.explode("keys").alias("bucket"))
    most_copied = F.max(F.struct("copies", (-F.col("id")).alias("less")))
    shared = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), most_copied.alias("most")).filter("size > 1")
    shared = cut(shared.select("bucket", (-F.col("most.less")).alias("first")))
    members = cut(flat.select("bucket", "id", "n").join(broadcast_if_small(shared), "bucket"))
    roots = None
    if not members.isEmpty():
        roots = class_roots(members, _class_sets(keyed, reps, members, width), percent)
    own = reps.select("class", "least", F.struct("k1", "k2").alias("first"))
    if roots is not None:
        rooted = cut(reps.select("class", "least", F.struct("k1", "k2").alias("first"), "id").join(broadcast_if_small(roots.withColumnRenamed("node", "id")), "id"))
        low = rooted.groupBy("root").agg(F.min("least").alias("low"), F.min("first").alias("low_first"))
        named = cut(rooted.join(low, "root").select("class", "low", "low_first"))
        own = own.join(broadcast_if_small(named), "class", "left").select("class", F.coalesce("low", "least").alias("least"), F.coalesce("low_first", "first").alias("first"))
    out = sketches.drop("keys").join(own, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    first = F.coalesce(F.struct("k1", "k2") == F.col("first"), F.lit(True))
    return out.select("k1", "k2", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), first.alias("first"))


def _with_keys(inner: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """inner on each batch, with the batch's row keys in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def tee() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept.append(b)
                yield b

        for out in inner(tee()):
            b = kept.pop()
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *out.columns], names=["k1", "k2", *out.schema.names])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2", "first")
