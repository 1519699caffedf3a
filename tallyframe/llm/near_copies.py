"""Links between texts by the exact Jaccard similarity of their word shingles, next to those of SimHash.

Candidates share a band of a MinHash signature. Two texts of similarity 0.8 share one of 20 bands of 5 minima
with probability 0.9996, and every candidate is confirmed on the complete sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .components import connected

WORDS = 5
BANDS, MINIMA = 20, 5
LEADERS = 32  # texts of a bucket that meet its texts of other components in the first round; twice as many in each further one
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words, ASCII lower case; fewer words are one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    of_word = {p: xxhash.xxh64_intdigest(p) for p in set(parts)}
    h = np.fromiter(map(of_word.__getitem__, parts), dtype=np.uint64, count=len(parts))
    k = min(words, len(parts))
    m = len(parts) - k + 1
    out = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band of the signature."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at:at + 2048, None] * _FACTORS + _TERMS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, MINIMA))]


def banded(rows: DataFrame) -> DataFrame:
    """``k, t, n``: the band keys of every text of ``t, text`` and its number of shingles. Texts without words have none."""

    def run(batches):
        for batch in batches:
            ids, keys, sizes = [], [], []
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text"), strict=True):
                h = shingles(text.as_buffer().to_pybytes())
                if len(h):
                    keys += bands(h)
                    ids += [t] * BANDS
                    sizes += [len(h)] * BANDS
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32())], names=["k", "t", "n"])

    return rows.select("t", "text").mapInArrow(run, "k long, t binary, n int")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose shingles have a Jaccard similarity of ``similarity`` at least."""

    def run(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True)):
                if a != last:
                    last, left = a, shingles(x.as_buffer().to_pybytes())
                right = shingles(y.as_buffer().to_pybytes())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both >= similarity * (len(left) + len(right) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    whole = pairs.join(texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("t").alias("a"), F.col("text").alias("x")), "a")
    return whole.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, nodes: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between the nodes (``t, fp``: digest of a text and its fingerprint) of similar texts of ``docs`` (``t, text``).

    Every text of a bucket is compared with its first one. What this and the links already ``found`` leave in
    several components is compared in rounds: some texts of a bucket, taken in turn from its components, meet all its
    texts of other components and then leave the bucket. The rounds end when no bucket holds two components, so every
    pair of a bucket is compared or linked by others; a bucket of copies makes about as many pairs as it has texts.
    The texts per round double, so there are few rounds. Texts without words have no shingles and no links here.
    """
    near = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n)
    keys = materialise(banded(docs).distinct())
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t", "n")).alias("first")).filter("c > 1").drop("c")
    buckets = materialise(keys.join(shared, "k"))
    texts = docs.groupBy("t").agg(F.first("text").alias("text")).join(buckets.select("t").distinct(), "t", "left_semi")
    texts = materialise(texts)
    pairs = materialise(buckets.filter((F.col("t") != F.col("first.t")) & near(F.col("n"), F.col("first.n"))).select(F.col("first.t").alias("a"), F.col("t").alias("b")).distinct())
    known = materialise(confirmed(pairs, texts, similarity))
    on_nodes = lambda p: p.join(nodes.select(F.col("t").alias("a"), F.col("fp").alias("u")), "a").join(
        nodes.select(F.col("t").alias("b"), F.col("fp").alias("v")), "b").filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    direct = materialise(on_nodes(known))
    rest = buckets.filter(F.col("t") != F.col("first.t")).select("k", "t", "n").join(nodes, "t")
    roots = connected(found.unionByName(direct)).withColumnRenamed("node", "fp")
    leaders = LEADERS
    while True:
        now = rest.join(roots, "fp", "left").select("k", "t", "n", "fp", F.coalesce("root", "fp").alias("root"))
        now = materialise(now)
        mixed = now.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
        now = materialise(now.join(mixed, "k", "left_semi"))
        if now.isEmpty():
            return direct
        turn = F.row_number().over(Window.partitionBy("k", "root").orderBy("t"))
        heads = now.withColumn("turn", turn).filter(F.col("turn") <= leaders)
        heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("turn", "t"))).filter(F.col("place") <= leaders)
        heads = materialise(heads.select("k", F.col("t").alias("h"), F.col("n").alias("hn"), F.col("root").alias("hr")))
        across = now.join(heads, "k").filter((F.col("root") != F.col("hr")) & near(F.col("n"), F.col("hn")))
        across = across.select(F.least("t", "h").alias("a"), F.greatest("t", "h").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        across = materialise(across)
        pairs = pairs.unionByName(across)
        fresh = materialise(on_nodes(confirmed(across, texts, similarity)))
        if not fresh.isEmpty():
            direct = materialise(direct.unionByName(fresh).distinct())
            roots = connected(found.unionByName(direct)).withColumnRenamed("node", "fp")
        rest = now.select("k", "t", "n", "fp").join(heads.select("k", F.col("h").alias("t")), ["k", "t"], "left_anti")
        leaders *= 2
