"""Near-duplicates by SimHash with multi-index hashing.

Two fingerprints that differ in at most ``radius`` bits agree, by the pigeonhole principle, up to a small
number of bits in at least one of a few segments. Every fingerprint is stored once per segment; as a query
it enumerates the small Hamming ball inside each segment, fetches the matches from that table, and complete
distances are verified in the join itself. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import materialise, text_or_empty
from .components import connected

BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: ASCII lower case, shingles of ``words`` words with repeats, XXH64 of each.

    A text of fewer words is one shingle; a text without words has fingerprint 0.
    """
    parts = text.lower().split()  # bytes: A-Z only, and white space is exactly 9-13 and 32
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(parts))
    begin, stop = (ends - sizes)[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(begin, stop, strict=True)], dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(h, axis=1, bitorder="little").sum(axis=0)
    else:  # count byte values, then the bits of the values
        ones = np.concatenate([np.bincount(h[:, i], minlength=256) @ BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_type: str = "bigint") -> DataFrame:
    """``doc_id, fp`` (signed 64 bit) of every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), words, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, fp long")


def segments(radius: int, pieces: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, bits that may differ) of each segment; the allowances plus one each sum to radius + 1."""
    spare = radius + 1 - pieces
    out, at = [], 0
    for i in range(pieces):
        bits = 64 // pieces + (i < 64 % pieces)
        out.append((at, bits, spare // pieces + (i < spare % pieces)))
        at += bits
    return out


def _ball(s: int, value: Column, bits: int, apart: int) -> Column:
    """Array of (segment, value) of the Hamming ball around a segment's value.

    Of two values that differ in one bit only the one with the 1 needs to ask for the other.
    """
    flips = F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for k in range(apart + 1) for c in combinations(range(bits), k)])
    if apart == 1:
        flips = F.filter(flips, lambda f: value.bitwiseAND(f) == f)
    return F.transform(flips, lambda f: F.struct(F.lit(s).alias("s"), value.bitwiseXOR(f).alias("x")))


def links(fps: DataFrame, radius: int = 4, pieces: int | None = None) -> DataFrame:
    """``a, b``: all pairs of different fingerprints (column ``fp``) within ``radius`` bits.

    More than 2^24 fingerprints use longer segments with larger balls; the result is the same.
    """
    nodes = materialise(fps.select("fp").distinct())
    pieces = pieces or (min(radius + 1, 3) if nodes.count() <= 1 << 24 else min(radius + 1, 2))
    stored, asked = [], []
    for s, (first, bits, apart) in enumerate(segments(radius, pieces)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        stored.append(F.struct(F.lit(s).alias("s"), value.alias("x")))
        asked.append(_ball(s, value, bits, apart))
    table = nodes.select(F.explode(F.array(*stored)).alias("k"), F.col("fp").alias("b")).select("k.s", "k.x", "b")
    ball = nodes.select(F.explode(F.flatten(F.array(*asked))).alias("k"), F.col("fp").alias("a")).select("k.s", "k.x", "a")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    met = ball.join(table, (ball.s == table.s) & (ball.x == table.x) & close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` reachable over links, itself included (null ids count
    as none). Empty texts share fingerprint zero and are linked like any other.
    """
    fps = materialise(fingerprints(docs, words, seed))
    roots = connected(links(fps, radius)).withColumnRenamed("node", "fp")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp", "left")
    firsts = materialise(firsts.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = firsts.join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    With ``similarity``, texts whose five-word shingles are as similar (Jaccard) are linked, too.
    It is the row with the smallest ``doc_id`` (null ids last), ties by the text's md5; of equal rows one stays.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("_t"))
    marked = fingerprints(docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t")).alias("doc_id"), "text"),
                          words, seed, "struct<id: bigint, t: binary>")
    fps = materialise(marked.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    found = links(fps, radius)
    if similarity is not None:
        found = materialise(found)
        nodes = materialise(fps.select("doc_id.t", "fp").distinct())
        texts = docs.select(F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t"), text_or_empty().alias("text"))
        found = found.unionByName(near_copies.links(texts, nodes, found, similarity))
    roots = connected(found).withColumnRenamed("node", "fp")
    first = F.min(F.struct(F.col("doc_id.id").isNull().alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.t").alias("t"), "n"))
    best = fps.groupBy("fp").agg(first.alias("b")).join(roots, "fp", "left")
    best = materialise(best.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("b").alias("b")).select("b.*"))
    kept = keyed.join(best, (F.col("_t") == F.col("t")) & F.col("_id").cast("long").eqNullSafe(F.col("id")))
    single, repeated = kept.filter("n = 1").select("_row"), kept.filter("n > 1").dropDuplicates(["_t", "_id"]).select("_row")
    return single.unionByName(repeated).select("_row.*")
