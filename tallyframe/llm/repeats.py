"""Removal of repeated byte strings of a fixed length, by difference-cover suffix sorting.

1. *Sampling.* Every window of ``length`` bytes chooses one anchor inside it: the position with the least hash in
   its middle part. Equal windows choose the same place, so two equal windows have anchors with an equal
   neighbourhood. Anchors whose neighbourhood occurs once in the corpus cannot belong to a repeat and are
   dropped; nothing is lost. Where the whole stretch of windows of an anchor occurs twice, all of them repeat;
   other stretches are compared in grains of 16 windows, and what is open then in grains of four, by all bytes of a
   grain and by those its windows share. A text that occurs twice as a whole repeats; one copy stands for it.
2. *Suffix sorting* of what is left undecided: the stretches that agree only in part, and one representative
   of each stretch that they may agree with. Positions 1 and 2 modulo 3 are the difference cover. Their
   triples of 24-byte words are sorted and named in order; triples of names are sorted and named in
   turn (reaching 72 and 198 bytes). A triple that occurs once ends its suffix's part in the work.
   The remaining suffixes are merged by the one or two symbols before a named suffix and those after it: for
   any two positions there is a shift of at most two that brings both into the cover.
3. *Adjacent prefixes* that agree over ``length`` bytes are the suffixes with one merged name that occurs twice.

Names are given to distinct triples (aggregated before the shuffle), and joined back, so a passage in a
third of all documents is a split join and not one task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import materialise, release, text_or_empty

GRAM = 8  # bytes hashed at a possible anchor
SPARE = 32  # an anchor is at least so far from the start of its windows
REACH = 128  # possible anchors of a window
STEP = 4 << 20  # windows worked on at once
STRIDES = (63, 126)  # of the second naming, multiples of 3: 72 bytes become 198
GRAINS = (16, 4)  # window starts decided together, counted from the anchor; each a multiple of the next
SPANS_BROADCAST = 1_000_000  # spans (32 bytes each at most) up to which they travel to the texts


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """First and last window start of each anchor, its own place, the hash of its neighbourhood, and of its whole stretch."""
    los, his, places, near, full = [], [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for base in range(0, len(text) - length + 1, STEP):
        part = text[base:base + STEP + length - 1]
        n = len(part) - length + 1
        raw = np.frombuffer(part, dtype=np.uint8)[SPARE:]
        m = n + REACH - 1
        h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)[:m]).view("<u8").ravel()
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)  # least hash, then leftmost
        width = 1
        while width < REACH:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        at = (v & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], n) - 1
        pos = at[first] + SPARE
        los.append(first + base)
        his.append(last + base)
        places.append(pos + base)
        near += [digest(part[a - SPARE:a + length - SPARE - REACH + 1]) for a in pos.tolist()]
        full += [digest(part[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
    if not los:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
    return np.concatenate(los), np.concatenate(his), np.concatenate(places), near, full


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``t, lo, hi, a, k, e`` of every anchor of rows ``t`` (key of the text), ``text``."""

    def run(batches):
        for batch in batches:
            keys, rows = batch.column("t"), batch.column("text")
            held: list = []
            count = 0
            for i in range(batch.num_rows):
                text = rows[i].as_buffer().to_pybytes()
                if len(text) >= length:
                    held.append((i, *anchors(text, length)))
                    count += len(held[-1][1])
                if held and (count > 200_000 or i + 1 == batch.num_rows):
                    which = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(which)), pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[2] for x in held])),
                        pa.array(np.concatenate([x[3] for x in held])), _signed([h for x in held for h in x[4]]), _signed([h for x in held for h in x[5]])],
                        names=["t", "lo", "hi", "a", "k", "e"])
                    held, count = [], 0

    return texts.mapInArrow(run, "t binary, lo long, hi long, a long, k long, e long")


def join_texts(texts: DataFrame, spans: DataFrame, n_spans: int, how: str) -> DataFrame:
    """Texts with their spans; the spans are sent to the texts only if counted small, else both are shuffled."""
    return texts.join(F.broadcast(spans) if n_spans <= SPANS_BROADCAST else spans, "t", how)


def named(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replace the ``keys`` of suffix rows by a name in their sort order; keys that occur once are dropped.

    Also returns the written table of names, for the caller to release.
    """
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    names = materialise(twice.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))
    return rows.join(names, keys).select("seg", "i", "name"), names


def _by_segment(rows: DataFrame, build, schema: str) -> DataFrame:
    """Apply ``build(seg, i, rows of the batch)`` to the rows of each segment in order of ``i``."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            seg = table.column("seg").to_numpy()
            cut = int(np.searchsorted(-(seg != seg[-1]).astype(int), 0)) if len(seg) else 0  # where the last segment starts
            rest = table.slice(cut)
            yield from pieces(table.slice(0, cut))
        if rest is not None:
            yield from pieces(rest)

    def pieces(table):
        if table.num_rows:
            table = table.combine_chunks()
            seg = table.column("seg").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(seg, prepend=seg[0] - 1)), len(seg))
            out = [r for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if (r := build(table.slice(a, b - a))) is not None]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return rows.repartition("seg").sortWithinPartitions("seg", "i").mapInArrow(run, schema)


def _filled(table: pa.Table) -> np.ndarray:
    """Names by position, -1 where a suffix has none."""
    i = table.column("i").to_numpy()
    names = np.full(int(i[-1]) + 1, -1, dtype=np.int64)
    names[i] = table.column("name").to_numpy()
    return names


def wider(rows: DataFrame, first: int, second: int) -> DataFrame:
    """Triples of names at a position and two strides on."""

    def build(table):
        names = _filled(table)
        n = len(names) - second
        if n <= 0:
            return None
        a, b, c = names[:n], names[first:first + n], names[second:second + n]
        ok = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
        return pa.table({"seg": np.full(len(ok), table.column("seg")[0].as_py()), "i": ok, "a": a[ok], "b": b[ok], "c": c[ok]}) if len(ok) else None

    return _by_segment(rows, build, "seg long, i long, a long, b long, c long")


def words_of(segments: DataFrame, length: int) -> DataFrame:
    """Triples of 24-byte words at the cover's positions of each segment."""

    def column(words: np.ndarray) -> pa.Array:
        offsets = np.arange(0, 24 * len(words) + 1, 24, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])

    def run(batches):
        for batch in batches:
            for seg, raw in zip(batch.column("seg").to_pylist(), batch.column("bytes"), strict=True):
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                wanted = np.zeros(max(0, len(data) - 71), dtype=bool)
                for s in (0, *STRIDES):  # where the names of a window's suffixes will look
                    wanted[s:s + max(0, len(data) - length + 3)] = True
                wanted[::3] = False
                for first in range(0, len(wanted), STEP):
                    i = np.flatnonzero(wanted[first:first + STEP]) + first
                    words = np.lib.stride_tricks.sliding_window_view(data, 24)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), seg)), pa.array(i), *[column(words[i + s]) for s in (0, 24, 48)]], names=["seg", "i", "a", "b", "c"])

    return segments.select("seg", "bytes").mapInArrow(run, "seg long, i long, a binary, b binary, c binary")


def merged(names: DataFrame, segments: DataFrame, length: int, reach: int = 198) -> DataFrame:
    """Up to two merged keys ``x, r`` of every suffix ``seg, i``: equal keys mean equal ``length`` bytes.

    ``x`` holds the shift to the named suffix and the symbols around its ``reach`` bytes.
    """

    def build(table):
        raw = table.column("bytes")[0]
        if not raw.is_valid or table.num_rows < 2:
            return None
        data, rest = np.frombuffer(raw.as_buffer(), dtype=np.uint8).astype(np.int64), table.slice(1)
        n = len(data) - length + 1
        r = np.full(n + 2, -1, dtype=np.int64)
        got = _filled(rest)[:n + 2]
        r[:len(got)] = got
        p = np.arange(n)
        out = []
        for shift, residues in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
            q = p[np.isin(p % 3, residues) & (r[p + shift] >= 0)]
            around = [q + s for s in range(shift)] + [q + s for s in range(shift + reach, length)]
            x = np.full(len(q), shift)
            for s in around:
                x = x * 256 + data[s]
            out.append((q, x, r[q + shift]))
        q, x, name = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"seg": np.full(len(q), table.column("seg")[0].as_py()), "i": q, "x": x, "r": name}) if len(q) else None

    both = names.select("seg", "i", "name", F.lit(None).cast("binary").alias("bytes")).unionByName(
        segments.select("seg", F.lit(-1).cast("long").alias("i"), F.lit(None).cast("long").alias("name"), "bytes"))
    return _by_segment(both, build, "seg long, i long, x long, r long")


def runs(windows: DataFrame) -> DataFrame:
    """Consecutive window starts ``i`` of a segment as ``seg, lo, hi``."""

    def build(table):
        i = np.unique(table.column("i").to_numpy())
        first = np.flatnonzero(np.diff(i, prepend=i[0] - 2) > 1)
        last = np.append(first[1:], len(i)) - 1
        return pa.table({"seg": np.full(len(first), table.column("seg")[0].as_py()), "lo": i[first], "hi": i[last]})

    return _by_segment(windows, build, "seg long, lo long, hi long")


def suffix_repeats(segments: DataFrame, length: int) -> DataFrame:
    """Windows ``seg, lo, hi`` of the segments (``seg, bytes``) that occur twice or more among them."""
    short, used = named(words_of(segments, length), ["a", "b", "c"])
    short = materialise(short)
    release(used)
    long, used = named(wider(short, *STRIDES), ["a", "b", "c"])
    keys = materialise(merged(long, segments, length))
    release(short, used)
    twice = keys.groupBy("x", "r").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("x", "r")
    return runs(keys.join(twice, ["x", "r"], "left_semi").select("seg", "i"))


def repeated_windows(texts: DataFrame, length: int = 200) -> DataFrame:
    """``t, spans``: where each text of ``texts`` (``t, text, u``) has bytes of windows of ``length`` bytes that occur again.

    A span's ``lo`` and ``hi`` are its first and last window. ``t`` is the key of a text, ``u`` tells its copies apart.
    ``length`` must be 200: the strides of the cover are made for it.
    """
    if length != 200:
        raise ValueError("the difference cover is laid out for 200 bytes")
    found = []

    def note(windows: DataFrame, *read: DataFrame) -> None:
        """Keep windows in few rows and delete the tables that are read."""
        found.append(materialise(merged_spans(windows, length)))
        if read:
            release(*read)

    # the copy with the least hash of the other columns stands for a text; should several have it, they all do
    copies = materialise(texts.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least"), F.min(F.octet_length("text")).alias("size")).filter("n > 1").drop("n"))
    note(copies.filter(F.col("size") >= length).select("t", F.lit(0).cast("long").alias("lo"), (F.col("size") - length).cast("long").alias("hi")))
    least = copies.select("t", "least")
    least = F.broadcast(least) if copies.count() <= SPANS_BROADCAST else least
    one = texts.join(least, "t", "left").filter(F.coalesce(F.col("u") == F.col("least"), F.lit(True))).select("t", "text")
    texts = texts.select("t", "text")
    every = materialise(anchor_rows(one, length))
    twice = materialise(every.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("k"))
    again = F.broadcast(twice) if twice.limit(SPANS_BROADCAST + 1).count() <= SPANS_BROADCAST else twice
    rows = materialise(every.join(again, "k", "left_semi"))
    release(every, twice, copies)
    classes = materialise(rows.groupBy("k", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "lo", "hi", "a")).alias("r")))
    note(rows.join(classes.filter("n > 1").select("k", "e"), ["k", "e"], "left_semi").select("t", "lo", "hi"), rows)
    split = classes.groupBy("k").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("k")
    open_ = materialise(classes.join(split, "k", "left_semi").select("r.*"))
    release(classes)
    for grain in GRAINS:
        part = materialise(grains(texts, open_, length, grain))
        alike = materialise(part.groupBy("c", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "lo", "hi", "a")).alias("r")))
        note(part.join(alike.filter("n > 1").select("c", "f"), ["c", "f"], "left_semi").select("t", "lo", "hi"), part, open_)
        split = alike.groupBy("c").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("c")
        open_ = materialise(alike.join(split, "c", "left_semi").select("r.*"))
        release(alike)
    segments = materialise(regions(texts, open_.select("t", "lo", (F.col("hi") + length).alias("end"))).withColumn("seg", F.monotonically_increasing_id()))
    release(open_)
    sorted_ = suffix_repeats(segments, length).join(segments.select("seg", "t", "start"), "seg")
    note(sorted_.select("t", (F.col("lo") + F.col("start")).alias("lo"), (F.col("hi") + F.col("start")).alias("hi")), segments)
    windows = reduce(DataFrame.unionByName, found).select("t", F.explode("spans").alias("s")).select("t", "s.*")
    return merged_spans(windows, length)


def merged_spans(windows: DataFrame, length: int) -> DataFrame:
    """``t, spans``: the windows ``t, lo, hi`` of a text in order, those whose bytes touch as one. A text's length bounds them."""

    def run(batches):
        for batch in batches:
            packed = batch.column("p")
            per = np.diff(packed.offsets.to_numpy())
            flat = packed.flatten().to_numpy()
            text = np.repeat(np.arange(len(per), dtype=np.int64) << 33, per)  # keeps the texts of a batch apart
            lo, hi = text + (flat >> 32), text + (flat & 0xFFFFFFFF)
            end = np.maximum.accumulate(hi) if len(hi) else hi
            first = np.flatnonzero(np.append(True, lo[1:] > end[:-1] + length)) if len(lo) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(lo)) - 1 if len(lo) else first
            base = text[first]
            bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum(per)])).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(lo[first] - base), pa.array(end[last] - base)], names=["lo", "hi"])
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["t", "spans"])

    packed = windows.groupBy("t").agg(F.sort_array(F.collect_set(F.shiftleft("lo", 32) + F.col("hi"))).alias("p"))
    return packed.mapInArrow(run, "t binary, spans array<struct<lo:long,hi:long>>")


def _with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts with the ``spans`` of their key as an array, which the length of a text bounds."""
    fields = [c for c in spans.columns if c != "t"]
    lists = materialise(spans.groupBy("t").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("spans")))
    count = lists.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    return join_texts(texts, lists, count, "inner")


def grains(texts: DataFrame, stretches: DataFrame, length: int, grain: int) -> DataFrame:
    """``c, f, t, lo, hi, a``: the stretches (``t, lo, hi, a``) in grains of window starts at like distances from their anchor.

    ``c`` is the hash of the bytes that all windows of a grain share: windows of two grains can only be
    equal if they agree in it. ``f`` is the hash of all bytes of the grain's windows: where it occurs
    twice, all of them repeat.
    """
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            c, f, owner, los, his, at = [], [], [], [], [], []
            for n, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
                raw = text.as_buffer().to_pybytes()
                fields = [spans.values.field(x).to_pylist() for x in ("lo", "hi", "a")]
                for first, last, a in zip(*fields, strict=True):
                    for top in range(a - (a - last) // grain * grain, first - 1, -grain):
                        lo, hi = max(first, top - grain + 1), min(last, top)
                        c.append(digest(raw[top:top - grain + 1 + length]))
                        f.append(digest(raw[lo:hi + length]))
                        owner.append(n)
                        los.append(lo)
                        his.append(hi)
                        at.append(a)
            yield pa.RecordBatch.from_arrays([_signed(c), _signed(f), batch.column("t").take(pa.array(owner, pa.int32())), *[pa.array(x, pa.int64()) for x in (los, his, at)]],
                                             names=["c", "f", "t", "lo", "hi", "a"])

    return _with_spans(texts, stretches).mapInArrow(run, "c long, f long, t binary, lo long, hi long, a long").dropDuplicates(["t", "lo"])


def regions(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``t, start, bytes``: the bytes of each text's ``spans`` (``t, lo, end``), overlapping ones as one."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"t": [], "start": [], "bytes": []}
            for t, text, marks in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                at, end = marks[0]["lo"], marks[0]["end"]
                for s in [*marks[1:], None]:
                    if s is None or s["lo"] > end:
                        out["t"].append(t)
                        out["start"].append(at)
                        out["bytes"].append(raw[at:end])
                        at = s and s["lo"]
                    end = s and max(end if s["lo"] <= end else 0, s["end"])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("t", pa.binary()), ("start", pa.int64()), ("bytes", pa.binary())]))

    return _with_spans(texts, spans).mapInArrow(run, "t binary, start long, bytes binary").dropDuplicates(["t", "start"])


def _cut(length: int):
    """A column function: what is left of ``text`` (bytes) without its ``spans`` of window starts."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for raw, marks in zip(text, spans, strict=True):
            kept, removed, count, at, end = [], 0, 0, 0, -1
            for m in marks:
                a, b = m["lo"], m["hi"] + length
                if a > end:
                    kept.append(raw[at:a])
                    count, removed, end = count + 1, removed + b - a, b
                elif b > end:
                    removed, end = removed + b - end, b
                at = end
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct), with ``n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte covered by a ``length``-byte string that starts twice or more anywhere goes, all copies alike;
    strings are judged on the input and never cross documents. A null text counts as empty; a repeated row
    is another document, whatever its id; texts shorter than ``length`` stay whole. ``kept`` are the
    remaining bytes, which may start or end inside a character.
    """
    raw = F.col("text").cast("binary")
    texts = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text")).withColumn("t", F.unhex(F.md5(raw)))
    plain = [f.name for f in docs.schema if f.name != "text" and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    spans = materialise(repeated_windows(texts.select("t", "text", F.xxhash64(F.lit(0), *[f"row.`{c}`" for c in plain]).alias("u")), length))
    n_spans = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    joined = join_texts(texts, spans, n_spans, "left")
    none = F.lit(0).cast("long")
    whole = F.struct(F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    free = joined.filter(F.col("spans").isNull()).select("row", whole.alias("c"))
    hit = joined.filter(F.col("spans").isNotNull()).select("row", _cut(length)(raw, F.col("spans")).alias("c"))
    return free.unionByName(hit).select("row", "c.*")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with their columns and the repeated bytes out of ``text``; ``n_chars``, if there, follows.

    Broken characters at the cuts go as well. A document of which nothing but white space is left goes.
    """
    done = remove_repeats(docs, length)

    @F.pandas_udf("string")
    def readable(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    same = done.filter("n_removed = 0").select("row.*")
    cut = done.filter("n_removed > 0").select("row", readable("kept").alias("kept")).filter(F.col("kept").rlike(r"\S"))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return same.unionByName(cut.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns]))
