"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it retrieves.

Texts are cut into passages of 32 words, every 16 words; benchmark items likewise. Words (lower case, outer
punctuation off) are hashed to buckets and weighed by squared inverse block frequency over *all* documents. A
randomised SVD of the TF-IDF matrix of *all* passages of benchmark and corpus gives
the latent space: subspace iteration with Spark jobs that sum ``A'(A Q)`` by bucket, over a table of the words'
buckets that is written once. Every passage of every
document is projected, and an item passage is a candidate where the cosine is high and a good part of the item
passage is present. Candidates are verified on words: the longest common subsequence of item and neighbourhood
must cover most of the item (of 64 words around the passage, where an item is longer), or a smaller part together with
the item's answer (its last sentence).

Documents are neither shuffled nor collected, and each task of a fit returns one matrix. Model and item block travel to the tasks; both are bounded
(``BUCKETS x RANK`` numbers, ``ITEMS_AT_ONCE`` items; more items are searched block by block).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, release, slices, text_or_empty

BUCKETS = 1 << 15
BLOCK = 16  # words; a passage is two blocks
RANK, OVERSAMPLE, ROUNDS = 64, 8, 2
CORPUS_DOCS = 1_000  # the passages of the whole corpus weigh as those of so many of its documents do
FIT_TASKS = 4  # at least; each sums one matrix
FIT_BYTES = 1 << 20  # of buckets worked on at once in the fit: half a million words
PART = 1 << 11  # buckets whose rows travel together
BENCH_WEIGHT = 30.0  # of a benchmark passage in the fit: the space is made for what is searched
ITEMS_AT_ONCE = 10_000
ROWS_AT_ONCE = 1 << 9  # of vectors added up together: they stay in the processor's cache
FAN = 8  # vectors added up to one in a step of ``add_by``
LONG_WORD = 24  # bytes up to which words are hashed side by side
TEXT_BYTES = 2 << 20  # of texts cut into words at once
FOREIGN_KEPT = 1 << 17  # words with other characters whose buckets a task keeps; changes speed only
PRODUCT_CELLS = 1 << 21  # of one product of passages with item passages
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
MARKS = "".join(c for c in map(chr, range(128)) if not re.match(r"\w", c))  # what EDGE takes off, of ASCII
SPACE, MARK, LETTER, OTHER = range(4)
KIND = bytes(OTHER if c > 127 else SPACE if chr(c) in SPACES else MARK if chr(c) in MARKS else LETTER for c in range(256))
LATIN = np.array([bytes([0xC3, c]).decode("utf-8", "replace").isalpha() for c in range(256)])  # second bytes of À to ÿ, without × and ÷
CRC = np.arange(256, dtype=np.uint32)  # the table of zlib.crc32
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)


def plain(word: str) -> str:
    """A word in lower case without outer punctuation; marks alone give an empty word."""
    return EDGE.sub("", word.lower())


def plain_words(words: pa.Array) -> pa.Array:
    """``plain`` of an array of words: those in ASCII by Arrow, the others one by one."""
    other = pc.invert(pc.string_is_ascii(words))
    out = pc.ascii_trim(pc.ascii_lower(words), MARKS)
    return pc.replace_with_mask(out, other, pa.array([plain(w) for w in words.filter(other).to_pylist()], out.type))


class Words:
    """The words of texts, in which candidates are verified."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        forms = plain_words(coded.dictionary).dictionary_encode()
        self.distinct = forms.dictionary.to_pylist()
        codes = forms.indices.to_numpy()[coded.indices.to_numpy()]
        real = np.array([bool(w) for w in self.distinct], dtype=bool)[codes] if len(codes) else np.zeros(0, dtype=bool)
        before = np.concatenate([[0], np.cumsum(real)])
        self.bounds = before[cut.offsets.to_numpy()]  # words of each text
        self.codes = codes[real]
        self.starts, _ = block_starts(self.bounds)


def block_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block and number of blocks of each text, from the bounds of the texts' words."""
    n_blocks = -(-np.diff(bounds) // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    return np.repeat(bounds[:-1], n_blocks) + (np.arange(n_blocks.sum()) - np.repeat(first, n_blocks)) * BLOCK, n_blocks


def crc_buckets(low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``zlib.crc32(low[lo:hi]) % BUCKETS`` of many words: byte by byte for all words side by side, long ones on their own."""
    out, size = np.empty(len(lo), dtype=np.int32), hi - lo
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(low[lo[i]:hi[i]]) % BUCKETS
    short = np.flatnonzero(size <= LONG_WORD)
    order = short[np.argsort(LONG_WORD - size[short].astype(np.uint8), kind="stable")]  # the longest first
    at = lo[order]
    longer = len(order) - np.cumsum(np.bincount(size[short], minlength=LONG_WORD + 1))  # words of more than k bytes
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(LONG_WORD):
        now = crc[:longer[k]]
        x = now.astype(np.uint8)
        x ^= low[k:].take(at[:longer[k]], mode="clip")
        now >>= 8
        now ^= CRC.take(x, mode="clip")
    out[order] = (~crc & (BUCKETS - 1)).astype(np.int32)
    return out


def word_buckets(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words of each text and the bucket of each word: the CRC-32 of its ``plain`` form, words with none left out.

    Words of ASCII and the letters À to ÿ are cut, stripped and hashed as bytes, all at once. The others are looked up in
    ``known`` or hashed one by one.
    """
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    n = int(offs[-1] - offs[0])
    if not n:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint16)
    raw, offs = texts.buffers()[2].slice(offs[0], n).to_pybytes(), offs - offs[0]
    data, low, kind = np.frombuffer(raw, dtype=np.uint8), np.frombuffer(bytearray(raw.lower()), dtype=np.uint8), np.frombuffer(bytearray(raw.translate(KIND)), dtype=np.uint8)
    solid = kind != SPACE
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edge = offs[offs < n]
    begins[edge] = solid[edge]
    edge = offs[offs > 0] - 1
    stops[edge] = solid[edge]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    del solid, begins, stops
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[LATIN[data[second]]]
    kind[second - 1] = kind[second] = LETTER
    low[second] += np.where(data[second] < 0x9F, np.uint8(32), np.uint8(0))  # À to Þ; ß is the next one
    bucket, foreign = np.full(len(starts), -1, dtype=np.int32), np.zeros(len(starts), dtype=bool)
    foreign[np.searchsorted(starts, np.flatnonzero(kind == OTHER), side="right") - 1] = True
    letters, place = np.zeros(n + 1, dtype=np.int32), np.flatnonzero(kind == LETTER)
    np.cumsum(kind == LETTER, out=letters[1:])
    a, b = letters[starts], letters[ends]
    del letters, kind
    native = np.flatnonzero((b > a) & ~foreign)
    bucket[native] = crc_buckets(low, place[a[native]], place[b[native] - 1] + 1)
    foreign = np.flatnonzero(foreign)
    if len(foreign):
        size = ends[foreign] - starts[foreign]
        cut = np.concatenate([[0], np.cumsum(size)])
        some = data[np.repeat(starts[foreign] - cut[:-1], size) + np.arange(cut[-1])]
        coded = pa.LargeStringArray.from_buffers(len(foreign), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(some)).dictionary_encode()
        found = []
        for w in coded.dictionary.to_pylist():
            x = known.get(w)
            if x is None:
                x = known[w] = zlib.crc32(p.encode()) % BUCKETS if (p := plain(w)) else -1
            found.append(x)
        bucket[foreign] = np.array(found, dtype=np.int32)[coded.indices.to_numpy()]
        if len(known) > FOREIGN_KEPT:
            known.clear()
    real = bucket >= 0
    before = np.concatenate([[0], np.cumsum(real)])
    return before[np.searchsorted(starts, offs)], bucket[real].astype(np.uint16)


class Blocks:
    """Buckets of texts in blocks; a passage is a block and the next one of its text."""

    def __init__(self, bounds: np.ndarray, buckets: np.ndarray):
        starts, n_blocks = block_starts(bounds)
        self.own = np.repeat(np.arange(len(n_blocks)), n_blocks)  # text of each block
        self.first = np.cumsum(n_blocks) - n_blocks  # block of each text
        self.sizes = np.diff(starts, append=len(buckets))
        self.grid = np.full((len(starts), BLOCK), BUCKETS, dtype=np.uint16)
        self.grid[np.arange(BLOCK) < self.sizes[:, None]] = buckets
        self.joined = np.flatnonzero(self.own[1:] == self.own[:-1])  # blocks with a next one
        self.single = np.flatnonzero(n_blocks[self.own] == 1)

    @classmethod
    def packed(cls, column: pa.Array) -> Blocks:
        """From buckets as bytes, a text a row."""
        sizes = pc.binary_length(column).to_numpy().astype(np.int64) // 2
        return cls(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(column.to_pylist()), dtype="<u2"))

    def frequencies(self) -> np.ndarray:
        """Blocks that hold each bucket."""
        grid = np.sort(self.grid, axis=1)
        new = grid < BUCKETS
        new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        return np.bincount(grid[new], minlength=BUCKETS)

    def norms(self, idf: np.ndarray) -> np.ndarray:
        """Norm of the TF-IDF passage that begins at each block; 0 where a text's last block only ends one."""
        out = np.zeros(len(self.grid))
        for rows, following in ((self.joined, True), (self.single, False)):
            grid = np.hstack([self.grid[rows], self.grid[rows + 1]]) if following else self.grid[rows]
            grid.sort(axis=1)
            value = np.append(idf, np.float32(0))[grid] ** 2
            square, still = value.sum(axis=1, dtype=np.float64), np.arange(len(rows))
            for lag in range(1, grid.shape[1]):  # a bucket that occurs tf times makes tf squared pairs of places
                same = (grid[:, lag:] == grid[:, :-lag]) & (grid[:, lag:] < BUCKETS)
                some = same.any(axis=1)
                if not some.any():
                    break
                grid, value, still, same = grid[some], value[some], still[some], same[some]
                square[still] += 2 * (same * value[:, lag:]).sum(axis=1)
            out[rows] = np.sqrt(square)
        return out


def add_up(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows at ``places`` (rows of the sum x rows added)."""
    out = np.empty((len(places), rows.shape[1]), dtype=np.float32)
    spare, turned = np.empty((ROWS_AT_ONCE, rows.shape[1]), dtype=np.float32), np.ascontiguousarray(places.T)
    for a in range(0, len(places), ROWS_AT_ONCE):
        b = min(a + ROWS_AT_ONCE, len(places))
        now, more = out[a:b], spare[:b - a]
        np.take(rows, turned[0, a:b], axis=0, out=now, mode="clip")
        for place in turned[1:, a:b]:
            np.take(rows, place, axis=0, out=more, mode="clip")
            now += more
    return out


def add_by(total: np.ndarray, group: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows[at]`` to the rows ``group`` (ascending) of ``total``; the last of ``rows`` is zero."""
    while len(group):
        new = np.flatnonzero(np.diff(group, prepend=-1))
        count = np.diff(new, append=len(group))
        lines = -(-count // FAN)
        base = np.cumsum(lines) - lines
        places = np.full(lines.sum() * FAN, len(rows) - 1, dtype=np.int32)
        places[np.arange(len(group)) - np.repeat(new - base * FAN, count)] = at
        rows = np.vstack([add_up(places.reshape(-1, FAN), rows), np.zeros((1, rows.shape[1]), dtype=np.float32)])
        done = lines == 1
        total[group[new[done]]] += rows[base[done]]
        at, group = np.flatnonzero(np.repeat(~done, lines)), np.repeat(group[new[~done]], lines[~done])


def coded(texts: DataFrame) -> DataFrame:
    """``w``: the buckets of the words of each ``text``, two bytes each."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for a, b in slices(batch, "text", TEXT_BYTES):
                bounds, buckets = word_buckets(batch.column("text").slice(a, b - a), known)
                raw = buckets.astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([raw[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["w"])

    return texts.select("text").mapInArrow(run, "w binary")


def inverse_frequency(codes: DataFrame) -> np.ndarray:
    """Squared ln((1 + blocks) / (1 + blocks with the bucket)) over all texts, by bucket: common words hardly count."""

    def run(batches):
        total, blocks = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for a, b in slices(batch, "w", FIT_BYTES):
                part = Blocks.packed(batch.column("w").slice(a, b - a))
                total += part.frequencies()
                blocks += len(part.grid)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(total[hit], blocks))], names=["bucket", "n"])

    rows = fit_tasks(codes).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    blocks, counts = int(n[bucket < 0].sum()), np.zeros(BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return (np.log((1 + blocks) / (1 + counts)) ** 2).astype(np.float32)


def fit_tasks(rows: DataFrame) -> DataFrame:
    """As many partitions as tasks run at once: each returns one matrix, so what is shuffled does not grow with the corpus."""
    return rows.coalesce(max(FIT_TASKS, rows.sparkSession.sparkContext.defaultParallelism))


def passages(codes: DataFrame, idf: np.ndarray, weight: float) -> DataFrame:
    """``w, s``: the buckets of each text and by what the TF-IDF passage that begins at each block is scaled to norm ``weight`` (0: none does)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "w", FIT_BYTES):
                part = Blocks.packed(batch.column("w").slice(a, b - a))
                norm = part.norms(idf)
                scale = np.divide(weight, norm, out=np.zeros_like(norm), where=norm > 0).astype("<f4")
                bounds = np.append(part.first, len(scale)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("w").slice(a, b - a), pa.array([scale[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["w", "s"])

    return codes.mapInArrow(run, "w binary, s binary")


def latent_space(rows: DataFrame, idf: np.ndarray, rank: int = RANK, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Right singular vectors (buckets x rank) of all ``passages`` by randomised subspace iteration."""
    rng, rows = np.random.default_rng(seed), fit_tasks(rows)
    q = rng.standard_normal((BUCKETS, rank + oversample)).astype(np.float32)
    for _ in range(rounds + 1):

        def run(batches, q=q):
            weighed, total = np.vstack([q * idf[:, None], np.zeros((1, q.shape[1]), dtype=np.float32)]), np.zeros_like(q)
            for batch in batches:
                for a, b in slices(batch, "w", FIT_BYTES):
                    add_products(total, Blocks.packed(batch.column("w").slice(a, b - a)), np.frombuffer(b"".join(batch.column("s").slice(a, b - a).to_pylist()), dtype="<f4"), weighed)
            total *= idf[:, None]
            for part in range(0, BUCKETS, PART):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total[part:part + PART].tobytes()])], names=["part", "z"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(z, dtype=np.float32).astype(np.float64) for z in part["z"])
            return pd.DataFrame({"part": part["part"].iloc[:1], "z": [total.astype(np.float32).tobytes()]})

        got = rows.mapInArrow(run, "part int, z binary").groupBy("part").applyInPandas(add, "part int, z binary").toArrow()  # one matrix
        z = np.zeros_like(q)
        for part, raw in zip(got.column("part").to_pylist(), got.column("z").to_pylist(), strict=True):
            z[part:part + PART] = np.frombuffer(raw, dtype=np.float32).reshape(-1, q.shape[1])
        q = np.linalg.qr(z)[0].astype(np.float32) if z.any() else np.zeros_like(q)
    return q[:, :rank]


def add_products(total: np.ndarray, part: Blocks, scale: np.ndarray, weighed: np.ndarray) -> None:
    """Add the passages' ``A'(A Q)`` to ``total``, but for the weight of the bucket; ``weighed`` is Q by weight, with a row of zeros."""
    product = add_up(part.grid, weighed)
    product[part.joined] += product[part.joined + 1]
    product *= (scale ** 2)[:, None]
    rows = np.vstack([product, np.zeros((1, product.shape[1]), dtype=np.float32)])
    rows[part.joined + 1] += product[part.joined]  # a block is in the passage that it begins and in the one before
    buckets = part.grid[part.grid < BUCKETS]
    order = np.argsort(buckets, kind="stable")
    add_by(total, buckets[order].astype(np.int32), np.repeat(np.arange(len(part.grid), dtype=np.int32), part.sizes)[order], rows)


def common_length(masks: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    row = (1 << size) - 1
    full = row
    for w in words:
        u = row & masks.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks_of(words: list[str]) -> tuple[dict[str, int], int]:
    """The places of each word as bits, and the number of words."""
    masks: dict[str, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks, len(words)


class Items:
    """Benchmark items with their passages in the latent space.

    A passage of an item of up to 64 words is verified on the whole item, one of a longer item on the 64 words around
    it, so that a part of a long item is a leak, too.
    """

    def __init__(self, texts: list[str], idf: np.ndarray, space: np.ndarray):
        self.answers, self.parts, vectors, owner = [], [], [], []
        projected = space * idf[:, None]
        for n, text in enumerate(texts):
            words = [p for w in re.split(r"[ \t-\r]+", text) if (p := plain(w))]
            last = re.split(r"[.!?]\s+", text.strip().rstrip(".!?"))[-1]
            answer = {p for w in last.split() if (p := plain(w))}
            self.answers.append(answer or set(words))
            buckets = np.array([zlib.crc32(w.encode()) % BUCKETS for w in words], dtype=np.int64)
            whole = masks_of(words) if len(words) <= 4 * BLOCK else None
            for s in range(0, max(1, len(words) - BLOCK), BLOCK):
                self.parts.append(whole or masks_of(words[max(0, s - BLOCK):s + 3 * BLOCK]))
                vectors.append(projected[buckets[s:s + 2 * BLOCK]].sum(axis=0))
                owner.append(n)
        self.vectors = np.array(vectors, dtype=np.float32).reshape(-1, space.shape[1])
        self.owner = np.array(owner, dtype=np.int64)
        self.square = (self.vectors ** 2).sum(axis=1)


def search(texts: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float, presence: float, share: float, answered: float) -> DataFrame:
    projected = space * idf[:, None]
    keep = np.flatnonzero(items.square > 0)
    queries, square, owner, parts = items.vectors[keep], items.square[keep], items.owner[keep], [items.parts[i] for i in keep.tolist()]
    floor = presence ** 2 * square.min() if len(keep) else np.inf  # a passage with less energy holds no part of any item large enough

    size = np.sqrt(square)
    unit, least = (queries / size[:, None]).T.copy(), presence * size  # a product with a unit passage must reach both limits
    at_once = max(64, PRODUCT_CELLS // max(1, len(keep)))
    rows = np.vstack([projected, np.zeros((1, projected.shape[1]), dtype=np.float32)]).astype(np.float32)

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            found: dict[str, list] = {"t": [], "item": [], "cosine": [], "lcs_share": []}
            for a, b in slices(batch, "text", TEXT_BYTES):
                texts = batch.column("text").slice(a, b - a)
                blocks = Blocks(*word_buckets(texts, known))
                own = np.append(blocks.own, -1)
                n_blocks = len(blocks.grid)
                best: dict[tuple[int, int], tuple[float, int]] = {}
                looked, words = -1, None
                for c in range(0, n_blocks, at_once):
                    end = min(c + at_once, n_blocks)
                    sums = add_up(blocks.grid[c:end + 1], rows)
                    joined = np.flatnonzero(own[c:end] == own[c + 1:end + 1])  # a passage is a block and the next one of its text
                    pair = sums[:end - c].copy()
                    pair[joined] += sums[joined + 1]
                    del sums
                    energy = np.einsum("ij,ij->i", pair, pair)
                    strong = np.flatnonzero(energy >= floor)
                    dot = pair[strong] @ unit
                    limit = cosine * np.sqrt(energy[strong])
                    top = dot.max(axis=1, initial=-np.inf)
                    some = np.flatnonzero((top >= limit) & (top >= least.min(initial=np.inf)))
                    r, q = np.nonzero((dot[some] >= least) & (dot[some] >= limit[some][:, None]))
                    r = some[r]
                    for p, n, part, cos in zip((c + strong[r]).tolist(), owner[q].tolist(), q.tolist(), (dot[r, q] / np.sqrt(energy[strong[r]])).tolist(), strict=True):
                        d = int(own[p])
                        if d != looked:
                            looked, words = d, Words(texts.slice(d, 1))  # the passages come text by text
                        yes = verified(words, *parts[part], items.answers[n], 0, p - int(blocks.first[d]), share, answered)
                        if yes is not None and ((d, n) not in best or (yes, cos) > best[d, n]):
                            best[d, n] = (yes, cos)
                for (d, n), (lcs, cos) in best.items():
                    found["t"].append(batch.column("t")[a + d].as_py())
                    found["item"].append(n)
                    found["cosine"].append(cos)
                    found["lcs_share"].append(lcs)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("t", pa.binary()), ("item", pa.int32()), ("cosine", pa.float64()), ("lcs_share", pa.float64())]))

    return texts.mapInArrow(run, "t binary, item int, cosine double, lcs_share double")


def verified(words: Words, masks: dict[str, int], size: int, answer: set[str], doc: int, block: int, share: float, answered: float) -> float | None:
    """Share of some words of an item that is a common subsequence with the passage's neighbourhood, if it makes a leak."""
    at = int(words.starts[block])
    lo, hi = max(int(words.bounds[doc]), at - size), min(int(words.bounds[doc + 1]), at + 2 * BLOCK + size)
    near = [words.distinct[c] for c in words.codes[lo:hi].tolist()]
    covered = 0
    for w in set(near):
        covered |= masks.get(w, 0)
    if covered.bit_count() / size < min(share, answered):  # no subsequence can be longer
        return None
    lcs = common_length(masks, size, near) / size
    if lcs >= share:
        return lcs
    return lcs if lcs >= answered and len(answer & set(near)) >= share * len(answer) else None


def one_of_each(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (``t, text``, made from ``docs``) with the copy of least hash of a repeated text, without shuffling texts."""
    if "doc_id" not in docs.columns:
        return texts
    keyed = docs.select(F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t"), text_or_empty().alias("text"), F.xxhash64("doc_id").alias("_u"))
    copies = materialise(keyed.groupBy("t").agg(F.count(F.lit(1)).alias("_n"), F.min("_u").alias("_least")).filter("_n > 1").drop("_n"))
    copies = F.broadcast(copies) if copies.limit(1_000_001).count() <= 1_000_000 else copies  # 24 bytes each
    return keyed.join(copies, "t", "left").filter(F.coalesce(F.col("_u") == F.col("_least"), F.lit(True))).select("t", "text")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, presence: float = 0.4, share: float = 0.8, answered: float = 0.6) -> DataFrame:
    """``t, item_id, cosine, lcs_share``: each distinct text key and benchmark item that leaks into it.

    ``t`` is the md5 of the text. Null texts and items are empty and leak nothing; repeated rows count once;
    items with no word but marks are left out. Empty tables give no rows.
    """
    texts = docs.select(F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t"), text_or_empty().alias("text"))
    bench = benchmark.select("item_id", text_or_empty().alias("text")).filter(F.col("text").rlike(r"\w")).dropDuplicates()
    codes = materialise(coded(texts))
    idf = inverse_frequency(codes)
    weight = min(1.0, (CORPUS_DOCS / max(1, codes.count())) ** 0.5)
    fitted = materialise(passages(coded(bench), idf, BENCH_WEIGHT).unionByName(passages(codes, idf, weight)))
    release(codes)
    space = latent_space(fitted, idf)
    release(fitted)
    one = one_of_each(docs, texts)
    blocks = max(1, -(-bench.count() // ITEMS_AT_ONCE))
    numbered = bench.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = numbered.filter(F.col("_b") == b).select("item_id", "text").collect()  # about ITEMS_AT_ONCE rows
        hits = search(one, Items([r.text for r in part], idf, space), idf, space, cosine, presence, share, answered)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        hits = hits.join(F.broadcast(names), "item").select("t", "item_id", "cosine", "lcs_share")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("t", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_t", F.unhex(F.md5(text_or_empty().cast("binary"))))


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share`` of every leak, one row per document row and item."""
    found = materialise(leaks(docs, benchmark, **options)).withColumnRenamed("t", "_t")
    return with_key(docs.select("doc_id", "text")).select("doc_id", "_t").join(found, "_t").drop("_t")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item leaks, with all their columns."""
    found = materialise(leaks(docs, benchmark, **options)).select(F.col("t").alias("_t")).distinct()
    found = F.broadcast(found) if found.limit(1_000_001).count() <= 1_000_000 else found  # 16 bytes each
    key = F.unhex(F.md5(text_or_empty().cast("binary")))
    return docs.join(found, key == found["_t"], "left_anti")
