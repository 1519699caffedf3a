"""Ranked lexical search as retrieval of large inner products in buckets of similar length.

A document is an impact vector over the terms of the queries, a query a vector of term weights; a score is their inner
product. Vectors are put in order of length and cut into buckets. With the k-th best score known so far, the
Cauchy-Schwarz inequality skips whole buckets for a query; inside a bucket the coordinates of the query's heaviest terms
are summed exactly, the inequality bounds the rest, and only documents whose bound reaches the k-th score survive. Survivors
are scored anew from the stored counts in 64-bit integers.

Both sides are scaled by the square root of the term weight, which tightens the bounds and leaves products as they are.
Texts are read once: what is kept of a document are its counts of query terms. The queries (``QUERY_BYTES`` of text at
once) travel to the tasks; documents are never collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

SCALE, K_TF, K_LEN = 1_000_000_000, 1000, 8
BUCKET = 1024  # documents
HEAVY = 8  # coordinates that are summed before the rest is bounded
SEEDS = 1024  # longest vectors, which give the first k-th scores
QUERY_BYTES = 16 << 20
#: Other ASCII than digits and letters ends a term; A-Z go to lower case. Bytes from 128 on stay, so UTF-8 stays whole.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "doc_id long, n long, terms array<int>, tf array<int>"


def terms_of(text: str) -> list[str]:
    """The terms of a text, in order."""
    return text.encode().translate(TERM_BYTES).decode().split(" ")


def folded(texts: pa.Array) -> pa.Array:
    """Texts whose terms are in lower case and separated by blanks: each byte is replaced by one byte."""
    texts = pa.concat_arrays([texts])  # offsets from zero
    _, offsets, data = texts.buffers()
    large = pa.types.is_large_string(texts.type)
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(TERM_BYTES)))


def count_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per document ``n`` (terms with repeats) and its counts ``tf`` of the vocabulary's ``terms`` (numbers); none for texts without terms."""
    known = pa.array(vocabulary, pa.string())

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "text"):
                piece = batch.slice(a, b - a)
                cut = pc.split_pattern(folded(piece.column("text")), " ")
                coded = cut.flatten().dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False)
                blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
                codes, owner = coded.indices.to_numpy(), np.repeat(np.arange(b - a), np.diff(cut.offsets.to_numpy()))
                n = np.bincount(owner[~blank[codes]], minlength=b - a)
                hit = number[codes]
                pair, tf = np.unique(owner[hit >= 0] * np.int64(len(known) + 1) + hit[hit >= 0], return_counts=True)
                doc, term = np.divmod(pair, len(known) + 1)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))])
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (term, tf)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, COUNTED)


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms, summed in the tasks first."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["term", "n"])

    got = counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one number per query term
    out = np.zeros(size, dtype=np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


class Queries:
    """Weight vectors of some queries, and what is needed of the corpus to score them."""

    def __init__(self, texts: list[str], vocabulary: list[str], documents: int, terms: int, df: np.ndarray):
        number = {t: i for i, t in enumerate(vocabulary)}
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        self.root = np.sqrt(self.weight.astype(np.float64))
        self.rows = []
        for text in texts:
            own = np.array(sorted({number[t] for t in terms_of(text) if t}), dtype=np.int64)
            own = own[(self.weight[own] > 0) & (df[own] > 0)] if len(own) else own
            self.rows.append(own[np.argsort(-self.weight[own], kind="stable")])
        self.norm = np.array([math.sqrt(self.weight[r].sum()) for r in self.rows])

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.documents) // self.terms
        return (SCALE * tf) // (K_TF * tf + K_LEN * m)


def with_length(counted: DataFrame, q: Queries) -> DataFrame:
    """Add ``length``: the norm of the impact vector, scaled by the roots of the term weights."""

    def run(batches):
        for batch in batches:
            terms, offs = batch.column("terms").flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column("terms").value_lengths().to_numpy())])
            n, tf = np.repeat(batch.column("n").to_numpy(), np.diff(offs)), batch.column("tf").flatten().to_numpy().astype(np.int64)
            square = (q.root[terms] * q.impacts(n, tf)) ** 2
            sums = np.concatenate([[0.0], np.cumsum(square)])
            parts = np.add.reduceat(np.append(square, 0.0), offs[:-1]) if batch.num_rows else sums[:0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.where(np.diff(offs) > 0, parts, 0.0)))], names=[*batch.schema.names, "length"])

    return counted.mapInArrow(run, COUNTED + ", length double")


class Bucket:
    """Documents of similar length by rows, and by term for the coordinate bounds."""

    def __init__(self, batch: pa.RecordBatch, q: Queries):
        self.ids, self.length = batch.column("doc_id").to_pylist(), batch.column("length").to_numpy()
        sizes = batch.column("terms").value_lengths().to_numpy()
        self.offs = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = batch.column("terms").flatten().to_numpy()
        self.impact = q.impacts(np.repeat(batch.column("n").to_numpy(), sizes), batch.column("tf").flatten().to_numpy().astype(np.int64))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.owner, self.scaled = self.terms[order], np.repeat(np.arange(len(sizes)), sizes)[order], (q.root[self.terms] * self.impact)[order]

    def survivors(self, q: Queries, row: np.ndarray, least: float) -> np.ndarray:
        """Documents whose heavy coordinates, with the bound of the rest, reach ``least``."""
        done, square = np.zeros(len(self.length)), np.zeros(len(self.length))
        for t in row[:HEAVY].tolist():
            a, b = np.searchsorted(self.by_term, [t, t + 1])
            at, value = self.owner[a:b], self.scaled[a:b]
            done[at] += q.root[t] * value
            square[at] += value ** 2
        rest = np.sqrt(np.maximum(self.length ** 2 - square, 0)) * math.sqrt(q.weight[row[HEAVY:]].sum())
        return np.flatnonzero((done + rest) * (1 + 1e-9) + 1 >= least)

    def scores(self, q: Queries, row: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact integer scores of some documents."""
        wanted = np.zeros(len(q.weight), dtype=np.int64)
        wanted[row] = q.weight[row]
        sizes = self.offs[docs + 1] - self.offs[docs]
        at = np.repeat(self.offs[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(wanted[self.terms[at]] * self.impact[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def best_of(vectors: DataFrame, q: Queries, k: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: the k best of every task for each query, from vectors sorted by falling length."""

    def run(batches):
        floor, best = least.copy(), [[] for _ in q.rows]
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                longest = part.column("length")[0].as_py()
                live = np.flatnonzero(q.norm * longest * (1 + 1e-9) + 1 >= floor)
                if not len(live):
                    continue
                bucket = Bucket(part, q)
                for i in live.tolist():
                    docs = bucket.survivors(q, q.rows[i], floor[i])
                    if not len(docs):
                        continue
                    score = bucket.scores(q, q.rows[i], docs)
                    good = np.flatnonzero(score >= floor[i])
                    if len(good):
                        best[i] += [(-s, (d is not None, d), d) for s, d in zip(score[good].tolist(), [bucket.ids[j] for j in docs[good].tolist()], strict=True)]
                        best[i] = sorted(best[i])[:k]
                        if len(best[i]) == k:
                            floor[i] = max(floor[i], -best[i][-1][0])
        rows = [(i, d, -s) for i, own in enumerate(best) for s, _, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for every item.

    Terms are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. Null texts have no term and
    find nothing; equal scores go by ascending ``doc_id`` (null first); every distinct (``item_id``, text) is an item,
    every row of ``docs`` a document. Empty tables give no rows.
    """
    spark, asked = docs.sparkSession, items.select("item_id", text_or_empty().alias("text")).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    blocks = -(-int(asked.agg(F.sum(F.length("text"))).first()[0] or 1) // QUERY_BYTES)
    numbered = asked.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = numbered.filter(F.col("_b") == block).orderBy("item_id", "text").collect()  # about QUERY_BYTES
        vocabulary = sorted({t for r in rows for t in terms_of(r.text) if t})
        counted = materialise(count_terms(docs, vocabulary))
        n, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n or not vocabulary:
            continue
        q = Queries([r.text for r in rows], vocabulary, n, total, document_frequencies(counted, len(vocabulary)))
        vectors = materialise(with_length(counted, q).filter("length > 0"))
        by_length = F.col("length").desc()
        first = best_of(vectors.orderBy(by_length, "doc_id").limit(SEEDS).coalesce(1).sortWithinPartitions(by_length), q, k, np.ones(len(rows), dtype=np.int64))
        seeds = first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect()  # one row per item
        least = np.ones(len(rows), dtype=np.int64)
        least[[r.item for r in seeds]] = [r.least for r in seeds]
        needed = float((least / np.maximum(q.norm, 1e-9)).min())  # shorter vectors reach no query's k-th score
        ordered = vectors.filter(F.col("length") * (1 + 1e-6) + 1 >= needed).repartitionByRange(by_length, F.xxhash64("doc_id")).sortWithinPartitions(by_length)
        top = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = best_of(ordered, q, k, least).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
