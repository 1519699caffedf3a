"""Best-fit packing of tokenised documents into training sequences (vector best fit).

A sequence has three capacities: tokens, pieces, and attention cost (the sum of squared piece lengths).
Pieces are placed from the longest to the shortest. Among all open sequences that hold the piece under
*every* constraint, the one that scores best wins: by the smallest weighted norm of what would remain, or
by the largest weighted dot product of the piece and what is free. If none holds it, a new one is opened.

Pieces are dealt evenly into groups by a hash of their row number, so a group has a bounded number of
pieces whatever the documents are, and a group loses at most about one half-filled sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty
from .tokens import encoder, with_end

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A null text counts as empty and gives the end id alone. A row is a document, also when an id is
    repeated or null. Only documents longer than ``max_tokens`` are cut; the last piece may be shorter.
    """

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(batch, "text", 6 << 20):
                part = batch.slice(a, b - a)
                flat, counts = with_end(*enc.encode(part.column("text")), end_id)
                n_pieces = -(-counts // max_tokens)
                row = np.repeat(np.arange(b - a), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = (np.cumsum(counts) - counts)[row]
                start = piece * max_tokens
                length = np.minimum(counts[row] - start, max_tokens)
                raw = flat.astype("<u4")
                begin = first + start
                crc = [zlib.crc32(raw[s:s + n]) for s, n in zip(begin.tolist(), length.tolist(), strict=True)]
                out = {"doc_id": part.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    bounds = np.append(begin, begin[-1] + length[-1] if len(begin) else 0)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(raw.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def place(lengths: np.ndarray, max_tokens: int, max_pieces: int, max_attention: float, rule: str, weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one group; ``lengths`` in descending order."""
    cap = np.array([max_tokens, max_pieces, max_attention], dtype=np.float64)
    scale = np.array(weights) / cap  # each residual counts as a share of its capacity
    shortest = int(lengths[-1]) if len(lengths) else 0
    n = len(lengths)
    free = np.zeros((3, max(16, n)))
    ids = np.zeros(max(16, n), dtype=np.int64)
    live, opened = 0, 0
    used = np.zeros(n + 1, dtype=np.int64)
    seq, off = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        at = -1
        if live:
            f = free[:, :live]
            ok = np.flatnonzero((f[0] >= need[0]) & (f[1] >= need[1]) & (f[2] >= need[2]))
            if len(ok):
                left = (f[:, ok] - need[:, None]) * scale[:, None]
                score = np.einsum("ij,ij->j", left, left) if rule == "norm" else -((need * scale / cap) @ f[:, ok])
                at = int(ok[np.argmin(score)])
        if at < 0:
            at = live
            free[:, at], ids[at] = cap, opened
            live, opened = live + 1, opened + 1
        seq[i], off[i] = ids[at], used[ids[at]]
        used[ids[at]] += size
        free[:, at] -= need
        if free[0, at] < shortest or free[1, at] < 1 or free[2, at] < float(shortest) ** 2:
            live -= 1  # full: the last open one takes its place
            free[:, at], ids[at] = free[:, live], ids[live]
    return seq, off


def best_fit(rows: DataFrame, length: str = "length", max_tokens: int = 2048, max_pieces: int = 2048, max_attention: float | None = None,
             rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), group_size: int = 16_384) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in a sequence) to rows that have a ``length``.

    Lengths must be between 1 and ``max_tokens``. ``max_attention`` defaults to ``max_tokens`` squared,
    which every sequence within its tokens keeps. Rows may repeat. An empty table gives an empty table.
    """
    limit = float(max_tokens) ** 2 if max_attention is None else float(max_attention)
    rows = materialise(rows)
    n = rows.filter(F.col(length) < max_tokens).count()
    groups = max(1, -(-n // group_size))
    number = F.monotonically_increasing_id()
    keyed = rows.withColumn("_row", number)
    whole = keyed.filter(F.col(length) == max_tokens)  # alone in a sequence
    part = keyed.filter(F.col(length) < max_tokens).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([length, "_row"], ascending=[False, True], kind="stable")
        seq, off = place(group[length].to_numpy(), max_tokens, max_pieces, limit, rule, weights)
        return pd.DataFrame({"_row": group["_row"].to_numpy(), "sequence_id": (np.int64(group["_group"].iloc[0]) << 32) + seq, "offset": off})

    placed = part.select("_row", "_group", length).groupBy("_group").applyInPandas(pack, "_row long, sequence_id long, offset long")
    alone = whole.withColumn("sequence_id", -F.col("_row") - 1).withColumn("offset", F.lit(0).cast("long"))
    return part.drop("_group").join(placed, "_row").unionByName(alone).drop("_row")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, **options) -> DataFrame:
    """Pieces of all documents with their place: the columns of ``pieces`` and ``sequence_id, offset``."""
    return best_fit(pieces(docs, tokenizer_path, max_tokens), max_tokens=max_tokens, **options)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, max_tokens: int = 2048) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, doc_ids, lengths`` in order of the offsets.

    ``doc_id`` must be unique here. A sequence has at most ``max_tokens`` pieces, so no group is unbounded.
    """
    ids = pieces(docs, tokenizer_path, max_tokens, with_ids=True).select("doc_id", "piece", "ids")
    rows = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
