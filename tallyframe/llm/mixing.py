"""Mixing sources to target weights by subset sums.

Targets come from weights, limited to a multiple of each source's size. A source first takes whole copies of all its
documents; what remains of its budget is spent on documents counted by exact token length: an even share of every
length, then a bounded-knapsack dynamic programme over the lengths that still have documents. Documents are drawn by a
seeded hash within (source, length).

The rows are read once into a narrow table. The programme sees counts by length only (at most as many as the longest
text has words); sources are never collected, so there can be millions of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.scale import join_small, range_rank
from .common import materialise

WINDOW = 1 << 16  # words that are left to the dynamic programme, at least
PIECE = 10_000  # documents of a length that are ranked together, about


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be reached.

    An even share of each length is taken outright, then one more of each from the longest down until about
    ``WINDOW`` words are left; the rest is fitted exactly over what the lengths still hold, and then over up to
    ``repeats`` further copies of all documents, where no sum of single ones meets the budget.
    """
    total = int((lengths * counts).sum())
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    taken = np.minimum(taken, counts)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left - lengths[i] < WINDOW:
            continue
        if taken[i] < counts[i]:
            taken[i] += 1
            left -= int(lengths[i])
    top = left + int(lengths.max(initial=0))
    via = np.full(top + 1, -1, dtype=np.int64)  # the length by which a sum was first reached
    via[0] = len(lengths)
    reached = np.zeros(1, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    for i, spare in [*((i, counts[i] - taken[i]) for i in order), *((i, repeats * counts[i]) for i in order)]:
        if via[left] >= 0:
            break
        new, found = reached, []
        while spare and len(new) and via[left] < 0:
            new = new + lengths[i]
            new = new[new <= top]
            new = new[via[new] < 0]
            via[new] = i
            found.append(new)
            spare -= 1
        reached = np.concatenate([reached, *found])
    near = np.abs(reached - left)
    at = int(reached[near == near.min()].min())
    while at:
        taken[via[at]] += 1
        at -= int(lengths[via[at]])
    return taken


def targets(sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """Add ``target`` to one row per source with ``size`` and ``weight``: all sizes shared by weight, none above ``limit`` times its size.

    What a source cannot take is shared anew by weight among the others; every round is one aggregate of one row.
    """
    cap = F.col("size") * limit
    total = sources.agg(F.sum("size")).first()[0] or 0
    rate, full = None, -1
    while True:
        above = F.lit(False) if rate is None else cap < F.col("weight") * F.lit(rate)
        row = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if row[0] == full or not row[2]:
            return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(rate or 0.0)).cast("double"))
        full, rate = row[0], (total - (row[1] or 0.0)) / row[2]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 13) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` is the number of words of the text (null: 0); sources in code-point order, null last, weigh ``weights`` in
    turn. ``copies`` (0 to ``limit``) is how often the mix takes a document, ``taken`` its words. Documents without words
    and sources of size 0 have target and words 0. Repeated rows are documents of their own; the choice depends on
    id, text, seed and counts, not on partitioning. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    rows = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h")))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    counts = materialise(rows.groupBy("_s", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = counts.groupBy("_s").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    placed = range_rank(sources, [F.col("_s") == "", F.col("_s")])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    shifted = placed.withColumn("rank", F.col("rank") - 1).select("_s", "size", weight.alias("weight"))
    aimed = targets(materialise(shifted), limit).select("_s", F.col("size").alias("source_size"), "target")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        words, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        aim = int(np.floor(target + 0.5))
        base = min(limit, aim // words) if words else 0
        more = np.zeros(len(part), dtype=np.int64)
        real = part["size"].to_numpy() > 0
        if base < limit and words:
            more[real] = fit_lengths(part["size"].to_numpy()[real], part["n"].to_numpy()[real], aim - base * words, limit - base - 1)
        return part[["_s", "size", "n", "source_size", "target"]].assign(base=base, more=more)

    plan = join_small(counts, aimed, ["_s"]).groupBy("_s").applyInPandas(fit, "_s string, size long, n long, source_size long, target double, base long, more long")
    planned = join_small(rows, plan, ["_s", "size"])
    # pieces that keep the hash order, so no window holds more than about PIECE rows
    pieces = F.ceil(F.col("n") / PIECE)
    planned = planned.withColumn("_p", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * pieces))
    keys = ["_s", "size", "_p"]
    before = Window.partitionBy("_s", "size").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))
    drawn = join_small(planned.withColumn("_i", at), held, keys)
    whole = F.floor(F.col("more") / F.col("n"))  # 0, but where single documents cannot meet the budget
    copies = F.col("base") + whole + F.when(F.col("_before") + F.col("_i") <= F.col("more") - whole * F.col("n"), 1).otherwise(0)
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
