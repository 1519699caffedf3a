"""At most ``limit`` accepted rows per key and window; rejected rows are not counted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..core.scale import join_small


def accept(times: np.ndarray, recent: deque, limit: int, window_us: int) -> np.ndarray:
    """Accepted flags of sorted times, given and updating the accepted times still in the window.

    ``recent`` holds the last accepted times, ``limit`` at most. A row is accepted if the ``limit``-th accepted time
    before it is more than ``window_us`` older. Otherwise every row up to that moment is rejected and skipped at once, so
    the loop takes one turn per accepted row, not one per row.
    """
    taken = list(recent)
    known = len(taken)
    at = []  # the accepted rows
    i = 0 if limit > 0 else len(times)
    while i < len(times):
        nth = len(taken) - limit
        if nth >= 0 and times[i] <= taken[nth] + window_us:
            i = int(np.searchsorted(times, taken[nth] + window_us, side="right"))
            continue
        at.append(i)
        taken.append(int(times[i]))
        i += 1
    if len(taken) > known:
        recent.clear()
        recent.extend(taken[-limit:])
    ok = np.zeros(len(times), dtype=bool)
    ok[at] = True
    return ok


def rate_limit_flags(df: DataFrame, key: str, at_us: str, id_col: str, limit: int = fixed.RATE_LIMIT, window_s: int = fixed.RATE_WINDOW_S) -> DataFrame:
    """Add ``accepted`` to rows with a time in microseconds.

    Counts per (key, window-long bucket) come first: if a bucket and the one before it hold at most
    ``limit`` rows together, all its rows are accepted without looking at any of them. Only runs of
    busy buckets are folded in order, each run on its own, starting from the (accepted) rows of the
    quiet bucket before it. A run is read as a stream of Arrow batches and never held as a whole.
    Inside a run each acceptance depends on the ones before it, so a run is one sequential pass.
    """
    window_us = window_s * 1_000_000
    rows = df.select(key, id_col, F.col(at_us).alias("_t")).withColumn("_b", F.floor(F.col("_t") / window_us))
    rows = rows.withColumn("_k", F.to_json(F.struct(key)))  # never null: rows without a key are limited together
    per = Window.partitionBy("_k").orderBy("_b")  # one row per bucket of a key
    b = rows.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.when(F.lag("_b").over(per) == F.col("_b") - 1, F.lag("_n").over(per)).otherwise(0)
    b = b.withColumn("_busy", F.col("_n") + before > limit)
    follows = (F.lag("_b").over(per) == F.col("_b") - 1) & F.lag("_busy").over(per)
    b = b.withColumn("_start", (F.col("_busy") & ~F.coalesce(follows, F.lit(False))).cast("int"))
    b = b.withColumn("_run", F.sum("_start").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    # a quiet bucket right before a busy one is the history of that run
    leads = (F.lead("_b").over(per) == F.col("_b") + 1) & (F.lead("_start").over(per) == 1)
    b = b.withColumn("_leads", F.coalesce(~F.col("_busy") & leads, F.lit(False)))
    b = b.filter("_busy or _leads").select("_k", "_b", "_busy", F.when(F.col("_leads"), F.col("_run") + 1).otherwise(F.col("_run")).alias("_run"))
    rows = join_small(rows, b, ["_k", "_b"], "left")
    quiet = rows.filter(~F.coalesce(F.col("_busy"), F.lit(False))).select(key, id_col, F.lit(True).alias("accepted"))
    kinds = dict(df.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: deque = deque()
        for batch in batches:
            t = batch.column("_t").to_numpy(zero_copy_only=False).astype(np.int64)
            ok = accept(t, recent, limit, window_us)
            busy = batch.column("_busy").to_numpy(zero_copy_only=False).astype(bool)
            out = pa.RecordBatch.from_arrays([batch.column(key), batch.column(id_col), pa.array(ok)], names=[key, id_col, "accepted"])
            yield out.filter(pa.array(busy))

    ordered = (
        rows.filter("_run is not null").select(key, "_run", "_t", id_col, "_busy")
        .repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", id_col)
    )
    folded = ordered.groupBy(key, "_run").applyInArrow(fold, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, accepted boolean")
    return quiet.unionByName(folded)


def rate_limit_stream(stream: DataFrame, key: str, at_us: str, id_col: str, limit: int = fixed.RATE_LIMIT, window_s: int = fixed.RATE_WINDOW_S) -> DataFrame:
    """The same fold on a stream: the state of a key is its accepted times still in the window.

    Rows of a key must arrive in time order across micro-batches; inside one they are sorted here.
    """
    window_us = window_s * 1_000_000

    def step(group: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values(["_t", id_col])
        pdf["accepted"] = accept(pdf["_t"].to_numpy(np.int64), recent, limit, window_us)
        state.update((list(recent),))
        yield pdf[[key, id_col, "accepted"]]

    kinds = dict(stream.dtypes)
    rows = stream.select(key, id_col, F.col(at_us).alias("_t"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, accepted boolean", "times array<bigint>", "append", "NoTimeout")
