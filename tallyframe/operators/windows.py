"""Per-key rankings and running computations.

A filter ``row_number() <= n`` with a small n is applied before the shuffle as well as after it,
so a hot key ships at most n rows per task. Sequences along time are cut into chunks per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..core.scale import HOT_ROWS, exact_quantiles, group_rank, hash_head, hash_order, hot_chunks, join_small, range_rank, running


def _group_limit(df: DataFrame) -> int:
    """Largest n for which ``row_number() <= n`` is applied before the shuffle as well."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def pick_one_per_key(df: DataFrame, key: str, view: str, priority: list[str], order: list[Column]) -> DataFrame:
    """One row per key by (rank of ``view`` in ``priority``, ``order``); other views are dropped."""
    place = F.array_position(F.array(*[F.lit(v) for v in priority]), F.col(view))
    w = Window.partitionBy(key).orderBy(place, *order)
    rows = df.filter(F.col(view).isin(priority)).withColumn("_rn", F.row_number().over(w))
    return rows.filter("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last row per key by ``order`` (end it with a unique column). Map-side combined."""
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *columns)).alias("_l"))
    return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in [*order, *columns]])


def first_n_per_group(df: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """First n rows per group; n of 0 or less keeps all of them. ``order`` is total. Null is a group like any other."""
    if n <= 0:
        return df
    if n > _group_limit(df):
        keyed = df.withColumn("_group", F.to_json(F.struct(group)))  # never null
        return group_rank(keyed, ["_group"], order).filter(F.col("rank") <= n).drop("rank", "_group")
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median and sample standard deviation (null for one row) per group."""
    med = exact_quantiles(df, [group], [value], [0.5]).select(group, F.col("value").alias("median"))
    sd = df.groupBy(group).agg(F.stddev_samp(value).alias("sd"))
    return med.join(sd, group)


def group_deviation(df: DataFrame, group: str, value: str, keep: list[str]) -> DataFrame:
    """|x - group median| / group sd and whether it exceeds its overall median.

    A group of one has no sd and counts as typical; a zero sd gives +inf, or nothing at distance 0.
    """
    base = df.filter(F.col(group).isNotNull())
    rows = join_small(base.select(*keep, group, value), group_stats(base, group, value), [group])
    gap = F.abs(F.col(value) - F.col("median"))
    dev = F.when(F.col("sd") > 0, gap / F.col("sd")).when((F.col("sd") == 0) & (gap > 0), F.lit(float("inf")))
    rows = rows.withColumn("deviation", dev)
    middle = exact_quantiles(rows, [], ["deviation"], [0.5]).select("value").scalar()
    return rows.withColumn("atypical", F.coalesce(F.col("deviation") > middle, F.lit(False))).drop("median", "sd")


def below_group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Add ``below``: whether the value is under the exact median of its group."""
    med = exact_quantiles(df, [group], [value], [0.5]).select(group, F.col("value").alias("_m"))
    return join_small(df, med, [group]).withColumn("below", F.col(value) < F.col("_m")).drop("_m")


def rank_deciles(df: DataFrame, order: list[Column], keep: list[str], buckets: int = 10) -> DataFrame:
    """Bucket of the first-come rank: max(1, ceil(buckets * (rank - 1) / (n - 1)))."""
    ranked = range_rank(df.select(*keep), order)
    # whole numbers throughout: ceil(a / b) = (a + b - 1) div b
    span = F.greatest(F.col("total") - 1, F.lit(1))
    bucket = F.expr("(({b} * (rank - 1)) + greatest(total - 1, 1) - 1) div greatest(total - 1, 1)".format(b=buckets))
    return ranked.withColumn("_span", span).withColumn("bucket", F.greatest(F.lit(1), bucket)).drop("_span", "rank", "total")


def pause_sessions(df: DataFrame, key: list[str], start: Column, stop: Column, gap_s: float = fixed.PAUSE_GAP_S,
                   chunk_s: int = 3_600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Active seconds, sessions and paused seconds per key from overlapping spans.

    ``start`` and ``stop`` are seconds. The gap of a span is measured from the latest end seen so
    far; that running maximum is taken per time chunk, so a key with many spans is split.
    """
    spans = df.select(*key, start.alias("start"), stop.alias("stop"))
    spans = running(spans, key, ["start", "stop"], F.floor(F.col("start") / chunk_s), {"_seen": ("max", F.col("stop"), False)}, hot_rows)
    gap = F.col("start") - F.col("_seen")
    pause = F.when(gap > gap_s, gap)
    out = spans.groupBy(*key).agg(
        F.min("start").alias("_first"), F.max("stop").alias("_last"), F.count(pause).alias("_n"),
        F.coalesce(F.sum(pause), F.lit(0.0)).alias("paused_s"), F.count(F.lit(1)).alias("n_spans"))
    return out.select(*key, "n_spans", (F.col("_last") - F.col("_first") - F.col("paused_s")).alias("active_s"),
                      (F.col("_n") + 1).alias("sessions"), "paused_s")


def failure_streaks(df: DataFrame, key: list[str], order: list[str], chunk: Column, blocked: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``position`` and ``streak``: length of the run of blocked attempts that ends at the row.

    The streak is the position minus the position of the last attempt that was not blocked. Rows are
    numbered inside time chunks of a key; sizes and last resets of the chunks before are carried in.
    """
    w = Window.partitionBy(*key, "_chunk").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hot_chunks(df, key, chunk, hot_rows).withColumn("_free", ~F.coalesce(blocked, F.lit(False)))
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_r", F.max(F.when(F.col("_free"), F.col("_i"))).over(upto))
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    cells = rows.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_last"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cells = cells.withColumn("_reset", F.max(F.col("_before") + F.col("_last")).over(earlier))
    rows = rows.join(cells.select(*key, "_chunk", "_before", "_reset"), [*key, "_chunk"])
    reset = F.coalesce(F.greatest(F.col("_before") + F.col("_r"), F.col("_reset")), F.lit(0))
    rows = rows.withColumn("position", F.col("_before") + F.col("_i"))
    return rows.withColumn("streak", F.col("position") - reset).drop("_chunk", "_free", "_i", "_r", "_before", "_reset")


def failure_streak_stop(df: DataFrame, key: list[str], order: list[str], chunk: Column, blocked: Column,
                        limit: int = fixed.STREAK_STOP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First row per key where the streak of blocked attempts reaches ``limit``."""
    rows = failure_streaks(df, key, order, chunk, blocked, hot_rows).filter(F.col("streak") == limit)
    return rows.groupBy(*key).agg(F.min("position").alias("stop_position"))


def attempt_sequence(df: DataFrame, key: list[str], order: list[str], success: Column, stop: Column, status: str) -> DataFrame:
    """Attempts really made per item: in order, up to and including the first that stops the item.

    The stopping attempt is a minimum per key (map-side combined), not a window over the item.
    """
    place = F.struct(*order)
    first = df.withColumn("_stop", stop).filter("_stop").groupBy(*key).agg(F.min(place).alias("_at"))
    made = df.join(first, key, "left").filter(F.col("_at").isNull() | (place <= F.col("_at")))
    last = made.withColumn("_ok", success).groupBy(*key).agg(
        F.count(F.lit(1)).alias("attempts"), F.max(F.struct(place.alias("p"), F.col(status).alias("s"), F.col("_ok").alias("ok"))).alias("_l"))
    return last.select(*key, "attempts", F.col("_l.s").alias("final_status"), F.col("_l.ok").alias("succeeded"))


def share_of_max(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Value relative to the largest of its group; ``counts`` is an aggregate, one row per key."""
    top = counts.groupBy(*group).agg(F.max(value).alias("_top"))
    return counts.join(top, group).withColumn("share", F.try_divide(F.col(value), F.col("_top"))).drop("_top")


def group_pages(df: DataFrame, group: str, order: str, per_page: int) -> DataFrame:
    """Page number of each row inside its group; a hot group spans many tasks."""
    page = F.floor((F.col("rank") - 1) / per_page) + 1
    return group_rank(df, [group], [order]).withColumn("page", page).drop("rank")


def history_tail(df: DataFrame, key: str, turn: str, role: str, limit: int = fixed.MAX_HISTORY, user: str = "user") -> DataFrame:
    """Last ``limit`` messages per conversation, leading non-user turns dropped; conversations
    whose last message is not from the user are rejected."""
    w = Window.partitionBy(key).orderBy(F.desc(turn))
    tail = df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= limit)
    per = Window.partitionBy(key)  # at most ``limit`` rows are left per key, already in one place
    tail = tail.withColumn("_from", F.min(F.when(F.col(role) == user, F.col(turn))).over(per))
    tail = tail.withColumn("_ends", F.max(F.when((F.col("_back") == 1) & (F.col(role) == user), 1)).over(per))
    return tail.filter((F.col("_ends") == 1) & (F.col(turn) >= F.col("_from"))).drop("_back", "_from", "_ends")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def hash_first(df: DataFrame, group: str | None, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in seeded hash order, per group or overall, numbered from 1."""
    key = hash_order(seed, id_col)
    if group is None:
        top = df.withColumn("_h", key).orderBy("_h", id_col).limit(n)
        w = Window.partitionBy(F.lit(1)).orderBy("_h", id_col)  # n rows
        return top.withColumn("k", F.row_number().over(w)).drop("_h")
    df = df.filter(F.col(group).isNotNull())
    if n > _group_limit(df):  # keep the head of every group first; it needs no shuffle of the rows
        df = hash_head(df, [group], id_col, seed, F.lit(n), "_in").filter("_in").drop("_in")
    w = Window.partitionBy(group).orderBy(key, id_col)
    return df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
