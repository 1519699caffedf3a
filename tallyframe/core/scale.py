"""Building blocks that keep exact results exact when one key holds a large share of all rows.

* ``hash_rank``       exact rank by seeded hash inside groups, without a window over a whole group
* ``range_rank``      exact global rank by any order, without a single-task window
* ``running``         running sums and maxima per key, split into time chunks
* ``exact_quantiles`` interpolated quantiles per group by radix selection; only counts are shuffled, never a whole group
* ``join_small``      broadcast only after the small side was counted
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import materialise

BROADCAST_ROWS = 200_000  # above this many rows the plain shuffle join is used


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where ``small`` is an aggregate expected to be small: written once, counted, then
    broadcast if it is within bounds and left to an ordinary shuffle join if it is not."""
    small = materialise(small)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def hash_order(seed: int, *cols: Column | str) -> Column:
    """Reproducible pseudo-random sort key: md5 of ``seed|id``, the same whatever the partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_rank(
    df: DataFrame, groups: Sequence[str], id_col: str, seed: int, prefix: int = 3, hash_on: Sequence[str] | None = None
) -> DataFrame:
    """Add ``rank`` (1-based, by seeded hash inside ``groups``) and ``group_size``.

    The hash covers ``id_col``, or ``hash_on`` where other columns take part in it.

    The first hex digits of the hash cut every group into even pieces, so the window sorts a piece
    and never a group; the offset of a piece comes from a count per (group, piece).
    """
    groups = list(groups)
    for g in groups:
        df = df.filter(F.col(g).isNotNull())
    keyed = df.withColumn("_h", hash_order(seed, *(hash_on or [id_col]))).withColumn("_piece", F.substring("_h", 1, prefix))
    keys = groups + ["_piece"]
    pieces = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = by_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("group_size"),
    )
    inside = Window.partitionBy(*keys).orderBy("_h", id_col)
    return (
        keyed.withColumn("_i", F.row_number().over(inside))
        .join(pieces, keys)
        .withColumn("rank", F.col("_before") + F.col("_i"))
        .drop("_h", "_piece", "_i", "_before")
    )


def range_rank(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based, global) and ``total`` for a total order.

    Rows are range-partitioned and sorted in place; the rank is the position inside the partition
    plus the number of rows in earlier partitions. One shuffle, no single-task window.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    placed = materialise(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(F.lit(1))  # at most one row per partition
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
    )
    local = F.col("_pos") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.join(F.broadcast(offsets), "_part")  # bounded by the partition count
        .withColumn("rank", F.col("_before") + local + 1)
        .drop("_pos", "_part", "_before")
    )


def group_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based, inside ``groups``) for a total order, for groups of any size.

    One range partitioning by (groups, order): the rank in a group is the global rank minus the rank
    at which the group starts, so a hot group spans many tasks.
    """
    groups = list(groups)
    keys = [*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]]
    ranked = range_rank(df.dropna(subset=groups), keys, partitions)
    starts = ranked.groupBy(*groups).agg(F.min("rank").alias("_first"))
    return join_small(ranked, starts, groups).withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("total", "_first")


def hash_head(df: DataFrame, groups: Sequence[str], id_col: str, seed: int, take: Column, name: str,
              unique_ids: bool = True, prefix: int = 3) -> DataFrame:
    """Add the flag ``name``: whether the row's id is among the first ``take`` of its group in hash order.

    ``take`` may use ``group_size`` (ids per group). The hash prefix cuts a group into even pieces;
    counts per piece say which pieces lie wholly inside or outside the head. Only the one piece that
    the boundary runs through is ranked, so the rows are neither sorted nor shuffled as a whole.
    """
    groups = list(groups)
    keyed = df.dropna(subset=groups).withColumn("_h", hash_order(seed, id_col)).withColumn("_piece", F.substring("_h", 1, prefix))
    keys = groups + ["_piece"]
    count = F.count(F.lit(1)) if unique_ids else F.countDistinct(id_col)
    per = Window.partitionBy(*groups)
    pieces = keyed.groupBy(*keys).agg(count.alias("_n")).withColumn("group_size", F.sum("_n").over(per))
    upto = F.sum("_n").over(per.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("_upto", upto).withColumn("_take", take)
    pieces = materialise(pieces.select(
        *keys, (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_left"),
        F.when(F.col("_upto") <= F.col("_take"), True).when(F.col("_upto") - F.col("_n") >= F.col("_take"), False).alias(name)))
    if pieces.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    rows = keyed.join(pieces, keys)
    sure = rows.filter(F.col(name).isNotNull())
    inside = Window.partitionBy(*keys).orderBy("_h", id_col)
    edge = rows.filter(F.col(name).isNull()).withColumn(name, F.dense_rank().over(inside) <= F.col("_left"))
    return sure.unionByName(edge).drop("_h", "_piece", "_left")


HOT_ROWS = 1_000_000  # a key with more rows than this is cut into chunks


def hot_chunks(df: DataFrame, keys: Sequence[str], chunk: Column, hot_rows: int) -> DataFrame:
    """Add ``_chunk``: ``chunk`` for keys with more than ``hot_rows`` rows, 0 for all others.

    Rows without a key are left out. There are at most (rows / hot_rows) hot keys.
    """
    df = df.dropna(subset=list(keys))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    df = join_small(df, hot.select(*keys, F.lit(True).alias("_hot")), list(keys), "left")
    return df.withColumn("_chunk", F.when(F.col("_hot"), chunk.cast("long")).otherwise(F.lit(0).cast("long"))).drop("_hot")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    specs: dict[str, tuple[str, Column, bool]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running aggregates per key that split a hot key by ``chunk``, a number monotone in the order.

    ``specs``: name -> (``sum`` | ``max``, expression, include the current row). Each chunk is
    scanned on its own and the result of the chunks before it is carried in.
    """
    keys = list(keys)
    df = hot_chunks(df, keys, chunk, hot_rows)
    fold = {"sum": F.sum, "max": F.max}
    for name, (_, expr, _) in specs.items():
        df = df.withColumn(f"_x_{name}", expr)
    cells = df.groupBy(*keys, "_chunk").agg(
        *[fold[kind](f"_x_{name}").alias(f"_c_{name}") for name, (kind, _, _) in specs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(
        *keys,
        "_chunk",
        *[fold[kind](f"_c_{name}").over(earlier).alias(f"_p_{name}") for name, (kind, _, _) in specs.items()],
    )
    out = df
    base = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    for name, (kind, _, inclusive) in specs.items():
        w = base.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(f"_l_{name}", fold[kind](f"_x_{name}").over(w))
    out = out.join(carry, keys + ["_chunk"])
    for name, (kind, _, _) in specs.items():
        local, prior = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:
            value = F.greatest(local, prior)
        out = out.withColumn(name, value)
    extra = [f"_{p}_{name}" for name in specs for p in ("x", "l", "p")]
    return out.drop("_chunk", *extra)


QUANTILE_ROWS = 1_000_000  # values that one task may put in order; more are narrowed by radix first


def ordered_bits(value: Column) -> Column:
    """A double as a 64-bit integer of the same order: the bits of its size, negated for negative numbers.

    Dividing by a power of two and scaling the rest are exact, so equal keys mean equal numbers (zeros are one).
    """
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    over = size / F.pow(F.lit(2.0), guess)  # the logarithm may be one off next to a power of two
    power = guess + F.when(over >= 2, 1.0).when((over < 1) & (guess > -1022), -1.0).otherwise(0.0)
    unit = F.lit(1 << 52).cast("long")
    bits = (power + 1022).cast("long") * unit + (size / F.pow(F.lit(2.0), power) * float(1 << 52)).cast("long")
    bits = F.when(value == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047).cast("long") * unit).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], values: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact, linearly interpolated quantiles: columns ``groups``, ``name``, ``prob``, ``value``, ``n``.

    Radix selection. The values are written once as a narrow table with an order-preserving integer each. A round counts
    rows by the integer's next 16 bits inside the cells that hold a wanted rank (all of a group at first), so what is
    shuffled are at most 65,536 counts per cell and task, whatever the range of the values and the size of a group. When no
    cell holds more than ``QUANTILE_ROWS`` rows, and in the fourth round at the latest, the counts are by value.
    Null keys, null values and NaN are left out; every group with at least one value gets a row per probability.
    """
    groups, probs = list(groups), list(probs)
    keys = groups + ["name"]
    melted = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.dropna(subset=groups) if groups else df
    long = long.select(*groups, melted.alias("_m")).select(*groups, "_m.name", F.col("_m.v").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    long = materialise(long.withColumn("_b", ordered_bits(F.col("v"))))

    def cell(bits: int) -> Column:
        return F.shiftright("_b", bits)

    def counted(rows: DataFrame, bits: int, *within: str) -> DataFrame:
        """Counts per cell of ``bits`` bits, and the rows of the cells up to each one."""
        per = Window.partitionBy(*keys, *within)
        cells = rows.groupBy(*keys, *within, cell(bits).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.max("v").alias("v"))
        return cells.withColumn("_end", F.sum("_n").over(per.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_n").over(per))

    bits = 48 if long.count() > QUANTILE_ROWS else 0
    cells = counted(long, bits)
    wanted = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("n") - 1)
        for rank, low in ((F.floor(at), True), (F.ceil(at), False)):
            wanted.append(F.struct(F.lit(float(p)).alias("prob"), F.lit(low).alias("low"), rank.alias("rank"), (at - F.floor(at)).alias("frac")))
    inside = lambda s: (s["rank"] >= F.col("_end") - F.col("_n")) & (s["rank"] < F.col("_end"))
    at_hand = [*keys, "_k", "_n", "v", "n"]
    picked = cells.select(*at_hand, (F.col("_end") - F.col("_n")).alias("_start"), F.explode(F.filter(F.array(*wanted), inside)).alias("_w"))
    picked = picked.select(*at_hand, "_w.prob", "_w.low", "_w.frac", (F.col("_w.rank") - F.col("_start")).alias("_at"))
    while bits:
        picked = materialise(picked)
        most, rows = picked.agg(F.max("_n"), F.count(F.lit(1))).first()
        hint = F.broadcast if rows <= BROADCAST_ROWS else (lambda d: d)
        old = picked.select(*keys, "prob", "low", "frac", "n", "_at", F.col("_k").alias("_in"))
        hit = long.withColumn("_in", cell(bits)).join(hint(old.select(*keys, "_in").distinct()), [*keys, "_in"], "left_semi")
        bits = bits - 16 if most > QUANTILE_ROWS else 0
        inner = counted(hit, bits, "_in").drop("n").join(hint(old), [*keys, "_in"])
        inner = inner.filter((F.col("_at") >= F.col("_end") - F.col("_n")) & (F.col("_at") < F.col("_end")))
        picked = inner.withColumn("_at", F.col("_at") - F.col("_end") + F.col("_n")).select(*at_hand, "prob", "low", "frac", "_at")
    lo, hi = F.max(F.when(F.col("low"), F.col("v"))), F.max(F.when(~F.col("low"), F.col("v")))
    return (
        picked.groupBy(*keys, "prob")
        .agg(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max("frac")).alias("value"), F.max("n").alias("n"))
        .select(*keys, "prob", "value", "n")
    )


def group_medians_wide(df: DataFrame, groups: Sequence[str], values: Sequence[str], suffix: str = "_median") -> DataFrame:
    """One row per group with ``<value>_median`` columns (null where a group has no value)."""
    groups = list(groups)
    q = exact_quantiles(df, groups, values, [0.5])
    return q.groupBy(*groups).agg(
        *[F.max(F.when(F.col("name") == v, F.col("value"))).alias(v + suffix) for v in values]
    )
