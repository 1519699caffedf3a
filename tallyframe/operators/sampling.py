"""Sorting, limits, set operations, splits and samples.

Random order is ``md5(seed|id)``: reproducible, independent of the partitioning, the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.scale import hash_head, hash_order, hash_rank, join_small
from ..core.session import materialise
from .windows import hash_first


def qa_worst(df: DataFrame, flagged: Column, residues: list[str], pieces: str, id_cols: list[str], n: int) -> DataFrame:
    """Highest quality-problem scores: 10 for any flag, plus residues, plus min(pieces, 10) / 50."""
    score = F.when(flagged, 10.0).otherwise(0.0)
    for r in residues:
        score = score + F.col(r)
    score = F.bround(score + F.least(F.col(pieces), F.lit(10)) / 50, 4)
    return df.withColumn("qa_score", score).orderBy(F.desc("qa_score"), *id_cols).limit(n)


def bottom_k(df: DataFrame, value: str, ties: list[str], k: int) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).orderBy(value, *ties).limit(k)


def ordered_export(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order (range-partitioned sort)."""
    return df.orderBy(*keys)


def top_n_fold_other(df: DataFrame, value: str, n: int, other: str = "other") -> DataFrame:
    """Add ``category``: the n most frequent values keep their name, the rest become ``other``."""
    top = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), value).limit(n)
    top = top.select(value, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), value, "left").withColumn(  # n rows
        "category", F.when(F.col("_top"), F.col(value)).otherwise(F.lit(other))).drop("_top")


def union_versions(tables: dict[str, DataFrame], column: str = "version") -> DataFrame:
    """Stack tables by name with a column naming the version; missing columns are null."""
    out = None
    for name, frame in tables.items():
        frame = frame.withColumn(column, F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def key_set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only. Both sides are tagged and grouped once."""
    both = left.select(key).withColumn("_l", F.lit(1)).unionByName(right.select(key).withColumn("_l", F.lit(0)))
    sides = both.groupBy(key).agg(F.max("_l").alias("_in_left"), F.min("_l").alias("_not_in_right"))
    return sides.filter(F.col("_in_left") == F.col("_not_in_right")).select(
        key, F.when(F.col("_in_left") == 1, "left only").otherwise("right only").alias("side"))


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def table_diff(left: DataFrame, right: DataFrame, key: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Changed cells of two runs in long form; a row missing on one side is one entry of its own.

    Numbers within ``tolerance`` count as equal; nulls are equal to nulls.
    """
    kinds = dict(left.dtypes)
    a = left.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    b = right.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    present = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    cells = []
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        numeric = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")
        delta = F.abs(x.cast("double") - y.cast("double")) if numeric else F.lit(None).cast("double")
        same = x.eqNullSafe(y)
        if numeric:
            same = same | F.coalesce(delta <= tolerance, F.lit(False))
        cells.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"),
                              delta.alias("delta"), (present & ~same).alias("bad")))
    gone = F.struct(F.lit("(row)").alias("column"), F.when(F.col("_in_a"), "present").alias("left"),
                    F.when(F.col("_in_b"), "present").alias("right"), F.lit(None).cast("double").alias("delta"), (~present).alias("bad"))
    flat = both.select(*key, F.explode(F.filter(F.array(*cells, gone), lambda s: s["bad"])).alias("d"))
    return flat.select(*key, "d.column", "d.left", "d.right", "d.delta")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Changed cells and largest numeric change per column."""
    return diff.groupBy("column").agg(F.count(F.lit(1)).alias("n_changed"), F.max("delta").alias("max_delta"))


def stratified_split(df: DataFrame, cls: str, id_col: str, fraction: float, seed: int, unique_ids: bool = True) -> DataFrame:
    """Add ``split``. Per class the first max(1, round(n * fraction)) ids in hash order are test.

    Two scans and a count per (class, hash piece); no row is shuffled except those of the one piece
    per class that the boundary runs through. Set ``unique_ids`` to False where rows share ids:
    the ids are then counted once and all rows of an id get its split.
    """
    n_test = F.greatest(F.lit(1), F.bround(F.col("group_size") * F.lit(fraction), 0).cast("long"))
    marked = hash_head(df, [cls], id_col, seed, n_test, "_test", unique_ids)
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def stratified_folds(df: DataFrame, cls: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Add ``fold`` in 0..k-1, balanced inside every class."""
    ranked = hash_rank(df, [cls], id_col, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_size")


def capped_sample(df: DataFrame, group: str, id_col: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows per group in hash order, with a flag on groups that were cut."""
    sizes = df.groupBy(group).agg((F.count(F.lit(1)) > cap).alias("capped"))
    return join_small(hash_first(df, group, id_col, cap, seed).drop("k"), sizes, [group])


def hash_sample_n(df: DataFrame, id_col: str, n: int, seed: int, group: str | None = None) -> DataFrame:
    return hash_first(df, group, id_col, n, seed)


def quota_sample(df: DataFrame, cls: str, id_col: str, quotas: list[tuple[Column, int, str]], total: int, seed: int) -> DataFrame:
    """Required quotas from distinct classes, then one row per remaining class, then extras.

    Each stage works on one candidate per class (the first in hash order), so what is ranked
    across classes is at most one row per class; extras are the first rows left in hash order.
    """
    base = df.filter(F.col(cls).isNotNull()).withColumn("_h", hash_order(seed, id_col))
    best = F.min(F.struct("_h", id_col))
    used, parts = None, []

    def pool_of(cond: Column) -> DataFrame:
        pool = base.filter(cond)
        return pool.join(used.select(cls), cls, "left_anti") if used is not None else pool

    for cond, n, why in quotas:
        chosen = pool_of(cond).groupBy(cls).agg(best.alias("_b")).orderBy("_b").limit(n)
        chosen = materialise(chosen.select(cls, F.col(f"_b.{id_col}").alias(id_col), F.lit(why).alias("why")))  # n rows
        parts.append(chosen)
        used = chosen if used is None else used.unionByName(chosen)
    rest = pool_of(F.lit(True)).groupBy(cls).agg(best.alias("_b"))
    parts.append(rest.select(cls, F.col(f"_b.{id_col}").alias(id_col), F.lit("one per class").alias("why")))
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    picked = materialise(picked)  # at most one row per class
    # the number of extras depends on how many were picked: number the candidates and compare
    left = base.join(picked.select(id_col), id_col, "left_anti").orderBy("_h", id_col).limit(total)
    left = left.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_h", id_col)))  # at most total rows
    have = picked.agg(F.count(F.lit(1)))
    extras = left.filter(F.col("_k") <= F.lit(total) - have.scalar()).select(cls, id_col, F.lit("extra").alias("why"))
    return picked.unionByName(extras)


def ratings_carry_over(template: DataFrame, earlier: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New template rows with the earlier ratings where the key was rated before, '' elsewhere."""
    return template.join(earlier.select(key, *columns), key, "left").na.fill("", columns)
