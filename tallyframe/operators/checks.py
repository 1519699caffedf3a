"""Data checks: each gives (check, violations, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.scale import running


def row_checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Any number of per-row conditions in one pass; a row violates a test unless it is true."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(tests.values())])
    rows = [F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(tests)]
    return one.select(F.inline(F.array(*rows)))


def _named(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def unique_key(name: str, df: DataFrame, key: list[str]) -> DataFrame:
    return _named(name, df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))


def equal_key_sets(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    tagged = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s")))
    return _named(name, tagged.groupBy(key).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).filter("_lo = _hi"))


def disjoint_splits(name: str, df: DataFrame, id_col: str, split: str) -> DataFrame:
    per = df.groupBy(id_col).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    return _named(name, per.filter("_lo <> _hi"))


def class_in_split(name: str, df: DataFrame, cls: str, split: str, value: str) -> DataFrame:
    per = df.groupBy(cls).agg(F.max((F.col(split) == value).cast("int")).alias("_has"))
    return _named(name, per.filter("_has = 0"))


def paths_exist(name: str, df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Paths that are not among the listed files (a table with the column ``path``)."""
    return _named(name, df.select(F.col(path).alias("path")).join(files.select("path"), "path", "left_anti"))


def all_finite(column: str) -> Column:
    """Whether every element of an array column is a finite number."""
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def check_suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("violations") == 0)


def progress_rate(df: DataFrame, key: list[str], order: list[str], at: Column, chunk: Column, total: Column) -> DataFrame:
    """Rows done, elapsed seconds, seconds per row and estimated seconds left at every progress row.

    ``at`` is seconds, ``total`` the number of rows to do. The running count is cut into chunks of
    a key; the start is a minimum per key.
    """
    rows = df.withColumn("_at", at).withColumn("_total", total)
    start = rows.groupBy(*key).agg(F.min("_at").alias("_start"))
    # rows done and the time of the row before, which is the largest time seen so far
    rows = running(rows, key, order, chunk, {"done": ("sum", F.lit(1), True), "_before": ("max", F.col("_at"), False)})
    rows = rows.join(start, key)
    elapsed = F.col("_at") - F.col("_start")
    return rows.select(*key, *order, "done", elapsed.alias("elapsed_s"), (F.col("_at") - F.col("_before")).alias("step_s"),
                       (elapsed / F.col("done")).alias("s_per_row"), ((F.col("_total") - F.col("done")) * elapsed / F.col("done")).alias("eta_s"))
