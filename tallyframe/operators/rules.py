"""Filters and threshold rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..core.scale import join_small
from ..functions.text import strip_suffix_code

# (name, value column, threshold, ">=" or "<=")
Test = tuple[str, Column | str, float | Column, str]


def allow_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Keep rows whose value is listed; ``isin`` reaches the scan."""
    return df.filter(F.col(column).isin(values))


def group_sizes(df: DataFrame, group: str, id_col: str, minimum: int) -> DataFrame:
    """Distinct ids per group with the kept flag."""
    return (
        df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(id_col).alias("n_ids"))
        .withColumn("kept", F.col("n_ids") >= minimum)
    )


def min_group_size(df: DataFrame, group: str, id_col: str, minimum: int) -> DataFrame:
    """Rows of groups with at least ``minimum`` distinct ids."""
    kept = group_sizes(df, group, id_col, minimum).filter("kept").select(group)
    return join_small(df, kept, [group], "left_semi")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def count_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: all rows, rows with every value, rows dropped, and nulls per column."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("n_complete"), F.count_if(~full).alias("n_dropped"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def _checks(tests: list[Test]) -> Column:
    rows = []
    for name, value, threshold, op in tests:
        value = (F.col(value) if isinstance(value, str) else value).cast("double")
        threshold = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double")
        passed = value >= threshold if op == ">=" else value <= threshold
        distance = F.when(threshold != 0, F.abs(value - threshold) / threshold).otherwise(
            F.when(value == threshold, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        rows.append(F.struct(
            F.lit(name).alias("test"), value.alias("value"), threshold.alias("threshold"), F.lit(op).alias("op"),
            F.coalesce(passed, F.lit(False)).alias("passed"), distance.alias("rel_distance")))
    return F.array(*rows)


def rule_check(df: DataFrame, tiers: list[tuple[str, Column, list[Test]]]) -> DataFrame:
    """Add tier, checks, accepted and failed. The first tier whose condition holds gives the tests."""
    tier, checks = None, None
    for name, cond, tests in tiers:
        cond = F.coalesce(cond, F.lit(False))
        if tier is None:
            tier, checks = F.when(cond, F.lit(name)), F.when(cond, _checks(tests))
        else:
            tier, checks = tier.when(cond, F.lit(name)), checks.when(cond, _checks(tests))
    out = df.withColumn("tier", tier).withColumn("checks", checks).filter(F.col("tier").isNotNull())
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["test"])
    return out.withColumn("failed", F.array_join(failed, ",")).withColumn("accepted", F.size(failed) == 0)


def rule_margins(checked: DataFrame, keys: list[str], margin: float = fixed.MARGIN, skip: list[str] | None = None) -> DataFrame:
    """Tests close to their threshold. Decisive: the outcome would flip, i.e. any such test of an
    accepted row, or the only failure of a rejected one."""
    near = F.filter("checks", lambda c: (c["rel_distance"] <= margin) & ~c["test"].isin(skip or [""]))
    rows = checked.select(*keys, "tier", "accepted", "failed", F.explode(near).alias("c"))
    return rows.select(*keys, "tier", "accepted", "c.test", "c.value", "c.threshold", "c.op", "c.rel_distance",
                       (F.col("accepted") | (F.col("failed") == F.col("c.test"))).alias("decisive"))


def facet_search(df: DataFrame, facet: str, value: str, needle: str, columns: list[str]) -> DataFrame:
    """Facet equality (``all`` for any) and a case-insensitive substring in any of the columns."""
    out = df if value == "all" else df.filter(F.col(facet) == value)
    needle = needle.strip().lower()
    if not needle:
        return out
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return out.filter(hit)


def suffix_record_check(df: DataFrame, raw: str, record: str) -> DataFrame:
    """Per code without its suffix: is it held in several suffixed records or in one with several items?"""
    per = df.withColumn("code", strip_suffix_code(raw)).groupBy("code").agg(
        F.countDistinct(record).alias("n_records"), F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col(raw) != F.col("code")).alias("n_suffixed"))
    verdict = (F.when((F.col("n_records") > 1) & (F.col("n_suffixed") > 0), "one record per view")
               .when(F.col("n_records") == 1, "one record with all items").otherwise("inconclusive"))
    return per.withColumn("verdict", verdict)
