"""Sinks and incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written by a query."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_log(df: DataFrame, path: str) -> None:
    """Append attempt or provenance rows; the committer publishes all of them or none."""
    df.write.mode("append").parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Write in key order: range-partitioned files, each sorted, published at once on commit."""
    order = [F.col(k) for k in keys]
    placed = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_parts(df: DataFrame, path: str, key: str) -> None:
    """One folder per value of a bounded key; rows of a hot value are spread over several files."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def resume_incremental(inputs: DataFrame, done: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(still to process, finished rows that are still wanted)."""
    pending = inputs.join(done.select(*key), key, "left_anti")
    carried = done.join(inputs.select(*key), key, "left_semi")
    return pending, carried


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: row count and sum of the leading 60 bits of each row's md5.

    The key columns are part of the row, so equal sets of keyed rows and only those agree
    (up to hash collisions). One partial aggregation, one row per task is shuffled.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    digit: Column = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(digit.alias("_d")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_d").cast("string").alias("fingerprint"))
