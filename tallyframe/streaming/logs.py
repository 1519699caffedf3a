"""Append logs as streams: latest state, windowed counts and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key
from ..sources.sinks import scratch_path


def read_log(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet log files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def _drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, into a table in the shared folder, and read it back."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-out")
    _drain(stream, path, scratch_path(spark, "stream-state"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def drain_to_end(log: DataFrame, at: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``build(log)`` over everything available, then emit the windows and sessions that are still open.

    A second run from the same checkpoint reads one marker row in the year 9999, so that the watermark passes the end of
    all the others; the marker's own window stays open and is never emitted. This ends the log: what arrives later is late.
    """
    spark = log.sparkSession
    path, state, markers = (scratch_path(spark, f"stream-{name}") for name in ("out", "state", "end"))
    kinds = {f.name: f.dataType for f in log.schema.fields}
    marker = spark.range(1).select(*[F.lit("9999-01-01 00:00:00" if c == at else None).cast(k).alias(c) for c, k in kinds.items()])
    marker.limit(0).write.parquet(markers)
    stream = build(log.unionByName(spark.readStream.schema(log.schema).parquet(markers)))
    _drain(stream, path, state)
    marker.write.mode("append").parquet(markers)
    _drain(stream, path, state)
    return spark.read.schema(stream.schema).parquet(path)


def latest_state_stream(stream: DataFrame, key: list[str], order: list[str], columns: list[str], path: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep the last row per key in ``path``, in buckets by a hash of the key.

    A micro-batch rewrites only the buckets that it has keys of. A bucket has two slots: the newest state of earlier
    batches is read from one and the new state overwrites the other, so at most two versions of a bucket exist, and
    a batch that is replayed after a failure reads the same rows and writes the same state again.
    """
    spark = stream.sparkSession
    schema = latest_per_key(stream.select(*key, *order, *columns), key, order, columns).schema
    stored = schema.add("_batch", "long").add("_bucket", "integer").add("_slot", "integer")

    def merge(batch: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        rows = latest_per_key(batch.select(*key, *order, *columns), key, order, columns).withColumn("_bucket", bucket)
        if n == 0:
            rows = rows.withColumn("_slot", F.lit(0))
        else:
            before = _newest(spark.read.schema(stored).parquet(path).filter(F.col("_batch") < n))
            touched = rows.select("_bucket").distinct()
            before = before.join(F.broadcast(touched), "_bucket", "left_semi")  # a row per bucket at most
            slots = before.groupBy("_bucket").agg(F.first("_slot").alias("_old"))
            both = rows.unionByName(before.select(rows.columns))
            rows = latest_per_key(both, key, order, [*columns, "_bucket"]).join(F.broadcast(slots), "_bucket", "left")
            rows = rows.withColumn("_slot", 1 - F.coalesce("_old", F.lit(1))).drop("_old")
        rows = rows.withColumn("_batch", F.lit(n).cast("long")).select(stored.names)
        (rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_bucket", "_slot").parquet(path))

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _newest(state: DataFrame) -> DataFrame:
    """The rows of each bucket's newest slot."""
    newest = state.groupBy("_bucket").agg(F.max("_batch").alias("_batch"))
    return state.join(F.broadcast(newest), ["_bucket", "_batch"], "left_semi")  # a row per bucket


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The state table that ``latest_state_stream`` keeps."""
    return _newest(spark.read.parquet(path)).drop("_bucket", "_slot", "_batch")


def windowed_counts(stream: DataFrame, at: str, width: str, delay: str, key: str) -> DataFrame:
    """Rows per window and key; a window is emitted once, when the watermark passes its end."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return rows.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def sessions(stream: DataFrame, at: str, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of instant events split by gaps; emitted when the watermark passes their end."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return rows.groupBy(F.session_window("_at", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", key, "n")
