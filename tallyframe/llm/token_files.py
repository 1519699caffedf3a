"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Files are in ascending order of ``doc_id``; their numbers follow the order. A reader can take stripes in
parallel, and a filter on ``doc_id`` skips files and row groups by minimum, maximum and Bloom filter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .tokens import encoder, with_end

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, stripe_bytes: int = 64 << 20, index_stride: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Encode every whole text (null: empty), append ``end_id``, write one row per document.

    Rows are range-partitioned by ``doc_id`` (ties by the size of the text, so a repeated id can span
    tasks; null ids first). ``start_in_part`` counts the ids of the rows before it in its partition.
    """

    def run(batches):
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(batch, "text", 6 << 20):
                piece = batch.slice(a, b - a)
                flat, counts = with_end(*enc.encode(piece.column("text")), end_id)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(np.full(b - a, part), pa.int32()), pa.array(before + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.view(np.int32)))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_size", F.octet_length("text"))
    ordered = rows.repartitionByRange("doc_id", "_size").sortWithinPartitions("doc_id", "_size", F.xxhash64("text")).drop("_size")
    (ordered.mapInArrow(run, FILE_SCHEMA).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp)
     .option("orc.create.index", "true").option("orc.row.index.stride", index_stride).option("orc.stripe.size", stripe_bytes)
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents: the filter reaches the scan, which skips by index and Bloom filter."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone.

    Counts and checksums come from the ids read back; the partition totals (one row per partition,
    from the narrow columns) shift the starts.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, offs = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                                              pa.array(np.diff(offs), pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    rows = files.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the writer
    shift = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(shift), "part").select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
