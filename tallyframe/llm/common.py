"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import materialise, prepare, shared_dir

#: Bytes that separate words in every operator here: space and the five ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20  # texts are worked on in slices of about this size inside a task


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, when nothing reads them any more.

    The collection lets Spark's cleaner remove the shuffle files of the jobs that are done with, too.
    """
    spark = written[0].sparkSession
    below = shared_dir(spark).rstrip("/")
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if below.removeprefix("file:").lstrip("/") in folder and "/table-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes together (one row at least)."""
    start, held = 0, 0
    offsets = batch.column(column)
    for i in range(batch.num_rows):
        n = len(offsets[i].as_buffer()) if offsets[i].is_valid else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


__all__ = ["SPACES", "materialise", "release", "scratch", "slices", "tables", "text_or_empty"]
