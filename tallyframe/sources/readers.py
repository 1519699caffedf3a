"""Sources: nested records, JSON columns, CSV, part files, text lines and file facts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.urls import host_matches

WHOLE_BYTES = 256 << 20  # files up to this size are read as one value
CHUNK_BYTES = 8 << 20


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON records with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).json(path)


def explode_records(
    records: DataFrame, items: str, parent: list[str], fields: list[str],
    url_field: str | None = None, domain: str | None = None, tags: str | None = None,
) -> DataFrame:
    """One row per nested item with the parent fields repeated.

    Items whose URL is not on ``domain`` are dropped; the ``tags`` array is joined with ``;``.
    """
    cols = [F.col(c) for c in parent]
    if tags:
        cols.append(F.concat_ws(";", F.col(tags)).alias(tags))
    rows = records.select(*cols, F.explode(items).alias("_item"))
    if url_field and domain:
        rows = rows.filter(host_matches(F.col(f"_item.{url_field}"), domain))
    names = [*parent, *([tags] if tags else [])]
    return rows.select(*names, *[F.col(f"_item.{f}").alias(f) for f in fields])


def json_fields(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """Typed fields out of a JSON text column; malformed text gives nulls."""
    parsed = df.select(*keep, F.from_json(F.col(column), schema).alias("_j"))
    return parsed.select(*keep, "_j.*")


def read_csv(spark: SparkSession, path: str, schema: str, literal_na: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header. By default '' and the usual words for a missing value are null; ``literal_na`` keeps them as text.

    A file is split into tasks; ``multi_line`` allows line breaks inside quotes and makes a file one task.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    if literal_na:
        return reader.option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")
    df = reader.option("nullValue", "").csv(path)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(~F.col(c).isin(fixed.CSV_MISSING), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    """All parts under a folder as one table; folder names of the form key=value become columns
    and a filter on them skips whole parts."""
    return spark.read.option("mergeSchema", True).parquet(root)


def stack_parts(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a part is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the files of ``path``, read in chunks."""
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.string()), batch.column("bytes")], names=["file", "sha256", "bytes"])


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE_BYTES) -> DataFrame:
    """sha256, size and path below ``path`` of every file; contents are hashed in the tasks that read them.

    Files of equal name in different folders keep apart. A file above ``whole`` bytes is never held as one value: a
    task of its own streams it through the digest, so files may be of any size. Spark lists no empty files: they have no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = path.split(":", 1)[-1].strip("/") + "/"
    below = F.substring_index("path", root, -1).alias("file")
    small = files.filter(F.col("length") <= whole).select(below, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = files.filter(F.col("length") > whole).select("path", below, F.col("length").alias("bytes"))
    return small.unionByName(large.mapInArrow(_digests, "file string, sha256 string, bytes long"))


def checksum_verify(current: DataFrame, recorded: DataFrame, key: str = "file", digest: str = "sha256") -> DataFrame:
    """Every file of either side with its outcome: match, differs, missing or unrecorded."""
    a = current.select(key, F.col(digest).alias("_now"))
    b = recorded.select(key, F.col(digest).alias("_then"))
    outcome = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "unrecorded")
        .when(F.col("_now") == F.col("_then"), "match").otherwise("differs")
    )
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))
