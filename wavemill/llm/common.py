"""Shared pieces of the corpus operators: table access, scratch tables, batching."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}
#: Text handled at once in a Python worker; numpy holds some dozen bytes for each of these.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one will do for a
    local master only; on a cluster it would be one machine's disk."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-")
        shared = _OWN_FOLDER[app]
    return f"{shared.rstrip('/')}/wavemill"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column; sets chunk and bucket counts in proportion to the input."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def pieces_for(spark: SparkSession, amount: int, each: int, least: int | None = None) -> int:
    return max(least or 4 * spark.sparkContext.defaultParallelism, -(-amount // each), 1)


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most `limit` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def small_batches(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that the text column of each has at most `limit` bytes (a longer row comes alone)."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = raw_text(batch.column(batch.schema.get_field_index(column)))
            for i, j in slices(offsets, limit):
                yield batch.slice(i, j - i)


def doc_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64; a missing id counts as the largest."""
    return np.asarray(pc.fill_null(column, np.iinfo(np.int64).max), dtype=np.int64)
