"""Tables written in passing: they cut lineage, survive lost executors, and keep the plans of what reads them small."""

from __future__ import annotations

import tempfile
import uuid
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession

from .progress import report

_OWN_FOLDER: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or for a local master a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-")
        shared = _OWN_FOLDER[app]
    return f"{shared.rstrip('/')}/wavemill-tables"


def settle(df: DataFrame, stage: str = "", **measures: Column) -> DataFrame:
    """df, written to a table of its own and read from there; with a stage's name, a progress line tells what was written."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    began = perf_counter()
    df.write.parquet(path)
    seconds = perf_counter() - began
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if stage:
        report(out, stage, seconds, **measures)
    return out


def drop(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
