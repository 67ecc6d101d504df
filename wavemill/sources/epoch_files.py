"""Epoch files: `.npy` arrays three folders under a split, each with a label array beside it."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import npy_source
def pair_files(paths: DataFrame) -> DataFrame:
    """x_path, y_path of paths(path): every `_X.npy` with its `_y.npy`, in path order; an X alone is left out."""
    x = paths.where(F.col("path").endswith("_X.npy")).select(F.col("path").alias("x_path"), F.regexp_replace("path", "_X\\.npy$", "").alias("stem"))
    y = paths.where(F.col("path").endswith("_y.npy")).select(F.col("path").alias("y_path"), F.regexp_replace("path", "_y\\.npy$", "").alias("stem"))
    return x.join(y, "stem").select("stem", "x_path", "y_path").orderBy("x_path")


def _by_ranges(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Epochs and labels of a split's paired files, each task reading its range of a file."""
    npy_source.register(spark)
    read = lambda kind, suffix, beside: spark.read.format(kind).options(path=f"{root}/{split}", suffix=suffix, beside=beside, depth=3).load()
    return read("npy_epochs", "_X.npy", "_y.npy"), read("npy_labels", "_y.npy", "_X.npy")


def _by_files(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The same from a store that only Spark reads, whole files as rows; an X without labels is told by names alone."""
    files = lambda kind: spark.read.format("binaryFile").load(f"{root}/{split}/*/*/*/*_{kind}.npy")
    named = lambda kind: files(kind).select(F.regexp_replace("path", f"_{kind}\\.npy$", "").alias("recording"), "content")
    if files("X").select("path").isEmpty():
        raise FileNotFoundError(f"no epoch files under {root}/{split}")
    paired = named("X").select("recording").join(named("y").select("recording"), "recording")

    def epochs(parts):
        for pdf in parts:
            for rec, raw in zip(pdf["recording"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                for first in range(0, len(a), 64):
                    block = a[first : first + 64].astype(float)
                    n, c = block.shape[:2]
                    yield pd.DataFrame({"recording": rec, "file_pos": np.repeat(np.arange(first, first + n), c), "channel": np.tile(np.arange(c), n).astype("int32"), "samples": list(block.reshape(n * c, -1))})

    def labels(parts):
        for pdf in parts:
            for rec, raw in zip(pdf["recording"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"recording": rec, "file_pos": np.arange(len(a)), "y": a.astype("int32")})

    # the names are few and small: the rows with their files' bytes stay where they are read
    mine = lambda kind: named(kind).join(F.broadcast(paired), "recording", "left_semi")
    return mine("X").mapInPandas(epochs, npy_source.EPOCHS), mine("y").mapInPandas(labels, npy_source.LABELS)


def read_split(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Epochs (one row per epoch and channel) and labels of a split; epoch_id follows path order, then file order.

    Files are read by ranges where Arrow knows the store, else whole.
    """
    ranges = npy_source.opens(root)
    x, y = (_by_ranges if ranges else _by_files)(spark, root, split)
    if ranges and not npy_source.has_files(f"{root}/{split}", "_X.npy", "_y.npy", 3):
        raise FileNotFoundError(f"no epoch files under {root}/{split}")
    ahead = Window.orderBy("recording").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    begin = y.groupBy("recording").agg(F.count(F.lit(1)).alias("n")).select("recording", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    number = lambda df: df.join(begin, "recording").withColumn("epoch_id", F.col("begin") + F.col("file_pos"))
    return number(x.withColumn("split", F.lit(split))).select("split", "recording", "epoch_id", "channel", "samples"), number(y).select("epoch_id", "recording", "y")


def channel_names(spark: SparkSession, channels: DataFrame, names: list[str] | None = None, path: str | None = None) -> DataFrame:
    """channel, name: from a file (one name a line), else a list, else CH00, CH01, ...; a wrong number falls back."""
    if path is not None:
        names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
    default = F.format_string("CH%02d", "channel")
    count = channels.select("channel").distinct().count()
    if not names or len(names) != count:
        return channels.select("channel").distinct().select("channel", default.alias("name"))
    known = spark.createDataFrame(list(enumerate(names)), "channel int, name string")
    return channels.select("channel").distinct().join(known, "channel", "left").select("channel", F.coalesce("name", default).alias("name"))
