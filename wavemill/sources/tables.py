"""The provided tables, and the epoch, score and feature views that the engine's operators run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position_in_group(df: DataFrame, group: str, coarse: Column, *order: str) -> DataFrame:
    """Adds `epoch_id`, the row's place within its group by `order`.

    `coarse` must not decrease along the order. Rows are ranked within (group, coarse) and the counts of the coarse cells
    before are added, so that a group of very many rows is spread over its cells.
    """
    df = df.withColumn("__cell", coarse)
    ahead = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order))
    return df.withColumn("__rank", rank).join(before, [group, "__cell"]).withColumn("epoch_id", F.col("__before") + F.col("__rank") - 1).drop("__cell", "__rank", "__before")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, epoch_id, p, y: every user's events as a score series."""
    e = table(spark, sf_dir, "events")
    e = position_in_group(e, "user_id", F.to_date("ts"), "ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), "epoch_id", (F.col("value") / 500).alias("p"), (F.col("event_type") == "error").cast("int").alias("y"))


def embedding_epochs(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """epoch_id, channel, samples, y: each embedding as an epoch, cut into that many channels."""
    e = table(spark, sf_dir, "embeddings")
    long = F.col("embedding").cast("array<double>")
    rows = e.select(F.col("vec_id").alias("epoch_id"), (F.col("label") >= 5).cast("int").alias("y"), long.alias("samples"))
    if channels == 1:
        return rows.select("epoch_id", F.lit(0).alias("channel"), "samples", "y")
    width = 64 // channels
    rows = rows.select("epoch_id", "y", "samples", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    return rows.select("epoch_id", "channel", F.slice("samples", F.col("channel") * width + 1, width).alias("samples"), "y")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch_id, y, feature, value: one row per embedding value."""
    return embedding_epochs(spark, sf_dir).select("epoch_id", "y", F.posexplode("samples").alias("feature", "value"))


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, group, epoch_id, y_true, y_prob: two scores of the same rows."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select("l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_discount") * 10).alias("a"), (F.col("l_quantity") / 50).alias("b"))
    return base.select("l_orderkey", "l_linenumber", "l_linestatus", "y_true", F.explode(F.map_from_arrays(F.array(F.lit("discount"), F.lit("quantity")), F.array("a", "b"))).alias("model", "y_prob"))
