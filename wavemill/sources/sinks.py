"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metrics_document(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON document {"meta": ..., "results": {model: {...}}} from a row per model and a single row of settings."""
    fields = [c for c in metrics.columns if c != "model"]
    entry = F.struct(F.col("model"), F.struct(*fields).alias("m"))
    results = metrics.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("results"))  # a row per model
    return results.crossJoin(meta.select(F.struct(*meta.columns).alias("meta"))).select(F.to_json(F.struct("meta", "results")).alias("document"))


def flatten(df: DataFrame) -> DataFrame:
    """Maps with integer keys as columns `name.key`, arrays as JSON text: the shape of a flat CSV."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            keys = df.select(F.explode(F.map_keys(f.name)).alias("k")).distinct().orderBy("k").collect()  # a column each
            out += [F.col(f.name).getItem(r["k"]).alias(f"{f.name}.{r['k']}") for r in keys]
        elif isinstance(f.dataType, T.ArrayType | T.StructType):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """model, epoch_id, y_true, y_prob, y_pred (and what else scores has) as Parquet, a folder per model."""
    scores.write.mode(mode).partitionBy("model").parquet(path)


def write_lines(values: list, path: str, spark) -> None:
    """A text file with a line per value."""
    spark.createDataFrame([(str(v),) for v in values], "value string").coalesce(1).write.mode("overwrite").text(path)
