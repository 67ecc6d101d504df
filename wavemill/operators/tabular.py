"""Imputation, scaling, reduction, summaries, ranking and votes over long (feature, value) and small result tables."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite, ratio
from ..sources.scratch import drop, settle
from . import ranks

#: Share of the values on either side of a median that are put in order to find it.
BRACKET = 0.02


def medians(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Exact median of the finite values of each feature (midpoint of the two middle ones)."""
    return ranks.quantiles(rows, [feature], value, {"median": 0.5})


def impute_median(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Missing and infinite values replaced by the feature's median, or by 0 where a feature has no value at all."""
    fill = rows.join(medians(rows, feature, value), feature, "left")
    return fill.withColumn(value, F.coalesce(finite(F.col(value)), F.col("median"), F.lit(0.0))).drop("median")


def column_medians(rows: DataFrame, names: list[str]) -> dict[str, float]:
    """Exact median of the finite values of each column, 0 for a column without any.

    A sketch of all columns gives values a little below and above each median. One pass counts what is smaller, and only
    the few hundredths of the values in between are put in order; a column that its sketch misses is ordered whole.
    """
    values = rows.select(*(finite(F.col(c).cast("double")).alias(f"c{k}") for k, c in enumerate(names)))
    found = values.approxQuantile(values.columns, [0.5 - BRACKET, 0.5 + BRACKET], BRACKET / 2) if names else []
    bounds = {k: ends for k, ends in enumerate(found) if ends}
    if not bounds:
        return dict.fromkeys(names, 0.0)
    entries = (F.struct(F.lit(k).alias("feature"), F.col(f"c{k}").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in bounds.items())
    long = values.select(F.explode(F.array(*entries)).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(F.col("value") <= F.col("hi")).alias("upto"))
    counts = {r["feature"]: r for r in counts.collect()}  # a row per column
    place = {k: (r["n"] - 1) / 2 - r["below"] for k, r in counts.items() if r["below"] <= (r["n"] - 1) // 2 and r["n"] // 2 < r["upto"]}
    missed = [k for k in bounds if k not in place]
    out = {r["feature"]: r["median"] for r in medians(long.where(F.col("feature").isin(missed))).collect()} if missed else {}
    if place:
        inside = long.where(F.col("feature").isin(list(place)) & F.col("value").between(F.col("lo"), F.col("hi")))
        near = settle(inside.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k")))  # read several times
        inside = ranks.with_below(near, ["feature"], "value", "k")
        at = F.create_map(*(x for k, v in place.items() for x in (F.lit(k), F.lit(v))))[F.col("feature")]
        holds = lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("k"))
        ends = inside.groupBy("feature").agg(F.max(F.when(holds(F.floor(at)), F.col("value"))).alias("lo"), F.max(F.when(holds(F.ceil(at)), F.col("value"))).alias("hi"))
        out |= {r["feature"]: r["lo"] if r["lo"] == r["hi"] else 0.5 * r["lo"] + 0.5 * r["hi"] for r in ends.collect()}  # a row per column
        drop(near)
    return {c: out.get(k, 0.0) for k, c in enumerate(names)}


def fill_columns(rows: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Missing and infinite values of the columns replaced by the numbers given."""
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in fill.items()})


def standardise(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(value - mean) / population standard deviation; a constant feature is only centred."""
    stats = rows.groupBy(feature).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(stats, feature).withColumn(value, (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def principal_components(rows: DataFrame, names: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """rows with `pca` (k scores of the centred columns), and each component's share of the variance."""
    means = rows.agg(*(F.avg(c).alias(c) for c in names)).first()
    centred = rows.withColumns({f"__{c}": F.col(c) - F.lit(means[c]) for c in names})
    vectors = VectorAssembler(inputCols=[f"__{c}" for c in names], outputCol="__v").transform(centred)
    model = PCA(k=k, inputCol="__v", outputCol="pca").fit(vectors)
    return model.transform(vectors).drop("__v", *(f"__{c}" for c in names)), model.explainedVariance.toArray().tolist()


def fit_components(rows: DataFrame, names: list[str], k: int):
    """Function that replaces the columns by the first k component scores pca_0, ..., after imputing and scaling as in rows."""
    from .models import apply_scale, fit_scale

    scale, k = fit_scale(rows, names), min(k, len(names))
    vectors = lambda df: VectorAssembler(inputCols=names, outputCol="__v").transform(apply_scale(df, scale))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors(rows))
    return lambda df: model.transform(vectors(df)).withColumn("__p", vector_to_array("__p")).select(*(c for c in df.columns if c not in names), *(F.col("__p")[i].alias(f"pca_{i}") for i in range(k)))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """mean, population std, median, min, max, n of the finite values per group."""
    v = finite(F.col(value))
    moments = rows.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    return moments.join(ranks.quantiles(rows, [by], value, {"median": 0.5}), by, "left").select(by, "mean", "std", "median", "min", "max", "n")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    return ranks.quantiles(rows, [by], value, shares)


def argmax(rows: DataFrame, order: str, name: str, score: str) -> DataFrame:
    """The row with the largest score; missing scores count as -1, ties go to the first in order."""
    s = F.coalesce(finite(F.col(score)), F.lit(-1.0))
    return rows.agg(F.max_by(name, F.struct(s, -F.col(order))).alias(name), F.max_by(score, F.struct(s, -F.col(order))).alias(score))


def top_k(rows: DataFrame, k: int, score: str, tie: str, descending_tie: bool = False) -> DataFrame:
    """The k best rows by score; ties by `tie`."""
    return rows.orderBy(F.desc_nulls_last(score), F.desc(tie) if descending_tie else F.asc(tie)).limit(k)


def votes(selected: DataFrame, features: DataFrame, methods: int) -> DataFrame:
    """feature, share of the methods that selected it; features nobody selected have 0."""
    counts = selected.select("method", "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("__n"))
    return features.select("feature").distinct().join(counts, "feature", "left").select("feature", ratio(F.coalesce("__n", F.lit(0)), F.lit(methods)).alias("votes"))


def elect(votes_: DataFrame, threshold: float, top: int) -> DataFrame:
    """Features with enough votes; if fewer than `top`, the `top` most voted ones (ties: larger index) instead."""
    passed = votes_.where(F.col("votes") >= threshold)
    best = votes_.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("feature")))).where(F.col("__r") <= top).drop("__r")  # a row per feature
    enough = passed.agg((F.count(F.lit(1)) >= top).alias("__ok"))
    return passed.join(F.broadcast(enough), F.col("__ok")).drop("__ok").unionByName(best.join(F.broadcast(enough), ~F.col("__ok")).drop("__ok"))


def rank_label(auc: Column) -> Column:
    return F.when(auc >= 0.6, "Good").when(auc >= 0.5, "Moderate").otherwise("Poor")


def experiment_report(rows: DataFrame) -> DataFrame:
    """Best experiment of each model with a readable balance of classes."""
    best = rows.groupBy("model").agg(F.max_by(F.struct("experiment", "roc_auc", "n0", "n1"), F.struct(F.coalesce("roc_auc", F.lit(-1.0)), -F.col("experiment"))).alias("b"))
    share = F.format_string("%d:%d (ratio:%.2f)", F.col("b.n0"), F.col("b.n1"), ratio(F.col("b.n1"), F.col("b.n0")))
    return best.select("model", F.col("b.experiment").alias("experiment"), F.col("b.roc_auc").alias("roc_auc"), share.alias("classes"), rank_label(F.col("b.roc_auc")).alias("grade"))
