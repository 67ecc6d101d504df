"""Statistical procedures. Resampled and shuffled metrics of large tables come from `replicates`; the sign-flip test and the
bootstrap of means, whose inputs are a row per cell of an experiment, take replicates as rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coins import tails
from ..functions.safe import finite, ratio, uniform
from .metrics import confusion, rates, roc_auc
from .ranks import with_below
from .replicates import METRICS, replicated


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with df degrees of freedom > x): closed form, by recursion over df. For rows of results only."""

    def one(v: float, k: int) -> float:
        if v is None or math.isnan(v):
            return float("nan")
        if v <= 0:
            return 1.0
        p, term, start = (math.exp(-v / 2), math.exp(-v / 2), 2) if k % 2 == 0 else (math.erfc(math.sqrt(v / 2)), math.sqrt(2 * v / math.pi) * math.exp(-v / 2), 1)
        for j in range(start, k, 2):
            if k % 2 == 0:
                term *= v / j
            p += term
            if k % 2:
                term *= v / (j + 2)
        return min(p, 1.0)

    return pd.Series([one(v, int(k)) for v, k in zip(x, df, strict=True)], dtype=float)


def mcnemar(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """only_a, only_b (rows that one of two predictions has right), statistic with continuity correction, p."""
    right = lambda c: F.col(c) == F.col(y)
    n = rows.agg(F.count_if(right(a) & ~right(b)).alias("only_a"), F.count_if(~right(a) & right(b)).alias("only_b"))
    total = F.col("only_a") + F.col("only_b")
    stat = ratio(F.pow((F.abs(F.col("only_a") - F.col("only_b")) - 1).cast("double"), F.lit(2.0)), total)
    return n.withColumn("statistic", stat).withColumn("p", F.when(total > 0, chi2_tail("statistic", F.lit(1))).otherwise(1.0))


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """h (tie-corrected), groups, p of finite values.

    Ranks come from the counts per distinct value; counts below are summed digit by digit, so no task sees all values.
    """
    v = finite(F.col(value))
    counts = rows.select(F.col(group).alias("g"), v.alias("v")).where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("v").agg(F.sum("n").alias("t")).withColumn("every", F.lit(0))
    ranks = with_below(values, ["every"], "v", "t").select("v", "t", (F.col("below") + (F.col("t") + 1) / 2).alias("rank"))
    per_group = counts.join(ranks, "v").groupBy("g").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    h = per_group.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("groups"))
    tie = ranks.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = h.join(F.broadcast(tie)).withColumn("h", F.when(F.col("groups") >= 2, F.try_divide(raw, 1 - F.try_divide(F.col("tie"), n * n * n - n))))
    return h.select("h", "groups", F.when(F.col("h").isNotNull(), chi2_tail("h", F.col("groups") - 1)).alias("p"))


def sign_flip_exact(pairs: DataFrame) -> DataFrame:
    """Exact two-sided sign-flip test of paired values (a, b), for at most 16 pairs: all 2^n sign patterns."""
    d = pairs.where(finite(F.col("a")).isNotNull() & finite(F.col("b")).isNotNull()).agg(F.array_sort(F.collect_list(F.col("a") - F.col("b"))).alias("d"))
    d = d.select(F.when(F.size("d") <= 16, F.col("d")).otherwise(F.raise_error(F.lit("more than 16 pairs"))).alias("d"))
    flips = d.select("d", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size("d")).cast("int") - 1)).alias("mask"))
    flipped = F.aggregate(F.transform("d", lambda v, i: F.when(F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) > 0, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v)
    seen = F.aggregate("d", F.lit(0.0), lambda a, v: a + v)
    return flips.agg(F.count(F.lit(1)).alias("patterns"), (F.count_if(F.abs(flipped) >= F.abs(seen) - 1e-12) / F.count(F.lit(1))).alias("p"))


def sign_flip_random(pairs: DataFrame, row_id: str, n_perm: int = 1000, seed: str = "42") -> DataFrame:
    """Two-sided sign-flip test of any number of paired values (a, b) over n_perm seeded random sign patterns.

    patterns, p = (patterns that reach the observed sum, and one) / (n_perm + 1); p is null without pairs. Sums within
    rounding of the observed one reach it.
    """
    d = pairs.where(finite(F.col("a")).isNotNull() & finite(F.col("b")).isNotNull()).select(F.col(row_id).cast("string").alias("row"), (F.col("a") - F.col("b")).alias("d"))

    def partial(batches):
        sums, size, some = np.zeros(n_perm + 1), 0.0, False
        for batch in batches:
            row, value = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            for at in range(0, len(row), 256):
                v = value[at : at + 256]
                sums += v.sum()
                sums[1:] -= 2 * (v @ tails(seed, 1, n_perm, row[at : at + 256]).astype(float))
                size, some = size + np.abs(v).sum(), True
        if some:
            yield pa.RecordBatch.from_pydict({"replicate": pa.array(range(-1, n_perm + 1), pa.int32()), "s": np.r_[size, sums]})

    sums = d.mapInArrow(partial, "replicate int, s double").groupBy("replicate").agg(F.sum("s").alias("s"))
    of = lambda r: F.max(F.when(F.col("replicate") == r, F.abs("s")))
    one = sums.agg(of(0).alias("seen"), (of(-1) * 1e-12).alias("slack"), F.collect_list(F.when(F.col("replicate") > 0, F.col("s"))).alias("all"))
    reached = F.size(F.filter("all", lambda v: F.abs(v) >= F.col("seen") - F.col("slack")))
    return one.select(F.lit(n_perm).cast("long").alias("patterns"), F.when(F.col("seen").isNotNull(), (reached + 1) / F.lit(n_perm + 1)).alias("p"))


def sign_flip(pairs: DataFrame, row_id: str, n_perm: int = 1000, seed: str = "42") -> DataFrame:
    """patterns, p of the exact test for at most 16 pairs, of the random one for more."""
    few = pairs.where(finite(F.col("a")).isNotNull() & finite(F.col("b")).isNotNull()).limit(17).count() <= 16
    return sign_flip_exact(pairs) if few else sign_flip_random(pairs, row_id, n_perm, seed)


def replicates(rows: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate."""
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _asked(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return metric


def bootstrap_ci(rows: DataFrame, row_id: str, n_boot: int = 1000, ci: float = 0.95, seed: str = "0", y: str = "y", score: str = "p", metric: str = "roc_auc", pred: str | None = None, beta: float = 2.0) -> DataFrame:
    """mean, ci_lo, ci_hi of a metric over Poisson bootstrap samples (samples in which it has no value are dropped)."""
    each = replicated(rows, "bootstrap", row_id, n_boot, seed, y, score, pred, beta=beta).select(F.col(_asked(metric)).alias("m"))
    low, high = (1 - ci) / 2, 1 - (1 - ci) / 2
    return each.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(low)).alias("ci_lo"), F.percentile("m", F.lit(high)).alias("ci_hi"), F.count("m").alias("samples"))


def permutation_test(rows: DataFrame, row_id: str, a: str, b: str, n_perm: int = 1000, seed: str = "0", y: str = "y", metric: str = "roc_auc", beta: float = 2.0) -> DataFrame:
    """Difference of a metric between two scores and its one-sided permutation p, swapping the scores row by row."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("s")), F.struct(F.lit(1).alias("side"), F.col(b).alias("s"))))
    long = rows.select(row_id, y, sides.alias("x")).select(row_id, y, "x.side", "x.s")
    each = replicated(long, "swap", row_id, n_perm + 1, seed, y, "s", side="side", beta=beta)
    of = lambda g: F.max(F.when(F.col("g") == g, F.col(_asked(metric))))
    each = each.groupBy("replicate").agg((of("a") - of("b")).alias("d"))
    seen = each.where("replicate = 0").select(F.col("d").alias("observed"))
    return each.where("replicate > 0").join(F.broadcast(seen)).groupBy("observed").agg(((F.count_if(F.col("d") >= F.abs("observed")) + 1) / F.lit(n_perm + 1)).alias("p"))


def _observed(rows: DataFrame, by: list[str], metric: str, y: str, score: str, pred: str | None, beta: float) -> DataFrame:
    if metric == "roc_auc":
        return roc_auc(rows, by, y, score).withColumnRenamed("roc_auc", "observed")
    given = rows.where(finite(F.col(score)).isNotNull() & F.col(y).isNotNull()).withColumn("__pred", F.col(pred).cast("int") if pred else (F.col(score) >= 0.5).cast("int"))
    return rates(confusion(given, by, y, "__pred"), beta).select(*by, F.col(metric).alias("observed"))


def surrogates(rows: DataFrame, row_id: str, n: int = 1000, seed: str = "0", y: str = "y", score: str = "p", metric: str = "roc_auc", pred: str | None = None, beta: float = 2.0) -> DataFrame:
    """Observed metric, its mean and population std under shuffled labels, z and two-sided p."""
    null = replicated(rows, "labels", row_id, n, seed, y, score, pred, beta=beta).select(F.col(_asked(metric)).alias("m"))
    seen = _observed(rows.withColumn("__one", F.lit(1)), ["__one"], metric, y, score, pred, beta).select("observed")
    out = null.join(F.broadcast(seen)).groupBy("observed").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.collect_list("m").alias("all"))
    far = F.size(F.filter("all", lambda v: F.abs(v - F.col("mean")) >= F.abs(F.col("observed") - F.col("mean"))))
    return out.select("observed", "mean", "std", ratio(F.col("observed") - F.col("mean"), F.col("std")).alias("z"), (far / F.lit(n)).alias("p"))


def bootstrap_mean(rows: DataFrame, group: str, value: str, n_boot: int = 1000, ci: float = 0.95, seed: str = "42") -> DataFrame:
    """Bootstrap confidence interval of the mean of each group's few values (draws with replacement by position)."""
    lists = rows.where(finite(F.col(value)).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("v"))
    draws = lists.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("v") - 1)))
    at = F.floor(uniform(seed, F.col("replicate"), F.col("i")) * F.size("v")).cast("int")
    means = draws.select(group, "replicate", F.get("v", at).alias("x")).groupBy(group, "replicate").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(F.percentile("m", F.lit((1 - ci) / 2)).alias("ci_lo"), F.percentile("m", F.lit(1 - (1 - ci) / 2)).alias("ci_hi"))


def channel_significance(scored: DataFrame, n_perm: int = 500, seed: str = "42", y: str = "y", score: str = "p", metric: str = "roc_auc", pred: str | None = None, beta: float = 2.0) -> DataFrame:
    """Per channel: a metric of fixed scores, and the share of label permutations that reach it (p < 0.05 is significant)."""
    observed = _observed(scored, ["channel"], _asked(metric), y, score, pred, beta).select(F.col("channel").cast("string").alias("g"), "channel", F.col("observed").alias(metric))
    null = replicated(scored, "labels", "epoch_id", n_perm, seed, y, score, pred, group="channel", beta=beta).select("g", F.col(metric).alias("null"))
    joined = null.join(F.broadcast(observed), "g")
    return joined.groupBy("channel").agg(F.max(metric).alias(metric), (F.count_if(F.col("null") >= F.col(metric)) / F.count(F.lit(1))).alias("p")).withColumn("significant", F.col("p") < 0.05)
