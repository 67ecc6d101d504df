"""Ranks, quantiles, alarms, draws and neighbours where one group or a narrow band holds nearly everything."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.operators import balance, metrics, models, ranks, sequence, stats, tabular
from wavemill.operators.sequence import Alarm


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"wide": 10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400), "near": 1 - rng.uniform(0, 1e-9, 400), "ties": rng.integers(-3, 3, 301).astype(float), "one": np.array([7.0]), "powers": np.array([2.0**k for k in range(-20, 20)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", float("nan")), ("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.975}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g]["a"], got[g]["b"], got[g]["c"]) == pytest.approx(tuple(np.percentile(vs, [5, 50, 97.5])), rel=1e-12)
    filled = tabular.impute_median(df.withColumnRenamed("g", "feature").withColumnRenamed("v", "value"))
    assert filled.count() == len(rows) and filled.where("feature = 'none'").first()["value"] == 0.0
    assert tabular.summary(df, "g", "v").count() == 6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60))
def test_below_is_the_number_of_smaller_values(spark, values):
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in ranks.with_below(df, ["g"], "v", "n").collect():
        assert r["below"] == sum(v < r["v"] for v in values)


def test_crowded_scores(spark):
    """20,000 scores under 0.0005, and one outlier: no digit holds them all, and AUC and ranks are exact."""
    rng = np.random.default_rng(2)
    p, y = rng.uniform(0, 5e-4, 20_000), rng.integers(0, 2, 20_000)
    p[0] = 1e12
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")
    order = np.argsort(np.argsort(p)) + 1.0
    pos, neg = (y == 1).sum(), (y == 0).sum()
    want = (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    assert metrics.roc_auc(df.withColumn("g", F.lit(0)), ["g"], "y", "p").first()["roc_auc"] == pytest.approx(want, abs=1e-12)
    cells = df.select(ranks._digits(F.col("p"))[0].alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 100
    n = len(p)
    h = 12 / (n * (n + 1)) * sum(order[y == k].sum() ** 2 / (y == k).sum() for k in (0, 1)) - 3 * (n + 1)
    assert stats.kruskal_wallis(df, "y", "p").first()["h"] == pytest.approx(h, rel=1e-6)


def plain_alarm(scores, rule):
    on, high, low, cooldown, out = False, 0, 0, 0, []
    for p in scores:
        if not on:
            cooldown = max(0, cooldown - 1)
            if cooldown == 0:
                high = high + 1 if p >= rule.t_on else 0
                if high >= rule.min_on:
                    on, high, low = True, 0, 0
        else:
            low = low + 1 if p < rule.t_off else 0
            if low >= rule.min_off:
                on, low, cooldown = False, 0, rule.refractory
        out.append(int(on))
    return out


def test_alarm_of_a_long_series(spark, monkeypatch):
    """One series of many chunks, composed over several levels."""
    monkeypatch.setattr(sequence, "FAN", 3)
    rng = random.Random(3)
    scores = [rng.random() for _ in range(1000)]
    rows = [(1, k, p) for k, p in enumerate(scores)] + [(2, k, p) for k, p in enumerate(scores[:7])]
    rule = Alarm(0.6, 0.4, 2, 2, 3)
    out = sequence.alarm(spark.createDataFrame(rows, "recording int, epoch_id long, p double"), rule, chunk=8).collect()
    got = {(r["recording"], r["epoch_id"]): r["alarm"] for r in out}
    assert [got[1, k] for k in range(1000)] == plain_alarm(scores, rule) and [got[2, k] for k in range(7)] == plain_alarm(scores[:7], rule)


def test_many_classes(spark, monkeypatch):
    monkeypatch.setattr(balance, "DRAWS", 4)
    rows = [(i, i % 1200) for i in range(2400)] + [(5000 + i, 7) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, y int")
    sizes = {r["y"]: r["count"] for r in balance.oversample(df, "id").groupBy("y").count().collect()}
    assert len(sizes) == 1200 and set(sizes.values()) == {11}
    assert {r["count"] for r in balance.undersample(df, "id").groupBy("y").count().collect()} == {2}
    weights = {r["y"]: r["weight"] for r in models.balanced(df, "y").collect()}
    assert len(weights) == 1200 and weights[7] == pytest.approx(2409 / (1200 * 11))


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 3)), rng.integers(0, 2, 150)
    df = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(150)], "epoch_id long, y int, a double, b double, c double")
    got = {r["epoch_id"]: r["y_prob"] for r in models.knn(df.where("epoch_id % 3 > 0"), df.where("epoch_id % 3 = 0"), ["a", "b", "c"], block=16).collect()}
    train = [k for k in range(150) if k % 3]
    assert got == pytest.approx({q: np.mean([y[t] for t in sorted(train, key=lambda t: (((x[q] - x[t]) ** 2).sum(), t))[:7]]) for q in range(0, 150, 3)})
