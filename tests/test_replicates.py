"""Replicates without rows: their distribution, ties cut over tasks, groups, gaps and metric names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.operators import stats
from wavemill.operators.replicates import replicated


@pytest.fixture(scope="module")
def scored(spark):
    """600 rows, a third of them of one score, some without a score or a label."""
    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.3).astype(int)
    p = np.where(rng.random(600) < 0.33, 0.5, np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2))
    rows = [(f"r{k}", int(y[k]), float(p[k])) for k in range(600)] + [("x", None, 0.1), ("z", 1, None), ("n", 1, float("nan"))]
    return spark.createDataFrame(rows, "row string, y int, p double").repartition(7), y, p


def auc(y, p, w):
    pos, neg = w * y, w * (1 - y)
    order = np.unique(p, return_inverse=True)[1]
    a, b = np.bincount(order, pos), np.bincount(order, neg)
    return (a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum())


def test_bootstrap_is_that_of_resampled_rows(scored):
    df, y, p = scored
    got = np.array([r["roc_auc"] for r in replicated(df, "bootstrap", "row", 1500, "7").collect()])
    rng = np.random.default_rng(1)
    want = np.array([auc(y, p, np.bincount(rng.integers(0, 600, 600), minlength=600)) for _ in range(1500)])
    assert len(got) == 1500 and abs(got.mean() - want.mean()) < 0.003 and abs(got.std() / want.std() - 1) < 0.1
    assert np.abs(np.quantile(got, [0.05, 0.5, 0.95]) - np.quantile(want, [0.05, 0.5, 0.95])).max() < 0.006


def test_shuffled_labels_keep_their_number_and_distribution(scored):
    df, y, p = scored
    rows = replicated(df, "labels", "row", 1500, "7").collect()
    assert {r["tp"] + r["fn"] for r in rows} == {float(y.sum())} and {r["fp"] + r["tn"] for r in rows} == {float(600 - y.sum())}
    got, rng = np.array([r["roc_auc"] for r in rows]), np.random.default_rng(1)
    want = np.array([auc(rng.permutation(y), p, np.ones(600)) for _ in range(1500)])
    assert abs(got.mean() - 0.5) < 0.003 and abs(got.std() / want.std() - 1) < 0.1


def test_result_does_not_depend_on_the_number_of_tasks(spark, scored):
    df, _, _ = scored
    found = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(tuple(r) for r in replicated(df, "bootstrap", "row", 40, "7").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


@pytest.mark.parametrize("metric", ["accuracy", "f1", "f_beta", "specificity"])
def test_metrics_by_name(scored, metric):
    df, y, p = scored
    out = stats.bootstrap_ci(df, "row", 300, metric=metric).first()
    hit = p >= 0.5
    tp, fp, fn, tn = (y * hit).sum(), ((1 - y) * hit).sum(), (y * ~hit).sum(), ((1 - y) * ~hit).sum()
    want = {"accuracy": (tp + tn) / 600, "f1": 2 * tp / (2 * tp + fp + fn), "f_beta": 5 * tp / (5 * tp + 4 * fn + fp), "specificity": tn / (tn + fp)}[metric]
    assert out["samples"] == 300 and out["ci_lo"] < want < out["ci_hi"] and abs(out["mean"] - want) < 0.02
    shuffled = stats.surrogates(df, "row", 200, metric=metric).first()
    assert shuffled["observed"] == pytest.approx(want) and shuffled["p"] < 0.05
    with pytest.raises(ValueError):
        stats.bootstrap_ci(df, "row", 3, metric="kappa")


def test_channels_apart_and_without_a_class(spark, scored):
    df, _, _ = scored
    two = df.withColumn("epoch_id", F.col("row")).withColumn("channel", F.lit(1)).unionByName(df.withColumn("epoch_id", F.col("row")).withColumn("channel", F.lit(2)).withColumn("p", F.rand(3)))
    two = two.unionByName(two.where("channel = 1").withColumn("channel", F.lit(3)).withColumn("y", F.lit(1)))
    got = {r["channel"]: (r["significant"], r["roc_auc"]) for r in stats.channel_significance(two, 100).collect()}
    assert got[1][0] and not got[2][0] and got[3][1] is None


@pytest.mark.parametrize("scheme", ["bootstrap", "swap", "labels"])
def test_slices_of_one_score_and_of_several(scheme):
    """What a task passes on of sorted rows, against all pairs; a score may begin, fill and end slices."""
    from wavemill.operators import replicates as r

    rng = np.random.default_rng(6)
    s = np.sort(np.r_[np.repeat(0.5, 3 * r.SLICE), np.round(rng.random(300), 2)])
    n = len(s)
    h, t, y, side = rng.integers(0, r.PRIME, n), rng.integers(0, r.PRIME, n), rng.integers(0, 2, n), rng.integers(0, 2, n)
    coef = r.coefficients("3", 12)
    u = r.draws(h, coef)
    assert (u == ((h * h % r.PRIME)[:, None] * coef[0] + h[:, None] * coef[1] + coef[2]) % r.PRIME).all()
    cut = {"x": np.sort(u << 31 | t[:, None], axis=0)[n // 3]}
    if scheme == "bootstrap":
        w = (u[:, :, None] >= np.array(r.poisson_cuts())).sum(2)
        want = {"x": (w * y[:, None], w * (1 - y)[:, None])}
    elif scheme == "swap":
        swap = 2 * u < r.PRIME
        swap[:, 0] = False
        a = swap == (side == 1)[:, None]
        want = {f"x{g}": (w * y[:, None], w * (1 - y)[:, None]) for g, w in (("a", a), ("b", ~a))}
    else:
        label = (u << 31 | t[:, None]) <= cut["x"]
        want = {"x": (label, ~label)}
    batch = pa.RecordBatch.from_pydict({"g": ["x"] * n, "s": s, "y": y, "pred": (s > 0.7).astype(int), "h": h, "t": t, "side": side})
    rows = [row for part in r._weighted(scheme, coef, cut)([batch]) for row in part.to_pylist()]
    for g, (pos, neg) in want.items():
        for rep in range(12):
            mine = sorted((row for row in rows if row["g"] == g and row["replicate"] == rep), key=lambda row: (row["low"], row["tie"]))
            won = below = 0
            for row in mine:
                won += row["won"] + row["pos"] * (below + (row["neg"] / 2 if row["tie"] else 0))
                below += row["neg"]
            pairs = (s[None] < s[:, None]) + (s[None] == s[:, None]) / 2
            assert won == pos[:, rep] @ pairs @ neg[:, rep]
            assert (sum(row["tp"] for row in mine), sum(row["fp"] for row in mine)) == (pos[s > 0.7, rep].sum(), neg[s > 0.7, rep].sum())
    assert r.SLICE * 12 * 8 < 1 << 18  # draws of a slice stay in a cache; a thousand columns of them in half a megabyte
