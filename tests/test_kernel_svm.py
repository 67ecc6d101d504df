"""The kernel machine against a plain dual solver, its probabilities, and rows that could trip it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import kernel_svm, models


def dual(k: np.ndarray, s: np.ndarray, c: np.ndarray, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """Signed dual weights and the constant of a squared-hinge machine, by steps on the pair that violates most."""
    k = k + np.diag(1 / (2 * c))
    q, a = k * np.outer(s, s), np.zeros(len(s))
    g = -np.ones(len(s))
    for _ in range(rounds):
        v = -s * g
        up, down = (s > 0) | (a > 0), (s < 0) | (a > 0)
        i, j = np.argmax(np.where(up, v, -np.inf)), np.argmin(np.where(down, v, np.inf))
        if v[i] - v[j] < 1e-9:
            break
        t = (v[i] - v[j]) / (k[i, i] + k[j, j] - 2 * k[i, j])
        t = min(t, np.inf if s[i] > 0 else a[i], a[j] if s[j] > 0 else np.inf)
        a[i], a[j] = a[i] + s[i] * t, a[j] - s[j] * t
        g += q[:, i] * s[i] * t - q[:, j] * s[j] * t
    return a * s, (v[i] + v[j]) / 2


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(140, 3))
    y = ((x[:, 0] ** 2 + x[:, 1] ** 2 + 0.4 * rng.normal(size=140)) > 1.6).astype(int)
    return x, y, np.where(y == 1, 140 / (2 * y.sum()), 140 / (2 * (1 - y).sum()))


def table(spark, x, y, c):
    return spark.createDataFrame([(a.tolist(), int(b), float(w)) for a, b, w in zip(x, y, c)], "x array<double>, y int, weight double")


def scores(spark, machine, x):
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "i int, x array<double>")
    return rows.select("i", machine.score(F.col("x")).alias("f"), machine.probability(F.col("x")).alias("p")).toPandas().sort_values("i")


def test_agrees_with_the_dual(spark, sample, tmp_path):
    x, y, c = sample
    machine = kernel_svm.fit_machine(table(spark, x, y, c), landmarks=200)
    gamma = 1 / (x**2).sum(1).mean()
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    signed, free = dual(k, 2.0 * y - 1, c)
    got = scores(spark, machine, x)
    assert np.abs(got["f"] - (k @ signed + free)).max() < 1e-6
    assert machine.slope > 0 and ((got["p"] > 0) & (got["p"] < 1)).all()
    assert ((got["p"] >= 0.5) == (y == 1)).mean() > 0.8
    machine.save(f"{tmp_path}/svm")
    again = scores(spark, kernel_svm.Machine.load(f"{tmp_path}/svm"), x)
    assert np.allclose(again["p"], got["p"], rtol=0, atol=1e-12)


def test_few_landmarks_and_copies(spark, sample):
    """Landmarks bound the model, not the rows; a row repeated many times takes one of them and its weight counts each time."""
    x, y, c = sample
    rows = table(spark, np.r_[x, np.repeat(x[:1], 300, 0)], np.r_[y, np.repeat(y[:1], 300)], np.r_[c, np.full(300, 1e-6)])
    machine = kernel_svm.fit_machine(rows, landmarks=40)
    assert len(np.unique(machine.kernel.landmarks, axis=0)) == 40
    assert ((scores(spark, machine, x)["f"] > 0) == (y == 1)).mean() > 0.85


def test_as_a_model(spark):
    """Gaps, a constant column, one more column than is asked for, rows without a label; one class alone and no rows."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(120, 2))
    rows = [(i, float(a) if i % 9 else None, float(b) if i % 11 else float("nan"), 7.0, "s", None if i % 40 == 0 else int(a * b > 0)) for i, (a, b) in enumerate(z)]
    data = spark.createDataFrame(rows, "epoch_id long, f0 double, f1 double, f2 double, weight string, y int")
    scored = models.fit("svm_rbf", data.where("y is not null").drop("weight"), ["f0", "f1", "f2"])(data).toPandas()
    assert len(scored) == 120 and scored["y_prob"].between(0, 1).all() and set(scored["weight"]) == {"s"}
    known = scored[scored["y"].notna()]
    assert ((known["y_prob"] >= 0.5) == (known["y"] == 1)).mean() > 0.75
    one = models.fit("svm_rbf", data.where("y = 1").drop("weight"), ["f0", "f1"])(data).toPandas()
    assert one["y_prob"].between(0, 1).all()
    with pytest.raises(ValueError, match="no rows"):
        kernel_svm.fit_machine(data.where("false").select(F.array("f0").alias("x"), "y", F.lit(1.0).alias("weight")))
