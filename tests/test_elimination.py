"""Elimination with a cross-validated number of features, against numpy on the rows themselves."""

import numpy as np
import pytest

from wavemill.operators import linear, selection


def plain_auc(s, y):
    pairs = s[y == 1][:, None] - s[y == 0][None]
    return float(((pairs > 0) + 0.5 * (pairs == 0)).mean())


def plain_fit(x, y, ridge=1e-3):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-12, 1, sd)
    z, t = (x - mean) / sd, 2.0 * y - 1
    w = np.linalg.solve(z.T @ z / len(x) + ridge * np.eye(x.shape[1]), z.T @ (t - t.mean()) / len(x))
    return np.abs(w), lambda rows: ((rows - mean) / sd) @ w


def plain_path(x, y):
    left, gone = list(range(x.shape[1])), []
    while len(left) > 1:
        gone.append(left.pop(int(np.argmin(plain_fit(x[:, left], y)[0]))))
    return left + gone[::-1]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    n, p = 240, 7
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, p)) + np.outer(y, [2.0, 0, 0, 1.0, 0, 0, 0.3])
    fold = np.arange(n) % 3
    df = spark.createDataFrame([(i, int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(n)], "epoch_id bigint, y int, fold int, " + ", ".join(f"f{k} double" for k in range(p)))
    return x, y, fold, df, [f"f{k}" for k in range(p)]


def test_each_fold_has_its_own_path(made):
    x, y, fold, df, names = made
    scores, kept, best = selection.eliminate_cv(df, names, 2)
    want = {n: [] for n in range(2, 8)}
    for k in range(3):
        learn, held = fold != k, fold == k
        path = plain_path(x[learn], y[learn])
        for n in want:
            want[n].append(plain_auc(plain_fit(x[learn][:, path[:n]], y[learn])[1](x[held][:, path[:n]]), y[held]))
    assert scores == {n: pytest.approx(np.mean(v), abs=1e-9) for n, v in want.items()}
    assert best == max(sorted(want), key=lambda n: scores[n])
    whole = plain_path(x, y)
    assert kept == {n: whole[:n] for n in want} and set(whole[:2]) == {0, 3}


def test_other_estimators_and_few_features(made):
    x, y, fold, df, names = made
    scores, kept, best = selection.eliminate_cv(df, names, 5, "logreg", share=0.3)
    assert sorted(scores) == sorted(kept) == [5, 7] and best in scores and all(0.8 < s <= 1 for s in scores.values())
    assert {0, 3} <= set(kept[5]) and all(len(v) == n for n, v in kept.items())
    assert selection.eliminate_cv(df, names[:3], 20)[2] == 3
    best, by_size = selection.best_size(df, linear.Products(df, names), [3, 50], estimator="logreg")
    assert sorted(by_size) == [3] and best == 3
