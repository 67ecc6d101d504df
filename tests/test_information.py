"""Mutual information by nearest neighbours against a plain form: ties, gaps, rare classes, skew, chunk borders."""

import numpy as np
import pytest

from wavemill.operators import selection


def harmonic(n):
    return float(np.sum(1.0 / np.arange(1, n))) - 0.5772156649015329


def plain(values, labels, neighbours=3):
    keep = [(v, y) for v, y in zip(values, labels, strict=True) if v is not None and np.isfinite(v) and y is not None]
    sizes = {c: sum(y == c for _, y in keep) for c in {y for _, y in keep}}
    keep = [(v, y) for v, y in keep if sizes[y] > 1]
    if not keep:
        return None
    x, y = np.array([v for v, _ in keep]), np.array([c for _, c in keep])
    terms = []
    for i in range(len(x)):
        k = min(neighbours, sizes[y[i]] - 1)
        own = np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i])
        d = np.sort(own)[k - 1]
        m = int((np.abs(x - x[i]) < d * (1 - 1e-12)).sum()) if d > 0 else int((x == x[i]).sum())
        terms.append(harmonic(k) - harmonic(sizes[y[i]]) - harmonic(m))
    return max(harmonic(len(x)) + float(np.mean(terms)), 0.0)


def cases():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 700).tolist()
    rare = [1 if i % 97 == 0 else 0 for i in range(700)]
    return {
        0: (rng.normal(size=700).tolist(), y),
        1: ((rng.normal(size=700) + 2 * np.array(y)).tolist(), y),
        2: (rng.integers(0, 5, 700).astype(float).tolist(), y),
        3: ([3.25] * 700, y),
        4: ([None, float("nan"), float("inf"), *rng.normal(size=697).tolist()], y),
        5: ((rng.normal(size=700) + np.array(rare)).tolist(), rare),
        6: ([1.0, 2.0, 4.0], [0, 1, 1]),
        7: ([1.0, 2.0], [0, 1]),
        8: ([None, float("nan")], [0, 1]),
        9: ([-0.0, 0.0, 1e300, -1e300, 1.0, 1.0], [0, 0, 1, 1, 0, None]),
        10: ((rng.uniform(1, 1 + 1e-6, 300)).tolist(), y[:300]),
    }


@pytest.mark.parametrize("chunk", [7, 4096])
def test_information_agrees_with_the_plain_form(spark, chunk):
    made = cases()
    rows = [(f, v, c) for f, (vs, ys) in made.items() for v, c in zip(vs, ys, strict=True)]
    df = spark.createDataFrame(rows, "feature int, value double, y int").repartition(5)
    got = {r["feature"]: r["mi"] for r in selection.mutual_information(df, chunk=chunk).collect()}
    assert set(got) == set(made)
    for f, (vs, ys) in made.items():
        want = plain(vs, ys)
        assert got[f] == (None if want is None else pytest.approx(want, abs=1e-9)), f


def test_known_dependence_and_empty_table(spark):
    """Two normal classes four deviations apart share nearly ln 2 nats; noise shares none; no rows give no rows."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 3000)
    x = np.stack([rng.normal(size=3000) + 6 * y, rng.normal(size=3000)])
    df = spark.createDataFrame([(f, float(x[f, i]), int(y[i])) for f in (0, 1) for i in range(3000)], "feature int, value double, y int")
    got = {r["feature"]: r["mi"] for r in selection.mutual_information(df).collect()}
    assert got[0] == pytest.approx(np.log(2), abs=0.03) and got[1] < 0.03
    assert selection.mutual_information(df.where("false")).count() == 0
    assert [r["feature"] for r in selection.univariate(df, "mutual_info", 1).collect()] == [0]
