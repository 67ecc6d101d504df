"""Selectors on rows of which each misses a feature."""

import math
import random

import numpy as np
import pytest

from wavemill.operators import impact, selection, tabular
from wavemill.operators.balance import stratified_folds
from wavemill.operators.linear import Products, score_candidates

NAMES = [f"f{k}" for k in range(4)]


@pytest.fixture(scope="module")
def tables(spark):
    """Rows with a null, NaN or infinite feature each, far from 0, and the same rows with medians filled in."""
    rng, rows = random.Random(9), []
    for i in range(80):
        x = [100 + rng.gauss(0, 1) for _ in NAMES]
        x[2] += 3 * (i % 2)
        x[(i // 2) % 4] = (None, math.nan, math.inf)[i % 3]
        rows.append([i, i % 2, *x])
    grid = np.array([[v if v is not None else math.nan for v in r[2:]] for r in rows])
    grid[~np.isfinite(grid)] = math.nan
    full = np.where(np.isnan(grid), np.nanmedian(grid, axis=0), grid)
    schema = "epoch_id long, y int, " + ", ".join(f"{n} double" for n in NAMES)
    return tuple(spark.createDataFrame(r, schema) for r in (rows, [[*r[:2], *map(float, v)] for r, v in zip(rows, full, strict=True)]))


def test_model_based(tables):
    for way in ("rf", "logreg"):
        got, want = ({r["feature"]: r["score"] for r in selection.model_based(t, NAMES, way, trees=20).collect()} for t in tables)
        assert got == pytest.approx(want) and max(got, key=got.get) == 2


def test_products_scores_and_impact(tables):
    seen = []
    for t in tables:
        folded = stratified_folds(t, "epoch_id", 3).persist()
        products = Products(folded, NAMES)
        seen.append((products.weights([0, 1, 2, 3]), score_candidates(folded, products, {0: [0, 1], 1: [1, 2, 3]}), {r["feature"]: r["importance"] for r in impact.by_permutation(folded, NAMES, 5).collect()}))
    (w, s, i), (w2, s2, i2) = seen
    assert w == pytest.approx(w2) and s == pytest.approx(s2) and i == pytest.approx(i2)


def test_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert tabular.column_medians(df, ["a", "b"]) == {"a": 1.5, "b": 0.0}
