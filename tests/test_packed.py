"""AUC from sorted pieces, and the permutation impact that rests on it."""

import numpy as np
import pytest

from wavemill.operators import impact, linear, packed
from wavemill.operators.balance import stratified_folds
from wavemill.operators.linear import Products


def auc(y, s):
    order = np.unique(s, return_inverse=True)[1]
    a, b = np.bincount(order, y == 1), np.bincount(order, y == 0)
    return (a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum())


def test_auc_over_cells_and_pieces(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=(3, 500)), 1), rng.integers(0, 2, 500)
    rows = [r for g in range(3) for lo in range(0, 500, 70) for r in packed.pieces(g, s[g, lo : lo + 70], y[lo : lo + 70], np.array([-0.5, 0.2, 0.2, 1.0]))]
    rows += packed.pieces(0, np.array([np.nan, 9.0]), np.array([1, -1]), np.zeros(0)) + packed.pieces(3, s[0], np.ones(500), np.zeros(0))
    found = {r["g"]: r["roc_auc"] for r in packed.packed_auc(spark.createDataFrame(rows, packed.SCHEMA).repartition(5)).collect()}
    assert found.pop(3) is None
    assert found == pytest.approx({g: auc(y, s[g]) for g in range(3)}, abs=1e-15)


def test_permutation_impact_in_blocks(spark, monkeypatch):
    """As shuffles of whole columns have it; no group sees more rows than a block or a cell."""
    monkeypatch.setattr(impact, "BLOCK", 128)
    monkeypatch.setattr(packed, "CELL", 200)
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 3)) + np.outer(y, [0.0, 0.4, 1.0])
    rows = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(600)], "epoch_id long, y int, a double, b double, c double")
    rows = stratified_folds(rows, "epoch_id", 3).persist()
    got = {r["feature"]: r for r in impact.by_permutation(rows, ["a", "b", "c"], 150).collect()}
    again = {r["feature"]: r for r in impact.by_permutation(rows.repartition(7), ["a", "b", "c"], 150).collect()}
    assert got == {k: pytest.approx(tuple(r)) for k, r in again.items()}
    w = Products(rows, ["a", "b", "c"]).weights([0, 1, 2])
    s = x @ w[:-1] + w[-1]
    for k in range(3):
        want = np.array([auc(y, s) - auc(y, s + w[k] * (x[rng.permutation(600), k] - x[:, k])) for _ in range(600)])
        assert got[k]["baseline"] == pytest.approx(auc(y, s))
        assert abs(got[k]["importance"] - want.mean()) < 5 * want.std() / np.sqrt(150) + 1e-3 and abs(got[k]["std"] / want.std() - 1) < 0.3
    assert got[2]["significant"] and got[2]["importance"] > got[1]["importance"]


def test_fold_scores_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(packed, "CELL", 50)
    rng = np.random.default_rng(5)
    y, x = rng.integers(0, 2, 300), np.round(rng.normal(size=(300, 2)), 1)
    rows = stratified_folds(spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(300)], "epoch_id long, y int, a double, b double"), "epoch_id", 3).persist()
    products = Products(rows, ["a", "b"])
    fold = np.array([r["fold"] for r in rows.orderBy("epoch_id").collect()])
    passed = []
    monkeypatch.setattr(linear, "packed_auc", lambda df: passed.append(df.count()) or packed.packed_auc(df))
    found = linear.fold_scores(rows, products, {7: [0], 9: [0, 1]})
    for name, columns in ((7, [0]), (9, [0, 1])):
        w = [products.weights(columns, without=k) for k in range(3)]
        assert found[name] == pytest.approx([auc(y[fold == k], (x[fold == k][:, columns] * w[k][:-1]).sum(1) + w[k][-1]) for k in range(3)], abs=1e-3)
    assert passed[0] < 300  # a row per piece and cell, where 600 scores were rows


def test_auc_of_sorted_runs():
    """Equal scores may lie in any run and at any cut."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900)
    for s in (np.round(rng.normal(size=900), 1), rng.normal(size=900), np.zeros(900), np.where(rng.random(900) < 0.7, -1.0, rng.normal(size=900))):
        for parts in (1, 2, 7, 300):
            neg, pos = ([np.sort(s[k::parts][y[k::parts] == side]) for k in range(parts)] for side in (0, 1))
            assert packed.auc_of_runs(neg, pos) == pytest.approx(auc(y, s), abs=1e-15)
    assert packed.auc_of_runs([s[:0], s[:0]], [s, s]) is None and packed.auc_of_runs([s], [s[:0]]) is None


def test_permutation_impact_sends_no_scores(spark):
    """What is sent grows with the columns, not with the replicates."""
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 3000), rng.normal(size=(3000, 4))
    rows = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(3000)], "epoch_id long, y int, a double, b double, c double, d double")
    rows = stratified_folds(rows, "epoch_id", 3).persist()
    rows.count()
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        every = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {every.apply(k).stageId(): every.apply(k).shuffleWriteBytes() for k in range(every.size())}

    before = stages()
    got = impact.by_permutation(rows, ["a", "b", "c", "d"], 1000).collect()
    assert len(got) == 4 and sum(v for k, v in stages().items() if k not in before) < 3000 * 5000  # 4,000 scores a row
