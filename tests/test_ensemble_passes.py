"""The ensemble of selectors reads its tables a fixed number of times."""

import numpy as np

from wavemill.operators import selection
from wavemill.operators import tabular


def test_votes_and_medians_are_found_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 4)) + np.outer(y, [0, 2, 0, 1])
    wide = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(200)], "epoch_id long, y int, a double, b double, c double, d double")
    rows = spark.createDataFrame([(k, int(y[k]), f, float(x[k, f])) for k in range(200) for f in range(4)], "epoch_id long, y int, feature int, value double")
    calls = []
    counted = lambda *args: calls.append(1) or tabular.column_medians(*args)
    monkeypatch.setattr(selection, "column_medians", counted)
    monkeypatch.setattr("wavemill.operators.linear.column_medians", counted)
    methods = ["univariate_f_classif", "univariate_chi2", "model_logreg", "elimination"]
    got = selection.ensemble(rows, wide, ["a", "b", "c", "d"], methods, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature"] for r in got.collect()} >= {1, 3}
    assert len(calls) == 1  # a time per model before
    assert "LogicalRDD" not in plan and "Generate" not in plan and plan.count("Relation [feature") >= 1
