"""Nearest neighbours over several blocks and tasks."""

import numpy as np

from wavemill.operators import models


def test_blocks_meet_in_many_tasks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((240, 2)), rng.integers(0, 2, 240)
    rows = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(240)], "epoch_id long, y int, a double, b double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["epoch_id"]: r["y_prob"] for r in models.knn(rows.where("epoch_id % 3 > 0"), rows.where("epoch_id % 3 = 0"), ["a", "b"], block=16).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    train = np.array([k for k in range(240) if k % 3])
    want = {q: y[train[np.argsort(((x[train] - x[q]) ** 2).sum(1), kind="stable")[:7]]].mean() for q in range(0, 240, 3)}
    assert got == want
