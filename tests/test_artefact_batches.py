"""Artefact removal of many epochs at once."""

import numpy as np

from wavemill.functions import signal
from wavemill.operators import preprocess


def test_batches_are_as_single_epochs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4, 16))
    x[3, 2] = x[3, 1]
    x[5] = 0
    x[7, 0, 4] = 60
    for got, one in zip(signal.drop_artefacts_each(x, 4), x, strict=True):
        np.testing.assert_allclose(got, signal.drop_artefacts(one, 4), atol=1e-9)
    x[9, 1, 1] = np.nan
    rows = [(e, c, x[e, c].tolist()[: 10 if (e, c) == (11, 2) else 16]) for e in range(40) for c in range(4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")  # epochs are cut by batches
    try:
        got = preprocess.remove_artefacts(spark.createDataFrame(rows, "epoch_id long, channel int, samples array<double>").repartition(5), 4)
        plan = got._jdf.queryExecution().toString()
        found = {(r["epoch_id"], r["channel"]): (r["samples"], r["ica_status"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 160 and "FlatMapGroupsInPandas" not in plan
    assert {e for (e, _), (_, status) in found.items() if status == "left"} == {9, 11}
    for e in set(range(40)) - {9, 11}:
        np.testing.assert_allclose([found[e, c][0] for c in range(4)], signal.drop_artefacts(x[e], 4), atol=1e-9)
    assert found[11, 2][0] == x[11, 2].tolist()[:10]
