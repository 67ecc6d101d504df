"""Medians of many columns, from brackets, and the wide table, without a row per value."""

import random
import statistics

from wavemill.operators import tabular
from wavemill.plans import learning_queries


def test_medians_of_columns_order_few_values(spark, monkeypatch):
    """The exact median, whatever the values, of which only those near it are put in order."""
    rng, inf = random.Random(5), float("inf")
    columns = {
        "spread": [rng.gauss(0, 1) for _ in range(4000)],
        "even": [float(k) for k in range(4000)],
        "ties": [float(rng.choice([0, 0, 0, 1])) for _ in range(4000)],
        "two": [1.0, 2.0] * 2000,
        "holes": [rng.choice([None, inf, -inf, float("nan"), rng.random()]) for _ in range(4000)],
        "one": [3.5] + [None] * 3999,
        "none": [None] * 4000,
    }
    rows = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    kept = {c: [v for v in values if v is not None and abs(v) < inf] for c, values in columns.items()}
    want = {c: statistics.median(values) if values else 0.0 for c, values in kept.items()}
    ordered, with_below = [], tabular.ranks.with_below
    monkeypatch.setattr(tabular.ranks, "with_below", lambda counts, *a: ordered.append(counts.count()) or with_below(counts, *a))
    assert tabular.column_medians(rows, list(columns)) == want
    assert sum(ordered) < 1500
    monkeypatch.setattr(tabular, "BRACKET", 0.0)  # brackets that miss most medians
    assert tabular.column_medians(rows, list(columns)) == want
    assert tabular.column_medians(rows.where("false"), list(columns)) == dict.fromkeys(columns, 0.0)


def test_wide_table_of_odd_embeddings(spark, tmp_path):
    """Short, empty and missing embeddings, as the pivot of their values gives them; values are not moved one by one."""
    rows = [(1, [1.0, 2.0], 7), (2, [], 3), (3, None, 4), (4, [None, 5.0, 6.0], None), (5, [float(k) for k in range(70)], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    w, names = learning_queries._wide(spark, str(tmp_path))
    got = {r["epoch_id"]: (r["y"], [r[c] for c in names]) for r in w.collect()}
    assert got == {1: (1, [1.0, 2.0] + [None] * 62), 4: (None, [None, 5.0, 6.0] + [None] * 61), 5: (0, [float(k) for k in range(64)])}
    assert "Generate" not in w._jdf.queryExecution().toString()
