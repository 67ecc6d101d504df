"""The sign-flip test beyond 16 pairs."""

import hashlib
import random

import pytest

from wavemill.operators import stats
from wavemill.plans import catalogue
from wavemill.plans.experiment import statistical_validation


def brute(rows, n_perm=1000):
    """(row, a, b): p by the same md5 signs."""
    flip = lambda r, i: int(hashlib.md5(f"42|{r}|{i}".encode()).hexdigest()[:8], 16) / 4294967296 < 0.5
    seen = abs(sum(a - b for _, a, b in rows))
    hits = sum(abs(sum((b - a) if flip(r, i) else (a - b) for i, a, b in rows)) >= seen - 1e-9 for r in range(1, n_perm + 1))
    return (hits + 1) / (n_perm + 1)


def test_any_number_of_pairs(spark):
    rng = random.Random(7)
    rows = [(str(k), rng.random() + 0.1, rng.random()) for k in range(60)]
    gaps = [("x", None, 0.5), ("y", 0.5, float("nan"))]
    df = spark.createDataFrame(rows + gaps, "row string, a double, b double")
    got = stats.sign_flip(df, "row").first()
    assert (got["patterns"], got["p"]) == (1000, pytest.approx(brute(rows)))
    assert 0.001 < got["p"] < 0.9
    assert stats.sign_flip_random(df.limit(0), "row").first()["p"] is None


def test_few_pairs_stay_exact(spark):
    df = spark.createDataFrame([(str(k), float(k + 1), 0.0) for k in range(4)], "row string, a double, b double")
    assert tuple(stats.sign_flip(df, "row").first()) == (16, 0.125)


def test_validation_of_a_grid_of_18_cells(spark):
    rng = random.Random(8)
    rows = [(m, r, c, b, rng.random() + (0.2 if m == "rf" else 0)) for m in ("knn", "rf") for r in range(3) for c in (3, 4, 5) for b in ("none", "oversample")]
    df = spark.createDataFrame(rows, "model string, repeat int, max_channels int, balance string, metric_roc_auc double")
    got = statistical_validation(df, n_boot=50)["pairwise"].collect()
    cell = {m: {f"{r}|{c}|{b}": v for k, r, c, b, v in rows if k == m} for m in ("knn", "rf")}
    assert [(r["model_a"], r["model_b"], r["patterns"]) for r in got] == [("knn", "rf", 1000)]
    assert got[0]["p"] == pytest.approx(brute([(i, a, cell["rf"][i]) for i, a in cell["knn"].items()]))


def test_query_over_whole_series(spark, sf):
    series = {}
    for e in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda e: (e["ts"], e["event_id"])):
        series.setdefault(e["user_id"], []).append(e["value"] / 500)
    rows = [(f"{(u + 1) // 2}-{k}", a, b) for u in series if u % 2 for k, (a, b) in enumerate(zip(series[u], series.get(u + 1, []), strict=False))]
    got = catalogue.QUERIES["T10_signflip_random"](spark, sf).first()
    assert len(rows) > 16 and got["p"] == pytest.approx(brute(rows))
