"""Queries over whole tables, against plain Python on small tables that go beyond the subsets of the SQL-checked queries."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wavemill.operators.replicates import PRIME, poisson_cuts
from wavemill.plans import catalogue


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def uniform(text):
    return int(md5(text)[:8], 16) / 4294967296


def draw(row, r, seed="0"):
    """The draw of a row in a replicate and its tie-breaking hash."""
    part = lambda text, k: int(md5(text)[8 * k : 8 * k + 8], 16) % PRIME
    h, (b, c, d) = part(f"{seed}|{row}", 0), (part(f"{seed}|{r}", k) for k in range(3))
    return (h * h % PRIME * b + h * c + d) % PRIME, part(f"{seed}|{row}", 1)


def auc(y, p, w=None):
    y, p, w = np.array(y), np.array(p), np.array(w if w is not None else [1] * len(y))
    pos, neg = y == 1, y == 0
    won = (p[pos][:, None] > p[neg][None]) + (p[pos][:, None] == p[neg][None]) / 2
    total = w[pos].sum() * w[neg].sum()
    return (won * np.outer(w[pos], w[neg])).sum() / total if total else math.nan


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """30 events of 10 users with ids from 40 on, 120 customers, 230 embeddings."""
    sf, rng = str(tmp_path_factory.mktemp("sf")), random.Random(6)
    events = [(40 + k, datetime(2024, 1, 1) + timedelta(hours=k), k % 10 + 1, "error" if k % 3 == 0 else "click", float(rng.randint(1, 400))) for k in range(30)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{sf}/events.parquet")
    customers = [(k, f"c{(k * 7) % 120:03d}") for k in range(120)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{sf}/customer.parquet")
    vectors = [(k, [rng.random() for _ in range(64)], rng.randint(0, 9)) for k in range(230)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    return sf, events, customers, vectors


def scores(events):
    return [(f"{u}-{(e - 40) // 10}", v / 500, int(t == "error")) for e, _, u, t, v in events]


def run(spark, name, sf):
    return catalogue.QUERIES[name](spark, sf)


def test_bootstrap(spark, small):
    rows, cuts = scores(small[1]), poisson_cuts()
    got = run(spark, "T1_bootstrap_ci_all", small[0]).first()
    draws = [auc([y for _, _, y in rows], [p for _, p, _ in rows], [sum(draw(i, r)[0] >= c for c in cuts) for i, _, _ in rows]) for r in range(1000)]
    assert got["samples"] == 1000
    assert (got["mean"], got["ci_lo"], got["ci_hi"]) == pytest.approx((np.mean(draws), *np.percentile(draws, [2.5, 97.5])), abs=1e-9)


def test_permutation(spark, small):
    rows = scores(small[1])
    got = run(spark, "T2_permutation_all", small[0]).first()
    y, d = [y for _, _, y in rows], []
    for r in range(1001):
        swap = [r > 0 and 2 * draw(i, r)[0] < PRIME for i, _, _ in rows]
        a, b = zip(*((round(1 - p, 9), p) if s else (p, round(1 - p, 9)) for s, (_, p, _) in zip(swap, rows, strict=True)), strict=True)
        d.append(auc(y, a) - auc(y, b))
    assert got["observed"] == pytest.approx(d[0], abs=1e-9)
    assert got["p"] == pytest.approx((sum(x >= abs(d[0]) for x in d[1:]) + 1) / 1001, abs=0.0011)


def test_surrogates(spark, small):
    rows = scores(small[1])
    got = run(spark, "T5_surrogate_all", small[0]).first()
    null = []
    for r in range(1000):
        least = sorted(range(len(rows)), key=lambda k: draw(rows[k][0], r))[: sum(y for _, _, y in rows)]
        null.append(auc([int(k in least) for k in range(len(rows))], [p for _, p, _ in rows]))
    assert (got["mean"], got["std"]) == pytest.approx((np.mean(null), np.std(null)), abs=1e-9)


def test_knn(spark, small):
    x = np.array([v for _, v, _ in small[3]], np.float32).astype(float)
    x, y = (x - x.mean(0)) / x.std(0), np.array([label >= 5 for _, _, label in small[3]])
    train = [k for k in range(230) if k % 100]
    want = {q: np.mean([y[t] for t in sorted(train, key=lambda t: ((x[q] - x[t]) ** 2).sum())[:7]]) for q in (0, 100, 200)}
    assert {r["epoch_id"]: r["y_prob"] for r in run(spark, "M5_knn_held_out", small[0]).collect()} == pytest.approx(want)


def test_lists_and_order(spark, small):
    got = {r["event_type"]: [float(x) for x in r["values"].split(",")] for r in run(spark, "A2_values_by_type_all", small[0]).collect()}
    assert got == {t: [e[4] for e in small[1] if e[3] == t] for t in ("error", "click")}
    assert [r["c_name"] for r in run(spark, "O1_sorted_names_all", small[0]).collect()] == sorted(n for _, n in small[2])
