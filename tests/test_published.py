"""Published experiment rows and statistics (fixed values)."""

import pytest
from pyspark.sql import functions as F

from wavemill.operators import metrics, stats, tabular
from wavemill.plans.experiment import statistical_validation

#: model, channels, balance, roc_auc, accuracy, f_beta (beta 2), tp, tn, fp, fn
ROWS = [
    ("logreg", 3, "none", 0.4242857142857143, 0.46, 0.41907514450867056, 29.0, 63.0, 77.0, 31.0),
    ("svm_rbf", 3, "none", 0.47714285714285715, 0.7, 0.0, 0.0, 140.0, 0.0, 60.0),
    ("rf", 3, "none", 0.5588095238095239, 0.69, 0.0, 0.0, 138.0, 2.0, 60.0),
    ("gb", 3, "none", 0.5086904761904762, 0.68, 0.11718750000000001, 6.0, 130.0, 10.0, 54.0),
    ("knn", 3, "none", 0.42821428571428577, 0.67, 0.04, 2.0, 132.0, 8.0, 58.0),
    ("logreg", 3, "oversample", 0.4067857142857143, 0.485, 0.3880597014925373, 26.0, 71.0, 69.0, 34.0),
    ("svm_rbf", 3, "oversample", 0.4622619047619048, 0.61, 0.24475524475524474, 14.0, 108.0, 32.0, 46.0),
    ("rf", 3, "oversample", 0.4963095238095238, 0.685, 0.0796812749003984, 4.0, 133.0, 7.0, 56.0),
    ("gb", 3, "oversample", 0.5310714285714285, 0.69, 0.22556390977443608, 12.0, 126.0, 14.0, 48.0),
    ("knn", 3, "oversample", 0.42434523809523805, 0.56, 0.28145695364238416, 17.0, 95.0, 45.0, 43.0),
    ("logreg", 4, "none", 0.5254761904761904, 0.57, 0.49698795180722893, 33.0, 81.0, 59.0, 27.0),
    ("svm_rbf", 4, "none", 0.5877380952380953, 0.7, 0.0, 0.0, 140.0, 0.0, 60.0),
    ("rf", 4, "none", 0.6072619047619047, 0.695, 0.0, 0.0, 139.0, 1.0, 60.0),
    ("gb", 4, "none", 0.5367857142857143, 0.705, 0.1568627450980392, 8.0, 133.0, 7.0, 52.0),
    ("knn", 4, "none", 0.44202380952380954, 0.655, 0.03952569169960474, 2.0, 129.0, 11.0, 58.0),
    ("logreg", 4, "oversample", 0.49488095238095237, 0.53, 0.4367469879518072, 29.0, 77.0, 63.0, 31.0),
    ("svm_rbf", 4, "oversample", 0.5838095238095238, 0.65, 0.2517985611510791, 14.0, 116.0, 24.0, 46.0),
    ("rf", 4, "oversample", 0.5777976190476191, 0.7, 0.08064516129032256, 4.0, 136.0, 4.0, 56.0),
    ("gb", 4, "oversample", 0.6047619047619048, 0.68, 0.07936507936507936, 4.0, 132.0, 8.0, 56.0),
    ("knn", 4, "oversample", 0.40892857142857136, 0.545, 0.24916943521594687, 15.0, 94.0, 46.0, 45.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "model string, max_channels int, balance string, metric_roc_auc double, accuracy double, f_beta double, tp double, tn double, fp double, fn double")


def test_metrics_follow_from_the_confusion_cells(spark, rows):
    got = {(r["model"], r["max_channels"], r["balance"]): r for r in metrics.rates(rows.drop("accuracy", "f_beta")).collect()}
    for model, channels, balance, _, accuracy, f_beta, *_ in ROWS:
        r = got[model, channels, balance]
        assert r["accuracy"] == pytest.approx(accuracy, abs=1e-12)
        assert r["f_beta"] == pytest.approx(f_beta, abs=1e-12)


def test_kruskal_wallis(rows):
    r = stats.kruskal_wallis(rows, "model", "metric_roc_auc").first()
    assert r["h"] == pytest.approx(11.171428571428564, abs=1e-9)
    assert r["p"] == pytest.approx(0.024703471843335035, abs=1e-9)
    assert r["groups"] == 5


def test_summary(rows):
    r = {x["model"]: x for x in tabular.summary(rows, "model", "metric_roc_auc").collect()}["rf"]
    assert (r["mean"], r["std"], r["median"], r["n"]) == pytest.approx((0.5600446429, 0.0406458144, 0.5683035714, 4))


def test_validation_bundle(rows):
    out = statistical_validation(rows, n_boot=400)
    pairs = {(r["model_a"], r["model_b"]): r["p"] for r in out["pairwise"].collect()}
    assert pairs["logreg", "svm_rbf"] == pytest.approx(0.125)
    assert pairs["rf", "svm_rbf"] == pytest.approx(0.25)
    assert pairs["gb", "rf"] == pytest.approx(0.625)
    ci = {r["model"]: r for r in out["bootstrap"].collect()}["logreg"]
    assert ci["ci_lo"] == pytest.approx(0.4155, abs=0.01) and ci["ci_hi"] == pytest.approx(0.5102, abs=0.01)


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(11.171428571428564, 4), (3.841458820694124, 1), (7.814727903251179, 3), (0.0, 2)], "x double, k int")
    got = [r[0] for r in df.select(stats.chi2_tail(F.col("x"), F.col("k"))).collect()]
    assert got == pytest.approx([0.024703471843335035, 0.05, 0.05, 1.0], abs=1e-9)
