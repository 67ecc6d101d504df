"""Resampling, scaling, selection, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, impact, linear, metrics, models, selection, tabular
from ..sources import tables
from ..sources.scratch import drop, settle
from .table_queries import ANOVA_SQL, CHI_SQL, GAPS_SQL, _gaps, _labelled
from .views import DOC, FEAT


def oversample(spark, sf_dir):
    return balance.oversample(_labelled(spark, sf_dir), "doc_id").select("doc_id", "y", F.coalesce("draw", F.lit(-1)).alias("draw"))


def undersample(spark, sf_dir):
    return balance.undersample(_labelled(spark, sf_dir), "doc_id")


def subsample(spark, sf_dir):
    return balance.subsample(_labelled(spark, sf_dir), "doc_id", 100)


def folds(spark, sf_dir):
    return balance.stratified_folds(_labelled(spark, sf_dir), "doc_id", 5)


def impute(spark, sf_dir):
    out = tabular.impute_median(_gaps(spark, sf_dir))
    return out.select("epoch_id", "feature", F.round("value", 9).alias("value"))


def standardise(spark, sf_dir):
    out = tabular.standardise(tables.embedding_features(spark, sf_dir))
    return out.groupBy("feature").agg(F.round(F.sum(F.abs("value")), 6).alias("total"), F.round(F.max("value"), 6).alias("top"))


def _wide(spark, sf_dir, width=64):
    """A row per epoch with a column per value; epochs without any value have none."""
    names = [f"f{k}" for k in range(width)]
    e = tables.embedding_epochs(spark, sf_dir).where(F.size("samples") > 0)
    return e.groupBy("epoch_id", "y").agg(*(F.first(F.get("samples", F.lit(k)), ignorenulls=True).alias(c) for k, c in enumerate(names))), names


def components(spark, sf_dir):
    w, names = _wide(spark, sf_dir)
    _, shares = tabular.principal_components(w, names, 4)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(shares)], "component int, share double")


def anova(spark, sf_dir):
    return selection.anova_f(tables.embedding_features(spark, sf_dir)).select("feature", F.round("f", 6).alias("f"))


def chi2(spark, sf_dir):
    return selection.chi2(tables.embedding_features(spark, sf_dir)).select("feature", F.round("chi2", 6).alias("chi2"))


def mutual_information(spark, sf_dir):
    return selection.mutual_information(tables.embedding_features(spark, sf_dir)).select("feature", F.round("mi", 6).alias("mi"))


def binned_information(spark, sf_dir):
    return selection.binned_information(tables.embedding_features(spark, sf_dir)).select("feature", F.round("mi", 6).alias("mi"))


def variance(spark, sf_dir):
    rows = tables.embedding_features(spark, sf_dir)
    return selection.by_variance(rows, 0.01).select("feature", F.round("variance", 9).alias("variance"))


def _standard_wide(spark, sf_dir):
    rows = tables.embedding_features(spark, sf_dir)
    z = tabular.standardise(rows).groupBy("epoch_id", "y").pivot("feature", list(range(64))).agg(F.first("value"))
    names = [f"f{k}" for k in range(64)]
    return z.withColumnsRenamed({str(k): n for k, n in enumerate(names)}), names


def knn(spark, sf_dir):
    z, names = _standard_wide(spark, sf_dir)
    return models.knn(z.where("epoch_id % 100 <> 0"), z.where("epoch_id % 100 = 0"), names).select("epoch_id", F.round("y_prob", 6).alias("y_prob"))


def knn_held_out(spark, sf_dir):
    """A hundredth of the rows, at every table size, against all others."""
    z, names = _standard_wide(spark, sf_dir)
    return models.knn(z.where("epoch_id % 100 <> 0"), z.where("epoch_id % 100 = 0"), names)


METRICS = "model string, tp double, tn double, fp double, fn double, accuracy double, precision double, sensitivity double, specificity double, fpr double, f1 double, f_beta double, roc_auc double"


def _model(name, **options):
    def run(spark, sf_dir):
        w, names = _wide(spark, sf_dir)
        w = balance.stratified_folds(w, "epoch_id", 4)
        w = settle(w)
        train, test = w.where("fold <> 0"), w.where("fold = 0")
        scored = models.fit(name, train, names, **options)(test)
        scored = scored if "y" in scored.columns else scored.join(test.select("epoch_id", "y"), "epoch_id")
        rows = scored.select(F.lit(name).alias("model"), F.col("y").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))
        rows = settle(rows)  # scored once
        found = metrics.compute_metrics(rows, ["model"]).collect()  # one row
        for table in (rows, w):
            drop(table)
        return spark.createDataFrame(found, METRICS)

    return run


def channels(spark, sf_dir):
    """Greedy channel selection over four channels of every embedding."""
    from ..operators.features import SPECTRAL, channel_summary, wide

    e = tables.embedding_epochs(spark, sf_dir, 4)
    columns = ["rms", *SPECTRAL]
    w = wide(channel_summary(e, 16.0), columns, [0, 1, 2, 3])
    names = w.columns[1:]
    w = settle(balance.stratified_folds(w.join(e.select("epoch_id", "y").distinct(), "epoch_id"), "epoch_id", 3))
    groups = {c: [names.index(f"ch{c}_{n}") for n in columns] for c in range(4)}
    chosen = selection.forward(w, groups, names, 8)
    drop(w)
    return spark.createDataFrame([(k, c, float(s)) for k, (c, s) in enumerate(chosen)], "place int, channel int, auc double")


def forward_features(spark, sf_dir):
    w, names = _folded(spark, sf_dir)
    chosen = selection.forward(w, {k: [k] for k in range(len(names))}, names, 20)
    drop(w)
    return spark.createDataFrame([(k, c, float(s)) for k, (c, s) in enumerate(chosen)], "place int, feature int, auc double")


def _folded(spark, sf_dir):
    w, names = _wide(spark, sf_dir)
    return settle(balance.stratified_folds(w, "epoch_id", 3)), names


def permutation_impact(spark, sf_dir):
    return impact.by_permutation(*_folded(spark, sf_dir))


def ablation_impact(spark, sf_dir):
    return impact.by_ablation(*_folded(spark, sf_dir))


def model_based(spark, sf_dir):
    return selection.model_based(*_wide(spark, sf_dir), "rf")


def elimination(spark, sf_dir):
    w, names = _folded(spark, sf_dir)
    products = linear.Products(w, names)
    drop(w)
    return spark.createDataFrame(list(enumerate(selection.eliminate(products))), "place int, feature int")


def elimination_cv(spark, sf_dir):
    """Every number of features from 20 on, what is kept at it, and whether it is the one chosen."""
    w, names = _folded(spark, sf_dir)
    scores, kept, best = selection.eliminate_cv(w, names)
    drop(w)
    return spark.createDataFrame([(n, float(scores[n]), n == best, kept[n]) for n in sorted(scores)], "size int, auc double, chosen boolean, features array<int>")


def best_size(spark, sf_dir):
    w, names = _folded(spark, sf_dir)
    best, scores = selection.best_size(w, linear.Products(w, names), list(range(10, 51, 5)))
    drop(w)
    return spark.createDataFrame([(k, float(s), k == best) for k, s in sorted(scores.items())], "k int, auc double, best boolean")


def ensemble(spark, sf_dir):
    """Votes of every kind of selector; at least half of them, or the most voted."""
    rows = tables.embedding_features(spark, sf_dir)
    w, names = _wide(spark, sf_dir)
    methods = ["univariate_f_classif", "univariate_chi2", "univariate_mutual_info", "model_rf", "model_logreg", "elimination"]
    return selection.ensemble(rows, w, names, methods, 20)


QUERIES = {
    "R1_oversample": oversample, "R2_undersample": undersample, "R3_median_impute": impute, "R4_standardise": standardise, "R5_pca": components, "R6_subsample": subsample, "R7_folds": folds,
    "C1_channel_selection": channels, "C2_anova_f": anova, "C3_chi2": chi2, "C4_mutual_information": mutual_information, "C4_binned_information": binned_information, "C5_elimination": elimination, "C5_elimination_cv": elimination_cv, "C6_model_based": model_based, "C7_variance": variance, "T6_permutation_impact": permutation_impact, "T7_ablation_impact": ablation_impact,
    "C8_forward_selection": forward_features, "C9_ensemble": ensemble, "C10_best_size": best_size, "M1_logreg": _model("logreg"), "M2_svm_rbf": _model("svm_rbf"), "M3_random_forest": _model("rf"),
    "M4_gradient_boosting": _model("gb"), "M5_knn": knn, "M5_knn_held_out": knn_held_out,
}
_L = "l AS (SELECT doc_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42|' || doc_id), doc_id) - 1) AS r FROM doc), n AS (SELECT y, count(*) AS n FROM doc GROUP BY y)"
ORACLE_SQL = {
    "R1_oversample": f"""WITH {DOC}, {_L}, d AS (SELECT y, n, unnest(range((SELECT max(n) FROM n) - n)) AS draw FROM n),
 e AS (SELECT y, draw, floor(('0x' || substr(md5('42|' || y || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS r FROM d)
 SELECT doc_id, y, -1::BIGINT AS draw FROM doc UNION ALL SELECT l.doc_id, l.y, e.draw FROM e JOIN l ON l.y = e.y AND l.r = e.r""",
    "R2_undersample": f"WITH {DOC}, {_L} SELECT doc_id, y FROM l WHERE r < (SELECT min(n) FROM n)",
    "R6_subsample": f"WITH {DOC} SELECT doc_id, y FROM doc ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
    "R7_folds": f"WITH {DOC}, {_L} SELECT doc_id, y, (r % 5)::INT AS fold FROM l",
    "R3_median_impute": f"WITH {GAPS_SQL}, m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM gap GROUP BY feature) SELECT epoch_id, gap.feature, round(coalesce(value, median, 0), 9) AS value FROM gap JOIN m ON m.feature = gap.feature",
    "R4_standardise": f"""WITH {FEAT}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY feature), z AS (SELECT feat.feature, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM feat JOIN s ON s.feature = feat.feature)
 SELECT feature, round(sum(abs(v)), 6) AS total, round(max(v), 6) AS top FROM z GROUP BY feature""",
    "C2_anova_f": f"WITH {FEAT}, {ANOVA_SQL} SELECT feature, round(f, 6) AS f FROM af",
    "C3_chi2": f"WITH {FEAT}, {CHI_SQL} SELECT feature, round(chi2, 6) AS chi2 FROM cs",
    "C4_mutual_information": f"""WITH {FEAT}, own AS (SELECT feature, y, value, count(*) OVER (PARTITION BY feature, y) AS nc,
        [lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS near
        FROM feat WINDOW w AS (PARTITION BY feature, y ORDER BY value)),
        kth AS (SELECT feature, value, nc, least(3, nc - 1) AS k, list_sort([abs(u - value) FOR u IN near IF u IS NOT NULL])[least(3, nc - 1)] AS d FROM own WHERE nc > 1),
        reach AS (SELECT *, greatest(d - (abs(value) + d) * pow(2.0, -50), 0) AS r FROM kth),
        met AS (SELECT feature, nc, k, count(*) OVER (PARTITION BY feature ORDER BY value RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m, count(*) OVER (PARTITION BY feature) AS nn FROM reach),
        psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.57721566490153286 AS v FROM (SELECT unnest(range(1, (SELECT max(nn) + 1 FROM met))) AS i))
        SELECT feature, round(greatest(avg(pn.v + pk.v - pc.v - pm.v), 0), 6) AS mi FROM met JOIN psi pn ON pn.i = nn JOIN psi pk ON pk.i = k JOIN psi pc ON pc.i = nc JOIN psi pm ON pm.i = m GROUP BY feature""",
    "C4_binned_information": f"""WITH {FEAT}, s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feat GROUP BY feature), b AS (SELECT feat.feature, y, least(floor((value - lo) / (hi - lo) * 16), 15) AS b FROM feat JOIN s ON s.feature = feat.feature),
 c AS (SELECT feature, b, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM c)
 SELECT feature, round(sum(n / nn * ln(n * nn / (nb * ny))), 6) AS mi FROM t GROUP BY feature""",
    "C7_variance": f"WITH {FEAT} SELECT feature, round(var_pop(value), 9) AS variance FROM feat GROUP BY feature HAVING var_pop(value) > 0.01",
    "M5_knn": f"""WITH {FEAT}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY feature), z AS (SELECT epoch_id, y, list((value - m) / s ORDER BY feat.feature) AS v FROM feat JOIN s ON s.feature = feat.feature GROUP BY epoch_id, y),
 d AS (SELECT q.epoch_id, t.epoch_id AS t, t.y, list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1] - p[2]) ** 2)) AS d FROM z q JOIN z t ON q.epoch_id % 100 = 0 AND t.epoch_id % 100 <> 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY d, t) AS r FROM d) SELECT epoch_id, round(avg(y), 6) AS y_prob FROM k WHERE r <= 7 GROUP BY epoch_id""",
}
