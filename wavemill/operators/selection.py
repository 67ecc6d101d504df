"""Feature and channel selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite, ratio
from ..sources.scratch import drop, settle
from .balance import stratified_folds
from .linear import Products, score_candidates
from .metrics import roc_auc
from .models import fit
from .ranks import with_below
from .tabular import column_medians, elect, fill_columns, votes

#: Estimators of selection by cross-validation, as models.fit names them.
ESTIMATORS = {"rf": "rf", "svm": "svm_rbf", "logreg": "logreg"}


def anova_f(rows: DataFrame, feature: str = "feature", value: str = "value", y: str = "y") -> DataFrame:
    """feature, f: one-way ANOVA between the classes; null for a constant feature."""
    v = finite(F.col(value))
    c = rows.groupBy(feature, y).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = c.groupBy(feature).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"))
    between = F.col("m") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("m")
    return t.select(feature, F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"))


def chi2(rows: DataFrame, feature: str = "feature", value: str = "value", y: str = "y") -> DataFrame:
    """feature, chi2 of the absolute values' sums per class against the classes' shares of the rows."""
    c = rows.groupBy(feature, y).agg(F.sum(F.abs(finite(F.col(value)))).alias("o"), F.count(F.lit(1)).alias("n"))
    t = c.groupBy(feature).agg(F.sum("o").alias("all_o"), F.sum("n").alias("all_n"))
    e = F.col("all_o") * F.col("n") / F.col("all_n")
    return c.join(t, feature).groupBy(feature).agg(F.sum(ratio((F.col("o") - e) * (F.col("o") - e), e)).alias("chi2"))


def binned_information(rows: DataFrame, bins: int = 16, feature: str = "feature", value: str = "value", y: str = "y") -> DataFrame:
    """feature, mi (nats) between equal-width bins of the feature and the class: deterministic and one aggregation."""
    v = finite(F.col(value))
    span = rows.groupBy(feature).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    b = F.least(F.floor(ratio(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cells = rows.join(span, feature).where(v.isNotNull()).groupBy(feature, b.alias("b"), y).agg(F.count(F.lit(1)).cast("double").alias("n"))
    nb = cells.groupBy(feature, "b").agg(F.sum("n").alias("nb"))
    ny = cells.groupBy(feature, y).agg(F.sum("n").alias("ny"))
    n = cells.groupBy(feature).agg(F.sum("n").alias("nn"))
    full = cells.join(nb, [feature, "b"]).join(ny, [feature, y]).join(n, feature)
    return full.groupBy(feature).agg(F.sum(F.col("n") / F.col("nn") * F.ln(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))).alias("mi"))


def _digamma(n: Column) -> Column:
    """Digamma of a positive whole number: ten steps up, then the asymptotic series (error under 1e-12)."""
    x = n.cast("double")
    z = x + 10
    q = 1 / (z * z)
    return F.ln(z) - 0.5 / z - q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q / 240))) - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def _radii(cells: DataFrame, by: list[str], neighbours: int, chunk: int) -> DataFrame:
    """cells (a row per group `by` and distinct v, of n points) with k and r: the reach of the k-th nearest point of the group.

    Cells are numbered in their order and looked at in chunks of `chunk`, with as many of the adjoining chunks' cells as a
    point can have neighbours, so no window holds a whole class.
    """
    sizes = cells.groupBy(*by).agg(F.sum("n").alias("class_n")).where("class_n > 1")
    placed = with_below(cells.withColumn("one", F.lit(1)), by, "v", "one", "place").drop("one")
    places = F.array_distinct(F.transform(F.array(*(F.lit(s) for s in (0, -neighbours, neighbours))), lambda s: F.floor((F.col("place") + s) / chunk)))
    near = Window.partitionBy(*by, "at").orderBy("place")
    around = [f(F.struct("v", "n"), i).over(near) for f in (F.lag, F.lead) for i in range(1, neighbours + 1)]
    seen = placed.withColumn("at", F.explode(places)).withColumn("around", F.array(*around)).where(F.col("at") == F.floor(F.col("place") / chunk))
    others = F.flatten(F.transform(F.filter("around", lambda c: c.isNotNull()), lambda c: F.array_repeat(F.abs(c["v"] - F.col("v")), F.least(c["n"], F.lit(neighbours)).cast("int"))))
    own = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(neighbours)).cast("int"))
    k = F.least(F.lit(neighbours), F.col("class_n") - 1)
    found = seen.join(sizes, by).withColumn("k", k).withColumn("d", F.element_at(F.array_sort(F.concat(own, others)), F.col("k").cast("int")))
    # a distance as good as equal to the k-th neighbour's lies outside
    reach = F.greatest(F.col("d") - (F.abs("v") + F.col("d")) * F.lit(2.0**-50), F.lit(0.0))
    return found.select(*by, "v", "n", "class_n", "k", reach.alias("r"))


def mutual_information(rows: DataFrame, neighbours: int = 3, feature: str = "feature", value: str = "value", y: str = "y", chunk: int = 4096) -> DataFrame:
    """feature, mi (nats) between a feature and the class, by distances to nearest neighbours (Ross, 2014).

    A point's reach is the distance to its k-th nearest point of its own class (k at most `neighbours`, and one less than
    the class has); m counts the points of any class that are nearer. mi is the sum of digamma(points) and the means of
    digamma(k) - digamma(class size) - digamma(m), at least 0. Equal values are points at distance 0: nothing is drawn, so
    reruns agree. Points without class or finite value, and classes of one point, are left out; a feature that has nothing
    left gets null. Reach and m come from running counts over distinct values (ranks.py), whatever a feature's size.
    """
    v = finite(F.col(value))
    cells = rows.select(F.col(feature), F.col(y), (v + F.lit(0.0)).alias("v")).where(f"v is not null and {y} is not null").groupBy(feature, y, "v").agg(F.count(F.lit(1)).alias("n"))
    points = settle(_radii(cells, [feature, y], neighbours, chunk).withColumns({"lo": F.col("v") - F.col("r"), "hi": F.col("v") + F.col("r")}))
    marks = points.select(feature, F.explode(F.array(F.struct("v", "n"), F.struct(F.col("lo").alias("v"), F.lit(0).alias("n")), F.struct(F.col("hi").alias("v"), F.lit(0).alias("n")))).alias("c")).select(feature, "c.v", "c.n")
    counted = settle(with_below(marks.groupBy(feature, "v").agg(F.sum("n").alias("n")), [feature], "v", "n"))
    low, high = counted.select(feature, F.col("v").alias("lo"), F.col("below").alias("before")), counted.select(feature, F.col("v").alias("hi"), (F.col("below") + F.col("n")).alias("through"))
    m = points.join(low, [feature, "lo"]).join(high, [feature, "hi"]).withColumn("m", F.col("through") - F.col("before"))
    mean = F.sum(F.col("n") * (_digamma(F.col("k")) - _digamma(F.col("class_n")) - _digamma(F.col("m")))) / F.sum("n")
    found = m.groupBy(feature).agg(F.greatest(_digamma(F.sum("n")) + mean, F.lit(0.0)).alias("mi"))
    return rows.select(feature).distinct().join(found, feature, "left")


def univariate(rows: DataFrame, method: str = "f_classif", k: int = 20) -> DataFrame:
    """method, feature, score of the k best features (ties: smaller index), by index."""
    ways = {"f_classif": (anova_f, "f"), "chi2": (chi2, "chi2"), "mutual_info": (mutual_information, "mi"), "mutual_info_binned": (binned_information, "mi")}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}; known: {sorted(ways)}")
    run, score = ways[method]
    best = run(rows).orderBy(F.desc_nulls_last(score), "feature").limit(k)
    return best.select(F.lit(f"univariate_{method}").alias("method"), "feature", F.col(score).alias("score")).orderBy("feature")


def by_variance(rows: DataFrame, threshold: float = 0.0, feature: str = "feature", value: str = "value") -> DataFrame:
    """feature, variance (population) of the features above the threshold."""
    return rows.groupBy(feature).agg(F.var_pop(finite(F.col(value))).alias("variance")).where(F.col("variance") > threshold)


def cross_validated(rows: DataFrame, names: list[str], candidates: dict[int, list[int] | dict[int, list[int]]], estimator: str, y: str = "y", fold: str = "fold") -> dict[int, float]:
    """Mean held-out ROC-AUC of a classifier of models.MODELS on each candidate set of columns (or sets by fold): a fit per candidate and fold."""
    folds, out = sorted(r[fold] for r in rows.select(fold).distinct().collect()), {}
    for c, wanted in candidates.items():
        scores = []
        for k in folds:
            columns = [names[f] for f in (wanted[k] if isinstance(wanted, dict) else wanted)]
            test = rows.where(F.col(fold) == k)
            scored = fit(ESTIMATORS[estimator], rows.where(F.col(fold) != k), columns, y)(test.select("epoch_id", y, *columns)).select("epoch_id", "y_prob").join(test.select("epoch_id", y), "epoch_id")
            scores += [r["roc_auc"] for r in roc_auc(scored.withColumn("one", F.lit(1)), ["one"], y, "y_prob").collect() if r["roc_auc"] is not None]
        out[c] = float(np.mean(scores)) if scores else float("nan")
    return out


def forward(rows: DataFrame, groups: dict[int, list[int]], names: list[str], most: int, step: int = 1, y: str = "y", fold: str = "fold", estimator: str = "linear") -> list[tuple[int, float]]:
    """Greedy forward selection of groups of columns (a channel's, or one feature each), by cross-validated AUC.

    Each round takes the `step` best groups (ties: smaller key), as long as some score exists; returns (group, score).
    The estimator `linear` (least squares) scores all candidates in one pass; rf, svm and logreg fit each of them.
    """
    chosen = []
    if estimator == "linear":
        products = Products(rows, names, y, fold)
        score = lambda candidates: score_candidates(rows, products, candidates, y, fold)
    else:
        score = lambda candidates: cross_validated(rows, names, candidates, estimator, y, fold)
    while len(chosen) < min(most, len(groups)):
        taken = [g for g, _ in chosen]
        left = [g for g in sorted(groups) if g not in taken]
        scores = score({g: [c for t in [*taken, g] for c in groups[t]] for g in left})
        ok = sorted((-s, g) for g, s in scores.items() if not np.isnan(s))
        if not ok:
            break
        chosen += [(g, -s) for s, g in ok[:step]]
    return chosen


def eliminate(products: Products, down_to: int = 1, without: int | None = None) -> list[int]:
    """Features in the order they are kept longest: the weakest weight goes first. One path serves every size."""
    left, gone = list(range(len(products.names))), []
    while len(left) > down_to:
        gone.append(left.pop(int(np.argmin(products.importance(left, without)))))
    return left + gone[::-1]


def _shrinking(rows: DataFrame, names: list[str], estimator: str, keep: int, share: float, y: str) -> Iterator[list[int]]:
    """The features left before each step, strongest first; the weakest share (at least one) goes after each fit."""
    left = list(range(len(names)))
    while True:
        weight = importances(rows, [names[k] for k in left], estimator, y)
        order = [left[i] for i in np.argsort(-weight, kind="stable")]
        yield order
        if len(left) <= keep:
            return
        left = sorted(order[: max(keep, len(left) - max(1, int(len(left) * share)))])


def eliminate_by(rows: DataFrame, names: list[str], estimator: str, keep: int, share: float = 0.1, y: str = "y") -> list[int]:
    """The `keep` features that are left when the weakest tenth (at least one) goes after each fit, strongest first."""
    *_, last = _shrinking(rows, names, estimator, keep, share, y)
    return last


def eliminate_cv(rows: DataFrame, names: list[str], least: int = 20, estimator: str = "linear", share: float = 0.1, y: str = "y", fold: str = "fold") -> tuple[dict[int, float], dict[int, list[int]], int]:
    """Recursive elimination whose number of features is chosen by cross-validation.

    Each fold has a path of its own, learnt without its rows and scored on them. Returns the mean held-out AUC of each number
    of features from `least` on, the features that the path over all rows keeps at each, and the number with the best mean
    (ties: fewer; numbers without any score lose). Least squares drops one feature a step, and takes two passes over the
    rows for all folds and steps; rf, svm and logreg drop a share a step, and fit twice per fold and step.
    """
    if estimator == "linear":
        products = Products(rows, names, y, fold)
        least, paths = min(least, len(names)), {k: eliminate(products, without=k) for k in products.by_fold}
        scores = score_candidates(rows, products, {n: {k: p[:n] for k, p in paths.items()} for n in range(least, len(names) + 1)}, y, fold)
        whole = eliminate(products)
        kept = {n: whole[:n] for n in scores}
    else:
        folds = sorted(r[fold] for r in rows.select(fold).distinct().collect())
        kept = {len(order): order for order in _shrinking(rows, names, estimator, least, share, y)}
        by_fold = {k: {len(order): order for order in _shrinking(rows.where(F.col(fold) != k), names, estimator, least, share, y)} for k in folds}
        scores = cross_validated(rows, names, {n: {k: by_fold[k][n] for k in folds} for n in kept}, estimator, y, fold)
    best = max(sorted(scores), key=lambda n: -1.0 if np.isnan(scores[n]) else scores[n])
    return scores, kept, best


def best_size(rows: DataFrame, products: Products, sizes: list[int], y: str = "y", fold: str = "fold", estimator: str = "linear") -> tuple[int, dict[int, float]]:
    """The number of features with the best cross-validated AUC along the elimination path (first on ties); the path is that
    of least squares, and the estimator (linear, rf, svm, logreg) scores the sizes."""
    path = eliminate(products)
    candidates = {k: path[:k] for k in sizes if k <= len(path)}
    scores = score_candidates(rows, products, candidates, y, fold) if estimator == "linear" else cross_validated(rows, products.names, candidates, estimator, y, fold)
    return max(sorted(scores), key=lambda k: scores[k]), scores


def importances(rows: DataFrame, names: list[str], estimator: str = "rf", y: str = "y", trees: int = 100, seed: int = 42, fill: dict[str, float] | None = None) -> np.ndarray:
    """A number per column: impurity importance of a forest, or the size of a linear model's weight; gaps count as medians
    (`fill`, where they are known)."""
    data = VectorAssembler(inputCols=names, outputCol="v").transform(fill_columns(rows, column_medians(rows, names) if fill is None else fill)).select("v", F.col(y).cast("double").alias("label"))
    if estimator == "rf":
        return RandomForestClassifier(featuresCol="v", numTrees=trees, seed=seed).fit(data).featureImportances.toArray()
    if estimator == "logreg":
        return np.abs(LogisticRegression(featuresCol="v", elasticNetParam=1.0, regParam=0.01).fit(data).coefficients.toArray())
    if estimator == "svm":
        return np.abs(LinearSVC(featuresCol="v", regParam=0.01).fit(data).coefficients.toArray())
    raise ValueError(f"unknown estimator {estimator!r}; known: logreg, rf, svm")


def model_based(rows: DataFrame, names: list[str], estimator: str = "rf", y: str = "y", trees: int = 100, seed: int = 42, fill: dict[str, float] | None = None) -> DataFrame:
    """method, feature, score of features whose importance is at least the median importance."""
    weight = importances(rows, names, estimator, y, trees, seed, fill)
    cut = float(np.median(weight))
    kept = [(f"model_{estimator}", k, float(w)) for k, w in enumerate(weight) if w >= cut]
    return rows.sparkSession.createDataFrame(kept, "method string, feature int, score double")


def run_methods(rows: DataFrame, wide: DataFrame, names: list[str], methods: list[str], top: int, y: str = "y") -> DataFrame:
    """method, feature, score of every named selector: univariate_<way>, model_<estimator>, rfe_<estimator>,
    elimination (of least-squares weights), variance.

    `rows` is the long form of the columns `names` of `wide`; features are positions in `names`. The medians that fill gaps
    are found once for all models.
    """
    out, fill = None, None
    if any(method.startswith("model_") or method == "elimination" for method in methods):
        fill = column_medians(wide, names)
    for method in methods:
        kind, _, way = method.partition("_")
        if kind == "univariate":
            part = univariate(rows, way, top)
        elif kind == "model":
            part = model_based(wide, names, way, y, fill=fill)
        elif kind == "rfe":
            part = rows.sparkSession.createDataFrame([(method, f, float(top - k)) for k, f in enumerate(eliminate_by(wide, names, way, top, y=y))], "method string, feature int, score double")
        elif method == "elimination":
            path = eliminate(Products(stratified_folds(wide, "epoch_id", 3, y=y), names, y, fill=fill))[:top]
            part = rows.sparkSession.createDataFrame([(method, f, float(top - k)) for k, f in enumerate(path)], "method string, feature int, score double")
        elif method == "variance":
            part = by_variance(rows).select(F.lit(method).alias("method"), "feature", F.col("variance").alias("score"))
        else:
            raise ValueError(f"unknown method {method!r}")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble(rows: DataFrame, wide: DataFrame, names: list[str], methods: list[str], top: int = 20, threshold: float = 0.5, y: str = "y") -> DataFrame:
    """feature, votes: what enough of the methods select, or else the most voted features.

    The wide form is written once, for every pass of the models, and so are the few rows of the votes, which are read thrice.
    """
    wide = settle(wide)
    counted = settle(votes(run_methods(rows, wide, names, methods, top, y), rows, len(methods)))
    drop(wide)
    return elect(counted, threshold, top)
