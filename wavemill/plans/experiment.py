"""The experiment grid and its statistical validation.

Epochs are preprocessed and turned into features once; every cell of the grid (channels x balance x repeat) and every
model reads that table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import balance, features, impact, linear, metrics, models, preprocess, selection, sequence, stats, tabular
from ..sources import sinks
from ..sources.progress import emit
from ..sources.scratch import drop, settle


@dataclass(frozen=True)
class Settings:
    fs: float = 256.0
    low: float | None = 0.5
    high: float | None = 40.0
    notch_at: float | None = 60.0
    ica: bool = True
    add_time: bool = False
    add_stft: bool = False
    max_channels: tuple[int, ...] = (4,)
    balance: tuple[str, ...] = ("none",)
    repeats: int = 1
    models: tuple[str, ...] = models.MODELS
    trees: int = 300
    post_ma: int = 0
    post_kofn: str = ""
    threshold: float = 0.5
    beta: float = 2.0
    limit: int = 0
    limit_eval: int = 0
    folds: int = 3
    pca: int = 0
    channel_estimator: str = "linear"
    alarm: sequence.Alarm | None = None
    channel_names: dict[int, str] = field(default_factory=dict)

    def name_of(self, channel: int) -> str:
        return self.channel_names.get(channel, f"CH{channel:02d}")


def feature_table(epochs: DataFrame, s: Settings, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Preprocessed epochs with a column per feature, and those columns' names."""
    rows = preprocess.limit_epochs(epochs, s.limit if limit is None else limit)
    if s.low is not None:
        rows = preprocess.preprocess(rows, s.fs, s.low, s.high, s.notch_at, s.ica)
    names = ["perm_ent", "svd_ent", "petrosian_fd", *features.COMPLEXITY, *features.SPECTRAL]
    names += list(arrays.TIME_FEATURES) if s.add_time else []
    names += list(features.STFT) if s.add_stft else []
    return features.extract(rows, s.fs, True, s.add_time, s.add_stft), names


def select_channels(summary: DataFrame, most: int, folds: int, seed: str, estimator: str = "linear") -> list[int]:
    """Greedy forward selection over the channels of a channel summary; every smaller size is a prefix."""
    channels = sorted(r["channel"] for r in summary.select("channel").distinct().collect())
    columns = ["rms", *features.SPECTRAL]
    w = features.wide(summary, columns, channels).join(summary.select("epoch_id", "y").distinct(), "epoch_id")
    names = [c for c in w.columns if c.startswith("ch")]
    w = settle(balance.stratified_folds(w, "epoch_id", folds, seed))
    groups = {c: [names.index(f"ch{c}_{n}") for n in columns] for c in channels}
    chosen = [c for c, _ in selection.forward(w, groups, names, most, estimator=estimator)]
    drop(w)
    return chosen


def _decide(scored: DataFrame, s: Settings) -> DataFrame:
    out = sequence.moving_average(scored, s.post_ma, "y_prob", "series")
    out = sequence.threshold(out, s.threshold, "y_prob", "y_pred")
    return sequence.k_of_n(out, s.post_kofn, "y_pred", "y_pred", "series") if s.post_kofn else out


def _measures(rows: DataFrame) -> dict[str, Column]:
    """What a progress line tells of a table of epochs: rows of the positive class, and those whose cleaning failed."""
    out = {"positive": F.count_if(F.col("y") == 1)}
    return out | ({"failed": F.count_if(F.col("ica_status") == "left")} if "ica_status" in rows.columns else {})


def run_grid(train: DataFrame, test: DataFrame, s: Settings, scores_to: str | None = None, models_to: str | None = None) -> DataFrame:
    """A row per repeat, channel count, balance and model: settings, times, class counts and the twelve metrics.

    With `scores_to`, every model's scores of the test epochs are added to that table; with `models_to`, fitted models
    are saved under it (a nearest-neighbour model as its training rows).
    """
    spark = train.sparkSession
    (tr, names), (te, _) = feature_table(train, s), feature_table(test, s, s.limit_eval)
    tr, te = settle(tr, "train", **_measures(tr)), settle(te, "eval", **_measures(te))
    out = []
    for repeat in range(s.repeats):
        seed = str(42 + repeat)
        chosen = select_channels(features.channel_summary(tr, s.fs), max(s.max_channels), s.folds, seed, s.channel_estimator)
        for k in s.max_channels:
            sel = chosen[:k]
            to_wide = lambda df, sel=sel: features.wide(preprocess.project_channels(df, sel), names, list(range(len(sel)))).join(df.select("epoch_id", "y").distinct(), "epoch_id")
            wide_train, wide_test = to_wide(tr), to_wide(te)
            columns = [c for c in wide_train.columns if c.startswith("ch")]
            if s.pca:
                reduce_ = tabular.fit_components(wide_train, columns, s.pca)
                wide_train, wide_test = reduce_(wide_train), reduce_(wide_test)
                columns = [c for c in wide_train.columns if c.startswith("pca_")]
            for way in s.balance:
                if way not in ("none", "oversample", "undersample"):
                    raise ValueError(f"unknown balance {way!r}; known: none, oversample, undersample")
                fit_on = wide_train if way == "none" else balance.oversample(wide_train, "epoch_id", seed) if way == "oversample" else balance.undersample(wide_train, "epoch_id", seed)
                fit_on = settle(fit_on, f"balance {way}", **_measures(fit_on))
                before, after = (balance.class_counts(d).select("counts").first()["counts"] for d in (wide_train, fit_on))
                for model in s.models:
                    began = perf_counter()
                    fitted = models.fit(model, fit_on, columns, trees=s.trees, seed=42 + repeat)
                    scored = fitted(wide_test)
                    scored = scored.select("epoch_id", "y_prob").join(wide_test.select("epoch_id", F.col("y").alias("y_true")), "epoch_id").withColumn("series", F.lit(0))
                    decided = _decide(scored, s).withColumn("model", F.lit(model))
                    if scores_to:
                        cell = {"repeat": repeat, "max_channels": k, "balance": way}
                        decided = decided.withColumns({c: F.lit(v) for c, v in cell.items()})
                        sinks.write_scores(decided, scores_to, "append" if out else "overwrite")
                        decided = spark.read.parquet(scores_to).where(F.col("model") == model).where(" and ".join(f"{c} = '{v}'" for c, v in cell.items()))
                    if models_to:
                        place = f"{models_to}/{repeat}-{k}-{way}-{model}"
                        fitted.save(place) if fitted.pipeline is not None else fit_on.write.mode("overwrite").parquet(place)
                    row = metrics.compute_metrics(decided, ["model"], s.beta).first()
                    emit({"stage": f"model {model}", "repeat": repeat, "max_channels": k, "balance": way, "seconds": round(perf_counter() - began, 3), "roc_auc": row["roc_auc"]})
                    out.append({"repeat": repeat, "max_channels": k, "selected_channels": sel, "selected_names": [s.name_of(c) for c in sel], "balance": way, "model": model, "time_s": perf_counter() - began, "train_counts_before": before, "train_counts_after": after, **{f"metric_{m}": row[m] for m in row.asDict() if m != "model"}})
                drop(fit_on)
    for table in (tr, te):
        drop(table)
    metric = ", ".join(f"metric_{m} double" for m in ("tp", "tn", "fp", "fn", "accuracy", "precision", "sensitivity", "specificity", "fpr", "f1", "f_beta", "roc_auc"))
    return spark.createDataFrame(out, f"repeat int, max_channels int, selected_channels array<int>, selected_names array<string>, balance string, model string, time_s double, train_counts_before map<int,bigint>, train_counts_after map<int,bigint>, {metric}")


def alarm_of_best(rows: DataFrame, scores_path: str, s: Settings) -> DataFrame:
    """model, epoch_id, y_true, y_prob and alarm of the best row of the grid (by ROC-AUC), from the scores read back."""
    rule = s.alarm or sequence.Alarm(s.threshold, s.threshold)
    best = rows.orderBy(F.desc_nulls_last("metric_roc_auc"), "repeat", "max_channels", "balance", "model").first()
    scores = rows.sparkSession.read.parquet(scores_path).where((F.col("model") == best["model"]) & (F.col("repeat") == best["repeat"]) & (F.col("max_channels") == best["max_channels"]) & (F.col("balance") == best["balance"]))
    given = sequence.alarm(scores, rule, "y_prob", "series")
    return given.join(scores.select("series", "epoch_id", "model", "y_true"), ["series", "epoch_id"]).select("model", "epoch_id", "y_true", "y_prob", "alarm")


def channel_scores(table: DataFrame, names: list[str]) -> DataFrame:
    """channel, epoch_id, y and p: the in-sample probability of a logistic regression on each channel's own features."""
    out = []
    for c in sorted(r["channel"] for r in table.select("channel").distinct().collect()):  # a fit per channel
        own = table.where(F.col("channel") == c).select("epoch_id", "y", *names)
        out.append(models.fit("logreg", own, names)(own).select(F.lit(c).alias("channel"), "epoch_id", "y", F.col("y_prob").alias("p")))
    return reduce(DataFrame.unionByName, out)


def _wide_of(table: DataFrame, names: list[str], channels: list[int]) -> tuple[DataFrame, list[str]]:
    w = features.wide(table, names, channels).join(table.select("epoch_id", "y").distinct(), "epoch_id")
    return w, [c for c in w.columns if c.startswith("ch")]


def significance_run(train: DataFrame, s: Settings, channels: bool = True, by: str = "permutation", n_perm: int = 200) -> dict[str, DataFrame]:
    """Significance of each channel (its own features and fit, label permutations) and of each feature (by permutation
    or ablation), over all training epochs."""
    table, names = feature_table(train, s)
    table = settle(table)
    out = {}
    if channels:
        found = stats.channel_significance(channel_scores(table, names), min(500, n_perm))
        every = sorted(r["channel"] for r in table.select("channel").distinct().collect())
        out["channel_significance"] = found.join(train.sparkSession.createDataFrame([(c, s.name_of(c)) for c in every], "channel int, name string"), "channel")
    if by:
        if by not in ("permutation", "ablation"):
            raise ValueError(f"unknown test {by!r}; known: permutation, ablation")
        w, columns = _wide_of(table, names, sorted(r["channel"] for r in table.select("channel").distinct().collect()))
        folded = settle(balance.stratified_folds(w, "epoch_id", 5))
        found = impact.by_permutation(folded, columns, n_perm) if by == "permutation" else impact.by_ablation(folded, columns)
        named = train.sparkSession.createDataFrame(list(enumerate(columns)), "feature int, name string")
        out["feature_significance"] = found.join(named, "feature").orderBy(F.desc("significant"), F.desc("importance"), "feature")
    return out


SELECTORS = {
    "univariate": ("univariate_f_classif", "univariate_mutual_info", "univariate_chi2"), "rfe": ("rfe_{estimator}",), "model": ("model_{estimator}",),
    "ensemble": ("univariate_f_classif", "rfe_rf", "model_rf"), "sfs": (), "rfecv": (),
}


def selection_run(train: DataFrame, s: Settings, method: str = "ensemble", k: int = 20, estimator: str = "rf", sizes: tuple[int, ...] = ()) -> dict[str, DataFrame]:
    """Channels chosen, then features of those channels chosen by a method (univariate, rfe, rfecv, model, sfs, ensemble), by name;
    with `sizes`, also the number of features with the best cross-validated AUC."""
    if method not in SELECTORS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(SELECTORS)}")
    spark = train.sparkSession
    table, names = feature_table(train, s)
    table = settle(table)
    chosen = select_channels(features.channel_summary(table, s.fs), s.max_channels[0], s.folds, "42", s.channel_estimator)
    w, columns = _wide_of(table, names, sorted(chosen))
    w = settle(w)
    long = w.select("epoch_id", "y", F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)))).alias("x")).select("epoch_id", "y", "x.*")
    filled = tabular.impute_median(long)
    if method == "sfs":
        folded = settle(balance.stratified_folds(w, "epoch_id", s.folds))
        picked = selection.forward(folded, {i: [i] for i in range(len(columns))}, columns, k, estimator=estimator if estimator in selection.ESTIMATORS else "linear")
        found = spark.createDataFrame([("sfs", f, float(score)) for f, score in picked], "method string, feature int, score double")
    elif method == "rfecv":
        folded = settle(balance.stratified_folds(w, "epoch_id", s.folds))
        _, kept, best = selection.eliminate_cv(folded, columns, k, estimator)
        drop(folded)
        found = spark.createDataFrame([("rfecv", f, float(best - place)) for place, f in enumerate(kept[best])], "method string, feature int, score double")
    else:
        found = selection.run_methods(filled, w, columns, [m.format(estimator=estimator) for m in SELECTORS[method]], k)
        if method == "ensemble":
            voted = tabular.elect(tabular.votes(found, filled, len(SELECTORS[method])), 0.3, k)
            found = found.unionByName(voted.select(F.lit("ensemble").alias("method"), "feature", F.col("votes").alias("score")))
    named = spark.createDataFrame(list(enumerate(columns)), "feature int, name string")
    out = {"selected_features": found.join(named, "feature"), "selected_channels": spark.createDataFrame([(i, c, s.name_of(c)) for i, c in enumerate(chosen)], "place int, channel int, name string")}
    if sizes:
        folded = settle(balance.stratified_folds(w, "epoch_id", s.folds))
        best, scores = selection.best_size(folded, linear.Products(folded, columns), [min(n, len(columns)) for n in sizes], estimator=estimator)
        out["sizes"] = spark.createDataFrame([(n, float(v), n == best) for n, v in sorted(scores.items())], "k int, auc double, best boolean")
    return out


def statistical_validation(rows: DataFrame, metric: str = "metric_roc_auc", n_boot: int = 1000) -> dict[str, DataFrame]:
    """Kruskal-Wallis over models, bootstrap intervals, pairwise sign-flip tests (exact for at most 16 cells) and a summary of experiment rows."""
    names = sorted(r["model"] for r in rows.select("model").distinct().collect())
    keys = [c for c in ("repeat", "max_channels", "balance") if c in rows.columns]
    pair = []
    for a, b in combinations(names, 2):
        left = rows.where(F.col("model") == a).select(*keys, F.col(metric).alias("a"))
        right = rows.where(F.col("model") == b).select(*keys, F.col(metric).alias("b"))
        cells = left.join(right, keys).withColumn("cell", F.concat_ws("|", *keys))
        pair.append(stats.sign_flip(cells, "cell").select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "patterns", "p"))
    return {
        "kruskal_wallis": stats.kruskal_wallis(rows, "model", metric),
        "bootstrap": stats.bootstrap_mean(rows, "model", metric, n_boot),
        "pairwise": reduce(DataFrame.unionByName, pair),
        "summary": tabular.summary(rows, "model", metric),
    }
