"""Command line: run the experiment grid over epoch files and write the reports."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.models import MODELS
from .operators.sequence import Alarm
from .plans.experiment import SELECTORS, Settings, alarm_of_best, run_grid, selection_run, significance_run, statistical_validation
from .sources import epoch_files, sinks
from .sources.progress import show


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavemill", description=__doc__)
    p.add_argument("--root", required=True, help="folder with the splits train and eval")
    p.add_argument("--export_dir", default="outputs")
    p.add_argument("--max_channels", default="4", help="comma-separated list")
    p.add_argument("--balance", default="none", help="comma-separated list of none, oversample, undersample")
    p.add_argument("--models", default=",".join(MODELS))
    p.add_argument("--fs", type=float, default=256.0)
    p.add_argument("--limit", "--limit_train", type=int, default=0, help="training epochs, 0: all")
    p.add_argument("--limit_eval", type=int, default=0, help="test epochs, 0: all")
    p.add_argument("--repeats", type=int, default=1)
    p.add_argument("--trees", type=int, default=300)
    p.add_argument("--pca", type=int, default=0, help="component scores in place of features, 0: none")
    p.add_argument("--post_ma", type=int, default=0)
    p.add_argument("--post_kofn", default="")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--beta", type=float, default=2.0)
    p.add_argument("--ch_names", default="", help="comma-separated names in channel order")
    p.add_argument("--ch_names_file", default="", help="text file with a name a line")
    p.add_argument("--channel_estimator", default="linear", choices=["linear", "rf", "svm", "logreg"])
    p.add_argument("--t_on", type=float)
    p.add_argument("--t_off", type=float)
    p.add_argument("--min_consecutive", type=int, default=1)
    p.add_argument("--min_consecutive_on", type=int)
    p.add_argument("--min_consecutive_off", type=int, default=1)
    p.add_argument("--refractory", type=int, default=0)
    p.add_argument("--no_ica", action="store_true")
    p.add_argument("--add_time", action="store_true")
    p.add_argument("--add_stft", action="store_true")
    p.add_argument("--alarm", action="store_true", help="alarms of the best model, from its scores read back")
    p.add_argument("--save_models", action="store_true")
    p.add_argument("--quiet", action="store_true", help="no progress lines")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--stats_metric", default="roc_auc")
    p.add_argument("--n_boot", type=int, default=1000)
    p.add_argument("--n_surrogates", type=int, default=1000)
    p.add_argument("--channel_significance", action="store_true")
    p.add_argument("--feature_significance", action="store_true")
    p.add_argument("--feature_test_type", default="permutation", choices=["permutation", "ablation"])
    p.add_argument("--feature_selection", action="store_true")
    p.add_argument("--fs_method", default="ensemble", choices=sorted(SELECTORS))
    p.add_argument("--fs_k", type=int, default=20)
    p.add_argument("--fs_estimator", default="rf", choices=["rf", "svm", "logreg"])
    p.add_argument("--optimize_k_features", action="store_true")
    p.add_argument("--fs_k_range", default="10,50", help="least and most features")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    words = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    if not a.quiet:
        show()
    spark = SparkSession.builder.appName("wavemill").getOrCreate()
    splits = []
    for split in ("train", "eval"):
        epochs, labels = epoch_files.read_split(spark, a.root, split)
        splits.append(epochs.join(labels.select("epoch_id", "y"), "epoch_id"))
    names = epoch_files.channel_names(spark, splits[0], list(words(a.ch_names)), a.ch_names_file or None)
    on = a.threshold if a.t_on is None else a.t_on
    rule = Alarm(on, a.threshold if a.t_off is None else a.t_off, a.min_consecutive if a.min_consecutive_on is None else a.min_consecutive_on, a.min_consecutive_off, a.refractory)
    s = Settings(
        fs=a.fs, ica=not a.no_ica, add_time=a.add_time, add_stft=a.add_stft, max_channels=tuple(map(int, words(a.max_channels))), balance=words(a.balance), models=words(a.models),
        repeats=a.repeats, trees=a.trees, post_ma=a.post_ma, post_kofn=a.post_kofn, threshold=a.threshold, beta=a.beta, limit=a.limit, limit_eval=a.limit_eval, pca=a.pca,
        channel_estimator=a.channel_estimator, alarm=rule, channel_names={r["channel"]: r["name"] for r in names.collect()},
    )
    reports = {}
    if a.channel_significance or a.feature_significance:
        reports |= significance_run(splits[0], s, a.channel_significance, a.feature_test_type if a.feature_significance else "", min(200, a.n_surrogates))
    if a.feature_selection:
        least, most = map(int, words(a.fs_k_range))
        reports |= selection_run(splits[0], s, a.fs_method, a.fs_k, a.fs_estimator, tuple(range(least, most + 1, 5)) if a.optimize_k_features else ())
    scores = f"{a.export_dir}/scores"
    rows = run_grid(*splits, s, scores if a.alarm else None, f"{a.export_dir}/models" if a.save_models else None)
    sinks.write_json(rows, f"{a.export_dir}/experiments.json")
    sinks.write_csv(rows, f"{a.export_dir}/experiments.csv")
    first = rows.orderBy("repeat", "max_channels").first()
    sinks.write_lines(first["selected_names"], f"{a.export_dir}/selected_channels.txt", spark)
    if a.alarm:
        reports["alarms"] = alarm_of_best(rows, scores, s)
    if a.stats:
        reports |= statistical_validation(rows, f"metric_{a.stats_metric}", a.n_boot)
    for name, table in reports.items():
        sinks.write_json(table, f"{a.export_dir}/{name}.json")


if __name__ == "__main__":
    main()
