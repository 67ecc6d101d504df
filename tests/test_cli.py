"""The command line over epoch files: grid, alarms, significance, selection, and what is written."""

import json

import numpy as np
import pytest

from wavemill import cli
from wavemill.operators import features


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two recordings a split, three channels; the second tells the classes apart."""
    top, rng = tmp_path_factory.mktemp("epochs"), np.random.default_rng(5)
    t = np.arange(128) / 64
    for split in ("train", "eval"):
        for rec in range(2):
            folder = top / split / "a" / "b" / "c"
            folder.mkdir(parents=True, exist_ok=True)
            y = np.arange(16) % 2
            x = rng.normal(size=(16, 3, 128))
            x[:, 1] += np.where(y == 1, 4, 0)[:, None] * np.sin(2 * np.pi * 10 * t)
            np.save(folder / f"r{rec}_X.npy", x)
            np.save(folder / f"r{rec}_y.npy", y)
    (top / "names.txt").write_text("left\nmiddle\nright\n")
    return top


def rows(folder):
    return [json.loads(line) for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_whole_run(spark, root):
    out = root / "out"
    cli.main(["--root", str(root), "--export_dir", str(out), "--fs", "64", "--no_ica", "--max_channels", "1", "--models", "logreg", "--pca", "3", "--ch_names_file", str(root / "names.txt"), "--alarm", "--save_models", "--min_consecutive_on", "1",
              "--channel_significance", "--feature_significance", "--n_surrogates", "10", "--feature_selection", "--fs_method", "univariate", "--fs_k", "5", "--optimize_k_features", "--fs_k_range", "5,10"])
    grid = rows(out / "experiments.json")
    assert {r["model"] for r in grid} == {"logreg"} and all(r["selected_names"] == ["middle"] and r["metric_roc_auc"] > 0.9 for r in grid)
    assert "middle" in "".join(p.read_text() for p in (out / "selected_channels.txt").glob("part-*"))
    alarms = rows(out / "alarms.json")
    assert len(alarms) == 32 and np.mean([r["alarm"] == r["y_true"] for r in alarms]) > 0.8
    assert {p.name for p in (out / "models").iterdir()} == {"0-1-none-logreg"}
    assert spark.read.parquet(str(out / "scores")).count() == 32
    channels = {r["name"]: r for r in rows(out / "channel_significance.json")}
    assert set(channels) == {"left", "middle", "right"} and channels["middle"]["roc_auc"] > 0.95
    impact = rows(out / "feature_significance.json")
    assert len(impact) == 33 and all({"name", "baseline", "importance", "std", "p", "significant"} <= set(r) for r in impact)
    selected = rows(out / "selected_features.json")
    assert {r["method"] for r in selected} == {"univariate_f_classif", "univariate_mutual_info", "univariate_chi2"} and all(r["name"].startswith("ch") for r in selected)
    assert [r["k"] for r in rows(out / "sizes.json")] == [5, 10]


def test_features_from_sql(spark):
    features.register(spark, 64.0)
    r = spark.sql("select band_powers(x).bp_alpha as a, complexity(x).sampen as s from (select transform(sequence(0, 127), k -> sin(2 * pi() * 10 * k / 64)) as x)").first()
    assert r["a"] > 0
