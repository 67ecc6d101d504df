"""Signals with known properties."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import arrays, signal
from wavemill.operators import features, metrics, preprocess, tabular
from wavemill.plans.experiment import Settings, run_grid
from wavemill.sources import epoch_files, sinks

T = np.arange(1280) / 256


def epochs(spark, *signals):
    return spark.createDataFrame([(i, 0, list(map(float, s))) for i, s in enumerate(signals)], "epoch_id long, channel int, samples array<double>")


def test_sine_is_in_its_band(spark):
    waves = [np.sin(2 * np.pi * f * T) for f in (2, 6, 10, 20)]
    out = features.extract(epochs(spark, *waves), 256.0, time=True, stft=True).orderBy("epoch_id").collect()
    for r, band in zip(out, signal.BANDS, strict=True):
        assert max(signal.BANDS, key=lambda b: r[f"bp_{b}"]) == band
        assert max(signal.BANDS, key=lambda b: r[f"stft_bp_{b}"]) == band
        assert r["rms"] == pytest.approx(1 / np.sqrt(2), abs=1e-6)
        assert r["skew"] == pytest.approx(0, abs=1e-6)
        assert r["kurt"] == pytest.approx(-1.5, abs=1e-6)


def test_ramp_and_constants(spark):
    r = features.extract(epochs(spark, np.arange(64), np.ones(64), np.zeros(64)), 64.0, time=True).orderBy("epoch_id").collect()
    assert r[0]["perm_ent"] == 0 and r[0]["petrosian_fd"] == pytest.approx(1)
    assert r[0]["higuchi_fd"] == pytest.approx(1, abs=1e-9)
    assert r[1]["std"] == 0 and r[1]["skew"] is None and r[2]["svd_ent"] is None


def test_noise_exponents():
    rng = np.random.default_rng(1)
    noise = rng.standard_normal((20, 1280))
    assert np.mean([signal.dfa(x) for x in noise]) == pytest.approx(0.5, abs=0.12)
    assert np.mean([signal.dfa(np.cumsum(x)) for x in noise]) == pytest.approx(1.5, abs=0.15)
    assert np.mean([signal.hurst(x) for x in noise]) == pytest.approx(0.58, abs=0.12)


def test_svd_entropy_matches_decomposition(spark):
    x = np.random.default_rng(2).standard_normal((5, 100))
    got = epochs(spark, *x).select("epoch_id", arrays.svd_entropy(F.col("samples")).alias("v")).orderBy("epoch_id").collect()
    for r, row in zip(got, x, strict=True):
        s = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(row, 3), compute_uv=False)
        s = s / s.sum()
        assert r["v"] == pytest.approx(-(s * np.log2(s)).sum() / np.log2(3), abs=1e-9)


def test_filters(spark):
    ten, sixty = np.sin(2 * np.pi * 10 * T), np.sin(2 * np.pi * 60 * T)
    out = epochs(spark, ten, sixty).withColumn("samples", preprocess.filters(256.0)("samples")).orderBy("epoch_id").collect()
    a, b = np.array(out[0]["samples"]), np.array(out[1]["samples"])
    mid = slice(400, 880)
    assert np.abs(a[mid] - ten[mid]).max() < 0.05  # no lag, no loss
    at_60 = lambda v: np.abs(np.fft.rfft(v[384:896] * np.hanning(512)))[120] / 128
    assert at_60(sixty) == pytest.approx(1, abs=0.01) and at_60(b) < 1e-4
    b_, a_ = signal.band_pass(0.5, 40, 256)
    assert len(b_) == len(a_) == 9 and np.abs(np.roots(a_)).max() == pytest.approx(0.9954, abs=1e-3)
    gain = lambda f: abs(np.polyval(b_, np.exp(2j * np.pi * f / 256)) / np.polyval(a_, np.exp(2j * np.pi * f / 256)))
    assert [gain(0.5), gain(40), gain(10)] == pytest.approx([0.7071, 0.7071, 1.0], abs=1e-3)
    with pytest.raises(ValueError):
        signal.zero_phase(b_, a_, np.zeros((1, 27)))


def test_artefacts_go(spark):
    rng = np.random.default_rng(3)
    clean = rng.uniform(-1, 1, (4, 1280))
    spikes = np.zeros(1280)
    spikes[[100, 700]] = 60
    mixed = clean + np.outer([1, 0.8, 0.6, 0.4], spikes)
    out = signal.drop_artefacts(mixed, 4)
    assert np.abs(out[:, 100]).max() < 15
    df = spark.createDataFrame([(0, c, x.tolist()) for c, x in enumerate(mixed)], "epoch_id long, channel int, samples array<double>")
    assert {r["ica_status"] for r in preprocess.remove_artefacts(df, 4).collect()} == {"cleaned"}


def test_auc_invariants(spark):
    rng = np.random.default_rng(4)
    rows = [("m", int(rng.random() < 0.4), float(rng.integers(0, 9)) / 9) for _ in range(300)]
    df = spark.createDataFrame(rows, "model string, y_true int, y_prob double")
    auc = lambda d: metrics.roc_auc(d, ["model"]).first()["roc_auc"]
    a = auc(df)
    assert auc(df.withColumn("y_prob", -F.col("y_prob"))) == pytest.approx(1 - a)
    assert auc(df.withColumn("y_prob", F.exp("y_prob"))) == pytest.approx(a)
    assert auc(df.withColumn("y_true", F.lit(1))) is None


def test_impute_missing_and_infinite(spark):
    rows = [(0, 0, 1.0), (1, 0, 4.0), (2, 0, 7.0), (0, 1, 2.0), (1, 1, float("nan")), (2, 1, 8.0), (0, 2, 3.0), (1, 2, 6.0), (2, 2, float("inf")), (0, 3, float("nan"))]
    out = {(r["row"], r["feature"]): r["value"] for r in tabular.impute_median(spark.createDataFrame(rows, "row int, feature int, value double")).collect()}
    assert out[1, 1] == 5 and out[2, 2] == 4.5 and out[0, 3] == 0


def _files(root, split, seed):
    rng = np.random.default_rng(seed)
    for r in range(2):
        folder = root / split / "p" / "q" / f"r{r}"
        folder.mkdir(parents=True)
        y = np.arange(20) % 2
        x = rng.standard_normal((20, 3, 128))
        x[:, 1] += np.sin(2 * np.pi * 10 * np.arange(128) / 64) * y[:, None] * 2
        np.save(folder / "s_X.npy", x.astype(np.float32))
        np.save(folder / "s_y.npy", y)
    np.save(root / split / "p" / "q" / "r0" / "alone_X.npy", np.zeros((1, 3, 128)))


def test_epoch_files_and_grid(spark, tmp_path):
    for k, split in enumerate(("train", "eval")):
        _files(tmp_path, split, k)
    data = []
    for split in ("train", "eval"):
        e, y = epoch_files.read_split(spark, f"file://{tmp_path}", split)
        assert y.count() == 40 and e.count() == 120 and e.select("epoch_id").distinct().count() == 40
        data.append(e.join(y.select("epoch_id", "y"), "epoch_id"))
    with pytest.raises(Exception, match="no epoch files|PATH_NOT_FOUND"):
        epoch_files.read_split(spark, f"file://{tmp_path}", "none")
    s = Settings(fs=64.0, low=1.0, high=30.0, notch_at=None, ica=False, max_channels=(1,), balance=("oversample",), models=("logreg", "knn"), post_ma=1)
    out = run_grid(*data, s)
    rows = {r["model"]: r for r in out.collect()}
    assert set(rows) == {"logreg", "knn"} and rows["logreg"]["selected_channels"] == [1]
    assert all(r["metric_roc_auc"] > 0.9 for r in rows.values())
    sinks.write_csv(out, f"{tmp_path}/csv")
    head = spark.read.option("header", True).csv(f"{tmp_path}/csv").columns
    assert "train_counts_before.0" in head


def test_npy_is_not_pickle(spark, tmp_path):
    folder = tmp_path / "t" / "a" / "b" / "c"
    folder.mkdir(parents=True)
    buffer = io.BytesIO()
    np.save(buffer, np.array([{"a": 1}], dtype=object), allow_pickle=True)
    for k in "Xy":
        (folder / f"s_{k}.npy").write_bytes(buffer.getvalue())
    e, _ = epoch_files.read_split(spark, f"file://{tmp_path}", "t")
    with pytest.raises(Exception, match="allow_pickle|pickle"):
        e.collect()


def test_models_save_and_ensemble(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from wavemill.operators import models, selection

    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 5))
    y = (x[:, 2] + 0.3 * rng.standard_normal(120) > 0).astype(int)
    names = [f"f{k}" for k in range(5)]
    wide = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(120)], "epoch_id long, y int, " + ", ".join(f"{n} double" for n in names))
    fitted = models.fit("logreg", wide, names)
    fitted.save(f"{tmp_path}/model")
    assert len(PipelineModel.load(f"{tmp_path}/model").stages) == 2
    with pytest.raises(ValueError):
        models.fit("knn", wide, names).save(f"{tmp_path}/knn")
    long = spark.createDataFrame([(i, int(y[i]), k, float(x[i, k])) for i in range(120) for k in range(5)], "epoch_id long, y int, feature int, value double")
    best = selection.ensemble(long, wide, names, ["univariate_f_classif", "model_logreg", "elimination"], 2).orderBy(F.desc("votes")).first()
    assert best["feature"] == 2 and best["votes"] == 1.0
    with pytest.raises(ValueError):
        selection.run_methods(long, wide, names, ["nothing"], 2)
