"""The `.npy` data source: ranges, filters, pairs, refusals; batched measures against one pair at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import signal
from wavemill.sources import epoch_files, npy_source


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root, rng, data = tmp_path_factory.mktemp("npy"), np.random.default_rng(3), {}
    for k, kind in enumerate(("<f4", ">f8", "<i2")):
        folder = root / "train" / "a" / "b" / f"r{k}"
        folder.mkdir(parents=True)
        x, y = (100 * rng.standard_normal((50 + k, 2, 16))).astype(kind), rng.integers(0, 2, 50 + k)
        np.save(folder / "s_X.npy", x)
        np.save(folder / "s_y.npy", y)
        data[str(folder / "s")] = x.astype(float), y
    np.save(root / "train" / "a" / "b" / "r0" / "alone_X.npy", np.zeros((4, 2, 16)))
    np.save(root / "train" / "deep_X.npy", np.zeros((4, 2, 16)))
    return root, data


def epochs(spark, root, **options):
    npy_source.register(spark)
    return spark.read.format("npy_epochs").options(path=f"{root}/train", suffix="_X.npy", beside="_y.npy", depth=3, **options).load()


def test_files_are_read_by_ranges(spark, files):
    root, data = files
    df = epochs(spark, root, bytes_per_task=5 * 2 * 16 * 4)
    assert df.rdd.getNumPartitions() == 10 + 26 + 6  # five epochs of four bytes, two of eight, ten of two
    got = {(r["recording"], r["file_pos"], r["channel"]): r["samples"] for r in df.collect()}
    assert got == {(name, i, c): x[i, c].tolist() for name, (x, _) in data.items() for i in range(len(x)) for c in range(2)}


def test_filters_reach_the_plan(spark, files):
    root, data = files
    name = sorted(data)[1]
    df = epochs(spark, root, bytes_per_task=5 * 2 * 16 * 8).where((F.col("recording") == name) & (F.col("file_pos") >= 11) & (F.col("file_pos") < 21))
    assert df.rdd.getNumPartitions() == 2
    assert sorted({r["file_pos"] for r in df.collect()}) == list(range(11, 21))
    reader = npy_source.NpyReader({"path": f"{root}/train", "suffix": "_X.npy"}, labels=False)
    assert len(list(reader.pushFilters([npy_source.In(("recording",), (name,)), npy_source.EqualTo(("file_pos",), 3)]))) == 2
    assert [(p.first, p.count) for p in reader.partitions()] == [(3, 1)]


@pytest.mark.parametrize("whole", [False, True])
def test_split_is_the_same_by_ranges_and_by_files(spark, files, whole, monkeypatch):
    root, data = files
    if whole:
        monkeypatch.setattr(npy_source, "opens", lambda address: False)
    x, y = epoch_files.read_split(spark, f"file://{root}", "train")
    labels = {r["epoch_id"]: r["y"] for r in y.collect()}
    assert [labels[i] for i in range(len(labels))] == [int(v) for name in sorted(data) for v in data[name][1]]
    rows = {(r["epoch_id"], r["channel"]): r["samples"] for r in x.collect()}
    assert rows[50, 1] == data[sorted(data)[1]][0][0, 1].tolist() and len(rows) == 2 * len(labels)


def test_refused_files(tmp_path):
    for array, message in ((np.asfortranarray(np.zeros((3, 2, 4))), "Fortran"), (np.zeros((3, 2)), "axes"), (np.array([{"a": 1}], object), "pickle")):
        np.save(tmp_path / "s_X.npy", array, allow_pickle=True)
        with pytest.raises(ValueError, match=message):
            npy_source.NpyReader({"path": str(tmp_path)}, labels=False).partitions()
    assert not npy_source.opens("viewfs://store/in")


def entropy(x, m=2, r=0.2):
    """One pair of templates at a time."""
    tolerance, n = r * (x.std() or 1.0), len(x) - m
    short = long = 0
    for i in range(n):
        for j in range(i + 1, n):
            if max(abs(x[i + k] - x[j + k]) for k in range(m)) <= tolerance:
                short += 1
                long += abs(x[i + m] - x[j + m]) <= tolerance
    return -np.log(long / short) if short and long else np.nan


def test_entropy_of_many_signals(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((20, 60)), np.round(rng.standard_normal((20, 60))), np.zeros((1, 60)), np.cumsum(rng.standard_normal((5, 60)), 1)])
    for pairs in (1 << 21, 50):
        monkeypatch.setattr(signal, "PAIRS", pairs)
        np.testing.assert_allclose(signal.sample_entropy(x), [entropy(row) for row in x], rtol=1e-12, equal_nan=True)


def test_batches_are_their_signals(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((6, 200)), np.ones((1, 200))])
    for measure in (signal.sample_entropy, signal.higuchi, signal.dfa, signal.hurst):
        np.testing.assert_allclose(measure(x), [measure(row) for row in x], rtol=1e-9, equal_nan=True)
        assert np.isnan(measure(np.full(64, np.nan))) and np.isnan(measure(np.zeros(3)))
    n = len(x[0])
    lengths = [[np.abs(np.diff(x[0][m::k][: (n - m - 1) // k + 1])).sum() / k * (n - 1) / (k * ((n - m - 1) // k)) for m in range(k)] for k in range(1, 11)]
    assert signal.higuchi(x[0]) == pytest.approx(np.polyfit(np.log(1 / np.arange(1, 11)), np.log([np.mean(v) for v in lengths]), 1)[0], rel=1e-9)
