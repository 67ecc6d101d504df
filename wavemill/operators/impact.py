"""Impact of features on a fixed least-squares classifier, by permutation and by ablation."""

from __future__ import annotations

import hashlib
import math
import os
import tempfile
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Products, fold_scores
from .metrics import roc_auc
from .packed import auc_of_runs
from .tabular import fill_columns

#: Rows that a column is shuffled among, and that a task holds; tasks at least, for tables of few columns.
BLOCK, TASKS = 1 << 20, 64
PACKED = "task int, block int, h binary, y binary, s binary, t binary"


def _room(n: int, whole: bool) -> np.ndarray:
    """Three rows of n numbers: in memory, or in an unnamed file of the task's temp folder."""
    if whole:
        return np.empty((3, n))
    with tempfile.TemporaryFile() as file:
        os.posix_fallocate(file.fileno(), 0, 24 * n)  # a full disk is told here
        return np.memmap(file, np.float64, "r+", shape=(3, n))


def _in_order(x: np.ndarray) -> np.ndarray:
    """x, sorted in place, without what is not finite."""
    x[~np.isfinite(x)] = np.nan
    x.sort()
    return x[: np.searchsorted(x, np.inf, "right")]


def by_permutation(rows: DataFrame, names: list[str], n_perm: int = 200, seed: str = "42", row_id: str = "epoch_id", y: str = "y", fold: str = "fold") -> DataFrame:
    """feature, baseline, importance (mean loss of AUC when the column is shuffled), its std, p (share of shuffles without
    loss) and significant (p < 0.05).

    The score is a dot product, so a shuffled column only changes its own term. A task gets a column's terms and the scores
    once and makes the replicates itself: no replicate's scores leave their task. Up to BLOCK rows the whole column is
    shuffled, in memory; beyond, the rows are dealt into blocks at random and shuffled within them, one block at a time, and
    the task keeps its numbers in a file. Each replicate's AUC is exact, over all rows (packed.py).
    """
    products = Products(rows, names, y, fold)
    w = products.weights(list(range(len(names))))
    rows = fill_columns(rows, products.fill)
    terms = F.zip_with(F.array(*names), F.array(*(F.lit(float(v)) for v in w[:-1])), lambda x, v: x * v)
    rows = rows.select(F.xxhash64(F.lit(seed), row_id).alias("h"), F.coalesce(F.col(y).cast("int"), F.lit(-1)).alias("y"), terms.alias("terms"))
    score = F.aggregate("terms", F.lit(float(w[-1])), lambda a, t: a + t)
    rows = rows.select("h", "y", score.alias("s"), "terms")
    base = rows.where("y >= 0").select(F.lit(1).alias("one"), "y", "s")
    seen = roc_auc(base, ["one"], "y", "s").first()["roc_auc"]
    n = rows.count()
    blocks = max(1, math.ceil(n / BLOCK))
    shares = max(1, min(n_perm, math.ceil(TASKS / len(names))))  # a column's replicates are shared by so many tasks

    def columns(batches):
        for batch in batches:
            if not len(batch):
                continue
            h, label, s = (np.asarray(batch.column(c)) for c in ("h", "y", "s"))
            label = np.where((label == 0) | (label == 1), label, -1).astype(np.int8)
            term = np.asarray(batch.column("terms").flatten()).reshape(len(s), -1)
            block = (h >> 32) % blocks
            order = np.argsort(block, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
            common = [(int(block[at[0]]), h[at].astype(np.int32).tobytes(), label[at].tobytes(), s[at].tobytes()) for at in parts]
            for k in range(len(names)):
                t = [np.ascontiguousarray(term[at, k]).tobytes() for at in parts]
                out = [(k * shares + j, *c, x) for j in range(shares) for c, x in zip(common, t, strict=True)]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["task", "block", "h", "y", "s", "t"])

    def shuffled(batches):
        cells = ([batch.column(c)[i] for c in range(6)] for batch in batches for i in range(len(batch)))
        packed = ((task.as_py(), block.as_py(), [x.as_buffer() for x in rest]) for task, block, *rest in cells)
        for task, of in groupby(packed, itemgetter(0)):
            k, share = divmod(task, shares)
            rest, own, run = _room(n, blocks == 1)
            dealt, at = [], 0
            for block, part in groupby(of, itemgetter(1)):
                part = [x for _, _, x in part]
                h, label, s, t = (np.concatenate([np.frombuffer(x[c], kind) for x in part]) for c, kind in enumerate((np.int32, np.int8, np.float64, np.float64)))
                order = np.lexsort((t, s, h, label))  # without a label first, then negatives, then positives
                mine = slice(at, at := at + len(t))
                rest[mine], own[mine] = (s - t)[order], t[order]
                rng = np.random.default_rng(list(hashlib.md5(f"{seed}|{task}|{block}".encode()).digest()))
                dealt.append((mine, np.searchsorted(label[order], [0, 1]), rng))
            found = []
            for _ in range(share, n_perm, shares):
                neg, pos = [], []
                for mine, (a, b), rng in dealt:
                    scores = run[mine]
                    scores[:] = rest[mine] + rng.permutation(own[mine])
                    neg.append(_in_order(scores[a:b]))
                    pos.append(_in_order(scores[b:]))
                found.append(auc_of_runs(neg, pos))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(found, pa.float64())], names=["feature", "roc_auc"])

    packed = rows.mapInArrow(columns, PACKED).repartitionById(len(names) * shares, "task").sortWithinPartitions("task", "block")
    auc = packed.mapInArrow(shuffled, "feature int, roc_auc double")
    loss = F.lit(seen) - F.col("roc_auc")
    return auc.groupBy("feature").agg(F.lit(seen).alias("baseline"), F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("std"), (F.count_if(loss <= 0) / F.count(F.lit(1))).alias("p")).withColumn("significant", F.col("p") < 0.05)


def by_ablation(rows: DataFrame, names: list[str], y: str = "y", fold: str = "fold") -> DataFrame:
    """feature, baseline, importance (cross-validated AUC of all features less that without the feature), std over the
    folds, t, p (two-sided, normal) and significant (p < 0.05)."""
    products = Products(rows, names, y, fold)
    every = list(range(len(names)))
    folds = fold_scores(rows, products, {-1: every} | {k: [c for c in every if c != k] for k in every}, y, fold)
    base, out = float(np.mean(folds[-1])), []
    for k in every:
        if folds.get(k):
            gain, std = base - float(np.mean(folds[k])), float(np.std(folds[k]))
            t = gain / (std / math.sqrt(len(folds[k]))) if std > 0 else math.nan
            p = math.erfc(abs(t) / math.sqrt(2)) if std > 0 else float(abs(gain) < 1e-10)
            out.append((k, base, gain, std, t, p, p < 0.05))
    return rows.sparkSession.createDataFrame(out, "feature int, baseline double, importance double, std double, t double, p double, significant boolean")
