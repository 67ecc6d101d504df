"""Support-vector machine with an RBF kernel and probabilities.

Rows become Nystroem features of landmark rows (exact where the landmarks are all distinct rows). The machine minimises
|w|^2 / 2 + sum of weight * squared hinge by Newton steps, which end after a few: a pass over the rows sums losses, gradient and
curvature of all machines, tasks add theirs up in a tree, and the driver solves a system as large as the landmarks. Probabilities
are Platt's: a sigmoid fitted to the scores of folds by machines that never saw them.
"""

from __future__ import annotations

import json
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, settle

STEPS = np.array([2.0**-k for k in range(13)] + [0.0])  # shares of a Newton step whose loss every pass looks at


class Kernel:
    """Nystroem features of an RBF kernel, with a constant last."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(self.against(landmarks))
        kept = values > 1e-10 * values.max()
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def against(self, x: np.ndarray) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.landmarks**2).sum(1) - 2 * x @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.against(x) @ self.root, np.ones(len(x))])


class Machine:
    """A fitted machine: scores and probabilities of rows of numbers."""

    def __init__(self, kernel: Kernel, w: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.kernel, self.w, self.slope, self.offset = kernel, w, slope, offset

    def score(self, x: Column) -> Column:
        kernel, w = self.kernel, self.w

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            return pd.Series(kernel(np.stack(rows.to_list())) @ w) if len(rows) else pd.Series([], dtype=float)

        return run(x)

    def probability(self, x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.score(x) * F.lit(self.slope) + F.lit(self.offset))))

    def save(self, path: str) -> None:
        parts = {"landmarks": self.kernel.landmarks.tolist(), "gamma": self.kernel.gamma, "w": self.w.tolist(), "slope": self.slope, "offset": self.offset}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> Machine:
        p = json.loads(SparkSession.getActiveSession().read.text(path).first()["value"])
        return Machine(Kernel(np.array(p["landmarks"]), p["gamma"]), np.array(p["w"]), p["slope"], p["offset"])


def landmark_rows(rows: DataFrame, count: int, seed: int = 42) -> np.ndarray:
    """Up to `count` distinct rows x: those of smallest hash, so that copies take one place."""
    hashed = rows.select("x", F.xxhash64("x", F.lit(seed)).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(count).agg(F.max("h")).first()[0]
    if last is None:
        raise ValueError("no rows to learn from")
    chosen = hashed.where(F.col("h") <= last).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect()  # `count` rows
    return np.array([r["x"] for r in chosen], float)


def tree_sum(parts: DataFrame, partitions: int) -> dict[int, np.ndarray]:
    """Sums by key of rows (key int, v binary of doubles): the square root of the partitions first, then one task."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for key, raw in zip(pdf["key"], pdf["v"]):
                sums[key] = sums.get(key, 0) + np.frombuffer(raw)
        for key, v in sums.items():
            yield pd.DataFrame({"key": [key], "v": [v.tobytes()]})

    for level in [isqrt(partitions)] * (partitions > 16) + [1]:
        parts = parts.repartition(level).mapInPandas(add, "key int, v binary")
    return {r["key"]: np.frombuffer(r["v"]) for r in parts.collect()}  # a row per machine


def sums_at(rows: DataFrame, kernel: Kernel, asked: dict[int, tuple[np.ndarray, np.ndarray]], partitions: int):
    """For each machine k at (w, d), from the rows outside fold k: losses at w + STEPS * d, gradient and curvature at w + d."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            phi, fold = kernel(np.stack(pdf["x"].to_list())), pdf["fold"].to_numpy()
            for k, (w, d) in asked.items():
                mine = fold != k
                p, s, c = phi[mine], pdf["s"].to_numpy()[mine], pdf["weight"].to_numpy()[mine]
                gaps = 1 - (s * (p @ w))[:, None] - (s * (p @ d))[:, None] * STEPS
                loss, gap = np.maximum(gaps, 0) ** 2, np.maximum(gaps[:, 0], 0)
                inside = gap > 0
                gradient = -2 * p.T @ (c * s * gap)
                curvature = 2 * (p[inside].T * c[inside]) @ p[inside]
                sums[k] = sums.get(k, 0) + np.concatenate([c @ loss, gradient, curvature.ravel()])
        for k, v in sums.items():
            yield pd.DataFrame({"key": [k], "v": [v.tobytes()]})

    total = tree_sum(rows.mapInPandas(run, "key int, v binary"), partitions)
    m, t = kernel.root.shape[1] + 1, len(STEPS)
    return {k: (v[:t], v[t : t + m], v[t + m :].reshape(m, m)) for k, v in total.items()}


def train(rows: DataFrame, kernel: Kernel, machines: list[int], most: int = 60) -> dict[int, np.ndarray]:
    """Weights of each machine k, trained on the rows (x, s, weight, fold) outside fold k; all of them in the same passes."""
    m, partitions = kernel.root.shape[1] + 1, rows.rdd.getNumPartitions()
    own = np.r_[np.ones(m - 1), 0.0]  # the constant is free
    at = {k: np.zeros(m) for k in machines}
    open_ = {k: (np.zeros(m), 0.0, False) for k in machines}  # step, the fall it promises, whether no share of one helped
    for _ in range(most):
        found = sums_at(rows, kernel, {k: (at[k], d) for k, (d, _, _) in open_.items()}, partitions)
        for k, (d, promised, failed) in list(open_.items()):
            if k not in found:  # no row is outside this fold
                del open_[k]
                continue
            losses, gradient, curvature = found[k]
            values = losses + ((at[k] + STEPS[:, None] * d) ** 2 @ own) / 2
            if promised > 0 and values[0] > values[-1] - 0.1 * promised + 1e-13 * abs(values[-1]):
                best = STEPS[int(np.argmin(values))]
                at[k] = at[k] + best * d
                if best == 0 and failed:  # no share lowers the loss by what numbers can tell
                    del open_[k]
                else:
                    open_[k] = (np.zeros(m), 0.0, best == 0)
                continue
            at[k] = at[k] + d
            g, h = gradient + own * at[k], curvature + np.diag(own)
            h[-1, -1] += 1e-9 if h[-1, -1] > 0 else 1.0
            step = -np.linalg.solve(h, g)
            if -g @ step < 1e-12 * max(1.0, values[0]):
                del open_[k]
            else:
                open_[k] = (step, -g @ step, failed)
        if not open_:
            return at
    raise RuntimeError(f"machines {sorted(open_)} did not settle in {most} passes")


def fit_machine(rows: DataFrame, landmarks: int = 256, cost: float = 1.0, folds: int = 5, seed: int = 42) -> Machine:
    """The machine of rows (x array<double> without gaps, y 0 or 1, weight). Kernel width: one over the mean squared length of x.

    Landmarks are a bounded sample (the parameter), every row is trained on. Copies of a row share a fold.
    """
    data = settle(
        rows.where("y is not null").select(
            "x", (2.0 * F.col("y") - 1).alias("s"), (F.lit(cost) * F.col("weight")).alias("weight"), F.pmod(F.xxhash64("x", F.lit(seed + 1)), F.lit(folds)).cast("int").alias("fold")
        )
    )
    points = landmark_rows(data, landmarks, seed)
    length = data.agg(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
    kernel = Kernel(points, 1.0 / (length or 1.0))
    weights = train(data, kernel, [-1, *range(folds)])
    out = Machine(kernel, weights[-1])
    score = F.coalesce(*(F.when(F.col("fold") == k, Machine(kernel, w).score(F.col("x"))) for k, w in weights.items() if k >= 0))
    held = settle(data.select("s", score.alias("score")))
    n = {r["s"]: r["count"] for r in held.groupBy("s").count().collect()}  # two rows
    high, low = (n.get(1.0, 0) + 1) / (n.get(1.0, 0) + 2), 1 / (n.get(-1.0, 0) + 2)
    share = F.when(F.col("s") > 0, F.lit(high)).otherwise(F.lit(low))  # Platt's targets, as two weighted rows
    both = held.select(array_to_vector(F.array("score")).alias("v"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), share.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - share).alias("w")))).alias("t"))
    sigmoid = LogisticRegression(featuresCol="v", weightCol="w", maxIter=100, tol=1e-9).fit(both.select("v", "t.label", "t.w"))
    out.slope, out.offset = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
    drop(data), drop(held)
    return out
