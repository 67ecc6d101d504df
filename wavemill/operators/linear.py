"""Weighted least-squares classifiers from summed cross products.

One pass sums the cross products of all features, per fold; the classifier of any subset of features on any folds is then
solved on the driver from that small matrix (features squared, whatever the number of rows), and one further pass scores
all candidates at once. Feature and channel selection stay a few passes over the data instead of a fit per candidate.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import SCHEMA, cells_for, packed_auc, pieces
from .tabular import column_medians, fill_columns


class Products:
    """Cross products (with a constant) per fold and class; gaps count as the column's median."""

    def __init__(self, rows: DataFrame, names: list[str], y: str = "y", fold: str = "fold", fill: dict[str, float] | None = None):
        self.names = names
        self.fill = column_medians(rows, names) if fill is None else fill
        m = len(names) + 2

        def partial(parts):
            sums: dict[int, np.ndarray] = {}
            for pdf in parts:
                x = np.column_stack([pdf[names].to_numpy(float), np.ones(len(pdf)), 2.0 * pdf[y].to_numpy(float) - 1])
                for k in np.unique(pdf[fold]):
                    part = x[(pdf[fold] == k).to_numpy()]
                    sums[k] = sums.get(k, 0) + part.T @ part
            for k, s in sums.items():
                yield pd.DataFrame({"fold": [int(k)], "g": [s.ravel().tolist()]})

        partials = fill_columns(rows, self.fill).select(*names, y, fold).where(F.col(y).isNotNull()).mapInPandas(partial, "fold int, g array<double>")
        total = partials.select("fold", F.posexplode("g").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
        self.by_fold = {}
        for r in total.toLocalIterator():  # folds x features^2 numbers
            self.by_fold.setdefault(r["fold"], np.zeros(m * m))[r["i"]] = r["v"]
        self.by_fold = {k: v.reshape(m, m) for k, v in self.by_fold.items()}

    def weights(self, features: list[int], without: int | None = None, ridge: float = 1e-3) -> np.ndarray:
        """Weights of the features on standardised scale and a constant, from all folds but one."""
        g = sum(v for k, v in self.by_fold.items() if k != without)
        c = len(self.names)
        n = g[c, c]
        mean = g[features, c] / n
        spread = np.sqrt(np.maximum(np.diag(g)[features] / n - mean**2, 0))
        spread[spread < 1e-12] = 1
        a = (g[np.ix_(features, features)] / n - np.outer(mean, mean)) / np.outer(spread, spread)
        b = (g[features, c + 1] / n - mean * g[c, c + 1] / n) / spread
        w = np.linalg.solve(a + ridge * np.eye(len(features)), b)
        return np.r_[w / spread, g[c, c + 1] / n - (w / spread) @ mean]

    def importance(self, features: list[int], without: int | None = None) -> np.ndarray:
        """Size of each feature's weight on standardised scale, from all folds but one."""
        g = sum(v for k, v in self.by_fold.items() if k != without)
        c = len(self.names)
        n = g[c, c]
        spread = np.sqrt(np.maximum(np.diag(g)[features] / n - (g[features, c] / n) ** 2, 0))
        return np.abs(self.weights(features, without)[:-1]) * spread


def score_candidates(rows: DataFrame, products: Products, candidates: dict[int, list[int] | dict[int, list[int]]], y: str = "y", fold: str = "fold") -> dict[int, float]:
    """Mean held-out ROC-AUC over the folds of each candidate set of features, all in one pass."""
    scores = fold_scores(rows, products, candidates, y, fold)
    return {c: float(np.mean(scores[c])) if scores.get(c) else float("nan") for c in candidates}


def fold_scores(rows: DataFrame, products: Products, candidates: dict[int, list[int] | dict[int, list[int]]], y: str = "y", fold: str = "fold") -> dict[int, list[float]]:
    """Held-out ROC-AUC of each candidate (features, or features by fold) on each fold that has both classes."""
    table = {}
    for c, wanted in candidates.items():
        for k in products.by_fold:
            features = wanted[k] if isinstance(wanted, dict) else wanted
            w = products.weights(features, without=k)
            full = np.zeros(len(products.names) + 1)
            full[features], full[-1] = w[:-1], w[-1]
            table[c, k] = full
    names, known, folds = products.names, list(candidates), list(products.by_fold)
    total = sum(products.by_fold.values())
    c = len(names)
    edges = {}
    for (candidate, k), w in table.items():  # cells of about the same number of scores, were they normal
        cells = cells_for(products.by_fold[k][c, c])
        mean = w @ total[: c + 1, c] / total[c, c]
        std = math.sqrt(max(w @ total[: c + 1, : c + 1] @ w / total[c, c] - mean**2, 0.0))
        edges[candidate, k] = np.array([mean + std * NormalDist().inv_cdf(i / cells) for i in range(1, cells)])

    def run(parts):
        for pdf in parts:
            x, label = np.column_stack([pdf[names].to_numpy(float), np.ones(len(pdf))]), pdf[y].to_numpy()
            out = []
            for j, k in enumerate(folds):
                at = (pdf[fold] == k).to_numpy()
                mine, of = x[at], label[at]
                for i, candidate in enumerate(known):
                    out += pieces(i * len(folds) + j, (mine * table[candidate, k]).sum(1), of, edges[candidate, k])
            yield pd.DataFrame(out, columns=["g", "cell", "v", "pos", "neg"])

    packed = fill_columns(rows, products.fill).select(*names, y, fold).where(F.col(y).isNotNull()).mapInPandas(run, SCHEMA)
    found = {r["g"]: r["roc_auc"] for r in packed_auc(packed).where("roc_auc is not null").collect()}  # a row per candidate and fold
    out: dict[int, list[float]] = {}
    for i, candidate in enumerate(known):
        scores = [found[g] for _, g in sorted((k, i * len(folds) + j) for j, k in enumerate(folds)) if g in found]
        if scores:
            out[candidate] = scores
    return out
