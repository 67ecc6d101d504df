"""The five classifiers, on Spark ML where it has them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite
from .kernel_svm import Machine, fit_machine
from .tabular import column_medians, fill_columns

MODELS = ("logreg", "svm_rbf", "rf", "gb", "knn")


def fit_scale(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population std of each column after imputing the median; a row of numbers."""
    med = column_medians(train, names)
    filled = fill_columns(train, med)
    stat = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    return {c: (med[c], stat[f"m_{c}"] or 0.0, stat[f"s_{c}"] or 1.0) for c in names}


def apply_scale(rows: DataFrame, scale: dict) -> DataFrame:
    return rows.withColumns({c: (F.coalesce(finite(F.col(c)), F.lit(m)) - F.lit(mean)) / F.lit(s) for c, (m, mean, s) in scale.items()})


def balanced(train: DataFrame, y: str) -> DataFrame:
    """train with weight n / (classes * rows of the class)."""
    sizes = train.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
    total, classes = sizes.agg(F.sum("__n"), F.count(F.lit(1))).first()
    return train.join(sizes, y).withColumn("weight", F.lit(total or 0) / (F.lit(classes) * F.col("__n"))).drop("__n")


class Fitted:
    """A fitted model: adds y_prob to rows; Spark ML ones can be saved."""

    def __init__(self, score, pipeline=None):
        self.score, self.pipeline = score, pipeline

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.score(rows)

    def save(self, path: str) -> None:
        if self.pipeline is None:
            raise ValueError("a nearest-neighbour model is its training rows; write those instead")
        if isinstance(self.pipeline, Machine):
            return self.pipeline.save(path)
        self.pipeline.write().overwrite().save(path)


def fit(model: str, train: DataFrame, names: list[str], y: str = "y", trees: int = 300, depth: int = 12, seed: int = 42) -> Fitted:
    """The fitted model."""
    scale = fit_scale(train, names)
    data = balanced(apply_scale(train, scale), y).withColumn("label", F.col(y).cast("double"))
    if model == "knn":
        return Fitted(lambda rows: knn(apply_scale(train, scale), apply_scale(rows, scale), names, y))
    if model == "svm_rbf":
        x = F.array(*(F.col(c).cast("double") for c in names))
        machine = fit_machine(data.select(x.alias("x"), F.col(y).alias("y"), "weight"), seed=seed)
        return Fitted(lambda rows: _machine_scores(rows, scale, machine), machine)
    common = {"featuresCol": "v", "labelCol": "label"}
    n = data.count()
    stage = {
        "logreg": lambda: LogisticRegression(maxIter=1000, regParam=1 / max(n, 1), elasticNetParam=0.0, standardization=False, weightCol="weight", **common),
        "rf": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, **common),
        "gb": lambda: GBTClassifier(maxIter=min(trees, 100), stepSize=0.1, maxDepth=3, seed=seed, **common),
    }[model]()
    fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="v"), stage]).fit(data)
    drop = ["v", "rawPrediction", "probability", "prediction"]
    return Fitted(lambda rows: fitted.transform(apply_scale(rows, scale)).withColumn("y_prob", vector_to_array("probability")[1]).drop(*drop), fitted)


def _machine_scores(rows: DataFrame, scale: dict, machine: Machine) -> DataFrame:
    """rows on the model's scale with y_prob of the machine."""
    rows = apply_scale(rows, scale)
    return rows.withColumn("y_prob", machine.probability(F.array(*scale)))


def knn(train: DataFrame, queries: DataFrame, names: list[str], y: str = "y", k: int = 7, row_id: str = "epoch_id", block: int = 4096) -> DataFrame:
    """row_id and y_prob: the share of ones among the k nearest training rows (ties: smaller id).

    Queries and training rows are dealt into blocks of about `block` rows; each block of queries meets each block of
    training rows in one group, which returns k candidates per query; both sides name a block by an int, since Spark sends
    equal numbers of different types to different tasks. Nothing comes to the driver but two counts.
    """
    q_blocks, t_blocks = (max(1, -(-table.count() // block)) for table in (queries, train))

    def dealt(table, own, n_own, other, n_other, *columns):
        table = table.select(F.col(row_id).alias("id"), *columns, F.array(*(F.col(c).cast("double") for c in names)).alias("x"), F.pmod(F.xxhash64(row_id), F.lit(n_own)).cast("int").alias(own))
        return table.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def near(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(known):
            q, x = np.stack(asked["x"].to_list()), np.stack(known["x"].to_list())
            ids, ys = known["id"].to_numpy(), known["y"].to_numpy()
            for lo in range(0, len(q), 64):
                d = ((q[lo : lo + 64, None, :] - x[None, :, :]) ** 2).sum(2)
                order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :k]
                r = np.arange(len(d))[:, None]
                out.append(pd.DataFrame({"q": np.repeat(asked["id"].to_numpy()[lo : lo + 64], order.shape[1]), "d": d[r, order].ravel(), "t": ids[order].ravel(), "y": ys[order].ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "d": [], "t": [], "y": []})

    asked = dealt(queries, "qb", q_blocks, "tb", t_blocks).groupBy("qb", "tb")
    known = dealt(train, "tb", t_blocks, "qb", q_blocks, F.col(y).alias("y")).groupBy("qb", "tb")
    found = asked.cogroup(known).applyInPandas(near, "q long, d double, t long, y int")
    best = Window.partitionBy("q").orderBy("d", "t")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(F.col("q").alias(row_id)).agg(F.avg("y").alias("y_prob"))
