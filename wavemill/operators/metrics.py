"""Binary metrics and tie-aware ROC-AUC, grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import finite, ratio
from .ranks import with_below

def confusion(rows: DataFrame, by: list[str], y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """tp, tn, fp, fn per group, in one aggregation."""
    count = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b)).cast("double")
    return rows.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))


def rates(cells: DataFrame, beta: float = 2.0) -> DataFrame:
    """Accuracy, precision, sensitivity, specificity, F1, F-beta and false-positive rate of confusion cells; 0/0 is 0."""
    b2 = (beta if beta > 0 else 1.0) ** 2
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = cells.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })
    p, r = F.col("precision"), F.col("sensitivity")
    return out.withColumn("f_beta", ratio((1 + b2) * p * r, b2 * p + r))


def roc_auc(rows: DataFrame, by: list[str], y: str = "y_true", score: str = "y_prob", weight: str | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks per group, rows counting `weight` times; null where one class is missing.

    Rows are first summed per distinct score; sums below a score are taken digit by digit (see ranks), so that even
    millions of distinct scores of one group are spread, however close they lie.
    """
    s = finite(F.col(score))
    of = lambda label: F.sum(F.when(F.col(y) == label, F.col(weight) if weight else F.lit(1)).otherwise(0))
    counts = rows.withColumn("__s", s).where(F.col("__s").isNotNull() & F.col(y).isNotNull()).groupBy(*by, "__s").agg(of(1).alias("pos"), of(0).alias("neg"))
    ranked = with_below(counts, by, "__s", "neg", "__below").withColumn("__won", F.col("pos") * (F.col("__below") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum("__won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def compute_metrics(rows: DataFrame, by: list[str], beta: float = 2.0, y: str = "y_true", score: str = "y_prob", pred: str = "y_pred") -> DataFrame:
    """The twelve values of a binary experiment, per group."""
    return rates(confusion(rows, by, y, pred), beta).join(roc_auc(rows, by, y, score), by)
