"""Score series: metrics, windows, votes, alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sequence
from ..sources import tables
from .views import EVT, LI

RULE = sequence.Alarm(t_on=0.1, t_off=0.05, min_on=2, min_off=2, refractory=3)
_ROUND = ("tp", "tn", "fp", "fn", "accuracy", "precision", "sensitivity", "specificity", "fpr", "f1", "f_beta", "roc_auc")


def metrics_lineitem(spark, sf_dir):
    rows = sequence.threshold(tables.lineitem_scores(spark, sf_dir), 0.5, "y_prob", "y_pred")
    out = metrics.compute_metrics(rows, ["model"])
    return out.select("model", *(F.round(c, 9).alias(c) for c in _ROUND))


def auc_by_linestatus(spark, sf_dir):
    out = metrics.roc_auc(tables.lineitem_scores(spark, sf_dir), ["model", "l_linestatus"])
    return out.select("model", "l_linestatus", F.round("roc_auc", 9).alias("roc_auc"))


def threshold_events(spark, sf_dir):
    return sequence.threshold(tables.event_scores(spark, sf_dir), 0.1).groupBy("recording").agg(F.sum("pred").alias("positives"), F.count(F.lit(1)).alias("n"))


def moving_average(spark, sf_dir):
    out = sequence.moving_average(tables.event_scores(spark, sf_dir), 5)
    return out.select("recording", "epoch_id", F.round("p", 9).alias("p"))


def k_of_n(spark, sf_dir):
    return sequence.k_of_n(sequence.threshold(tables.event_scores(spark, sf_dir), 0.1), "3/5").select("recording", "epoch_id", "pred", "vote")


def alarms(spark, sf_dir):
    return sequence.alarm(tables.event_scores(spark, sf_dir), RULE).select("recording", "epoch_id", "alarm")


def post_processed(spark, sf_dir):
    """Smooth, threshold, vote, then metrics per recording: the whole chain after a model."""
    s = sequence.k_of_n(sequence.threshold(sequence.moving_average(tables.event_scores(spark, sf_dir), 3), 0.1), "2/3")
    out = metrics.compute_metrics(s.select("recording", F.col("y").alias("y_true"), F.round("p", 9).alias("y_prob"), F.col("vote").alias("y_pred")), ["recording"])
    return out.select("recording", *(F.round(c, 9).alias(c) for c in _ROUND))


_RATES = """round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity,
 round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
 round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 9) AS f_beta"""
_CELLS = """count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn,
 count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn"""


def _auc(source: str, by: str) -> str:
    return f"""k AS (SELECT {by}, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM {source} GROUP BY {by}, y_prob),
u AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM k),
auc AS (SELECT {by}, round(sum(won)::DOUBLE / nullif((sum(pos) * sum(neg))::DOUBLE, 0), 9) AS roc_auc FROM u GROUP BY {by})"""


QUERIES = {
    "M6_metrics_lineitem": metrics_lineitem,
    "M7_auc_by_linestatus": auc_by_linestatus,
    "P7_threshold_events": threshold_events,
    "W1_moving_avg_events": moving_average,
    "W2_kofn_events": k_of_n,
    "W3_alarm_events": alarms,
    "W_post_processing_metrics": post_processed,
}
ORACLE_SQL = {
    "M6_metrics_lineitem": f"""WITH {LI}, c AS (SELECT *, (y_prob >= 0.5)::INT AS y_pred FROM li), {_auc("li", "model")},
 m AS (SELECT model, {_CELLS} FROM c GROUP BY model) SELECT model, tp, tn, fp, fn, {_RATES}, roc_auc FROM m JOIN auc USING (model)""",
    "M7_auc_by_linestatus": f"WITH {LI}, {_auc('li', 'model, l_linestatus')} SELECT model, l_linestatus, roc_auc FROM auc",
    "P7_threshold_events": f"WITH {EVT} SELECT recording, sum((p >= 0.1)::INT)::BIGINT AS positives, count(*) AS n FROM evt GROUP BY recording",
    "W1_moving_avg_events": f"""WITH {EVT} SELECT recording, epoch_id, round(avg(p) OVER (PARTITION BY recording ORDER BY epoch_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS p FROM evt""",
    "W2_kofn_events": f"""WITH {EVT}, t AS (SELECT *, (p >= 0.1)::INT AS pred FROM evt)
 SELECT recording, epoch_id, pred, (epoch_id >= 4 AND sum(pred) OVER (PARTITION BY recording ORDER BY epoch_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3)::INT AS vote FROM t""",
    "W3_alarm_events": f"""WITH RECURSIVE {EVT},
 s AS (SELECT recording, -1::BIGINT AS epoch_id, false AS is_on, 0 AS run, 0 AS cool, 0 AS alarm FROM evt GROUP BY recording
 UNION ALL SELECT e.recording, e.epoch_id,
   CASE WHEN s.is_on THEN NOT (e.p < 0.05 AND s.run + 1 >= 2) ELSE greatest(s.cool - 1, 0) = 0 AND e.p >= 0.1 AND s.run + 1 >= 2 END,
   CASE WHEN s.is_on THEN CASE WHEN e.p < 0.05 AND s.run + 1 < 2 THEN s.run + 1 ELSE 0 END
        WHEN greatest(s.cool - 1, 0) > 0 THEN s.run WHEN e.p >= 0.1 AND s.run + 1 < 2 THEN s.run + 1 ELSE 0 END,
   CASE WHEN s.is_on THEN CASE WHEN e.p < 0.05 AND s.run + 1 >= 2 THEN 3 ELSE 0 END ELSE greatest(s.cool - 1, 0) END,
   CASE WHEN s.is_on THEN (NOT (e.p < 0.05 AND s.run + 1 >= 2))::INT ELSE (greatest(s.cool - 1, 0) = 0 AND e.p >= 0.1 AND s.run + 1 >= 2)::INT END
 FROM s JOIN evt e ON e.recording = s.recording AND e.epoch_id = s.epoch_id + 1)
 SELECT recording, epoch_id, alarm FROM s WHERE epoch_id >= 0""",
    "W_post_processing_metrics": f"""WITH {EVT}, a AS (SELECT recording, epoch_id, y, avg(p) OVER w AS p FROM evt WINDOW w AS (PARTITION BY recording ORDER BY epoch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, (p >= 0.1)::INT AS pred FROM a),
 c AS (SELECT recording, y AS y_true, round(p, 9) AS y_prob, (epoch_id >= 2 AND sum(pred) OVER (PARTITION BY recording ORDER BY epoch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2)::INT AS y_pred FROM b),
 {_auc("c", "recording")}, m AS (SELECT recording, {_CELLS} FROM c GROUP BY recording)
 SELECT m.recording, tp, tn, fp, fn, {_RATES}, roc_auc FROM m JOIN auc ON m.recording = auc.recording""",
}
