"""Joins, aggregations, ordering, sets and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.safe import finite
from ..operators import balance, selection, tabular
from ..sources import epoch_files, sinks, tables
from .views import EVT, FEAT


def describe(spark, sf_dir):
    e = tables.event_scores(spark, sf_dir)
    return e.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("recording").alias("recordings"), F.max("epoch_id").alias("last_epoch"))


def pair_files(spark, sf_dir):
    """X files paired with their y files; here a path per document, of which every third has no labels."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    stem = F.concat(F.lit("/train/a/"), "source", F.lit("/"), F.format_string("%06d", "doc_id"))
    x = d.select(F.concat(stem, F.lit("_X.npy")).alias("path"))
    y = d.where(F.col("doc_id") % 3 != 0).select(F.concat(stem, F.lit("_y.npy")).alias("path"))
    return epoch_files.pair_files(x.unionByName(y))


def channel_names(spark, sf_dir):
    channels = tables.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("channel"))
    return epoch_files.channel_names(spark, channels, ["Fp1", "Fp2", "F3", "F4", "C3"])


def default_names(spark, sf_dir):
    channels = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("channel"))
    return epoch_files.channel_names(spark, channels, ["too", "few"])


def class_counts(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels").select(F.col("quality").alias("y"))
    return balance.class_counts(labels).select(F.to_json("counts").alias("counts"))


def values_by_type(spark, sf_dir):
    """Metric values of each type in row order, as the source of a box plot."""
    return _collected(tables.table(spark, sf_dir, "events"))


def values_by_type_all(spark, sf_dir):
    return _collected(tables.table(spark, sf_dir, "events"))


def _collected(e):
    return e.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"].cast("string")), ",").alias("values"))


def summary(spark, sf_dir):
    out = tabular.summary(tables.table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", *(F.round(c, 9).alias(c) for c in ("mean", "std", "median", "min", "max")), "n")


def medians(spark, sf_dir):
    return tabular.medians(_gaps(spark, sf_dir)).select("feature", F.round("median", 9).alias("median"))


def percentiles(spark, sf_dir):
    out = tabular.quantiles(tables.table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"lo": 0.025, "mid": 0.5, "hi": 0.975})
    return out.select("o_orderpriority", *(F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")))


def votes(spark, sf_dir):
    rows = tables.embedding_features(spark, sf_dir)
    chosen = selection.univariate(rows, "f_classif", 10).unionByName(selection.univariate(rows, "chi2", 10))
    return tabular.votes(chosen.select("method", "feature"), rows, 2)


def elected(spark, sf_dir):
    return tabular.elect(votes(spark, sf_dir), 1.0, 12)


def argmax(spark, sf_dir):
    t = tables.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    t = t.withColumn("position", F.row_number().over(Window.orderBy("event_type")))  # a row per type
    return tabular.argmax(t, "position", "event_type", "score")


def folds_mean(spark, sf_dir):
    rows = balance.stratified_folds(_labelled(spark, sf_dir), "doc_id", 3)
    return rows.groupBy("fold").agg(F.avg("y").alias("m")).agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("std"))


def report(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 4).alias("experiment")).agg(F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 6).alias("roc_auc"), F.count_if(F.col("o_orderstatus") == "F").alias("n0"), F.count_if(F.col("o_orderstatus") == "O").alias("n1"))
    return tabular.experiment_report(rows)


def features_join(spark, sf_dir):
    a = tables.embedding_epochs(spark, sf_dir)
    left = a.select("epoch_id", F.round(F.get("samples", F.lit(0)), 9).alias("first"))
    right = a.select("epoch_id", F.round(F.element_at("samples", -1), 9).alias("last"))
    return left.join(right, "epoch_id").join(a.select("epoch_id", "y"), "epoch_id")


def grid(spark, sf_dir):
    channels = tables.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("max_channels"))
    return channels.crossJoin(tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("balance")))


def model_pairs(spark, sf_dir):
    m = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a"))
    n = m.select(F.col("i").alias("j"), F.col("a").alias("b"))
    return m.join(n, F.col("i") < F.col("j")).select("a", "b")


def paired_values(spark, sf_dir):
    """Values of every odd series and the next one by position, cut to the shorter one."""
    e = tables.event_scores(spark, sf_dir).withColumn("pair", F.floor((F.col("recording") + 1) / 2))
    a = e.where("recording % 2 = 1").select("pair", "epoch_id", F.col("p").alias("a"))
    b = e.where("recording % 2 = 0").select("pair", "epoch_id", F.col("p").alias("b"))
    return a.join(b, ["pair", "epoch_id"]).select("pair", "epoch_id", "a", "b")


def name_lookup(spark, sf_dir):
    li = tables.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return li.join(tables.table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "n")


def stable_top_k(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return tabular.top_k(p, 25, "p_size", "p_partkey")


def sorted_paths(spark, sf_dir):
    return sorted_paths_all(spark, sf_dir)


def sorted_paths_all(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").select("c_name", "c_custkey").orderBy("c_name")


def select_k_best(spark, sf_dir):
    out = selection.univariate(tables.embedding_features(spark, sf_dir), "f_classif", 8)
    return out.select("feature", F.round("score", 6).alias("score"))


def vote_fallback(spark, sf_dir):
    v = tables.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("feature")).agg((F.count(F.lit(1)) % 5).cast("double").alias("votes"))
    return tabular.top_k(v, 10, "votes", "feature", descending_tie=True)


def union_rows(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = tables.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


def remaining(spark, sf_dir):
    n = tables.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return tables.table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def project_features(spark, sf_dir):
    """Column selection (P3) and removal (P4) on the wide feature table."""
    rows = tables.embedding_features(spark, sf_dir).where("feature < 6")
    w = rows.groupBy("epoch_id").pivot("feature", list(range(6))).agg(F.first("value"))
    return w.select("epoch_id", "1", "3", "5").drop("3").select("epoch_id", F.round("1", 9).alias("f1"), F.round("5", 9).alias("f5"))


def drop_missing(spark, sf_dir):
    """Missing values are dropped alone and in pairs."""
    e = tables.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("a"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("b"))
    both = finite(F.col("a")).isNotNull() & finite(F.col("b")).isNotNull()
    return e.agg(F.count(finite(F.col("a"))).alias("a"), F.count(finite(F.col("b"))).alias("b"), F.count_if(both).alias("pairs"))


def significance_flag(spark, sf_dir):
    o = tables.table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.avg("l_discount").alias("p")).select(F.round("p", 9).alias("p"))
    return o.groupBy((F.col("p") < 0.05).alias("significant")).agg(F.count(F.lit(1)).alias("n"))


def metrics_document(spark, sf_dir):
    m = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linestatus").alias("states"))
    meta = m.agg(F.count(F.lit(1)).alias("models"), F.sum("n").alias("rows"))
    return sinks.metrics_document(m, meta)


def flat_rows(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 2).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = o.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"), F.array_sort(F.collect_list("n")).alias("sizes"))
    return sinks.flatten(rows).withColumnsRenamed({"counts.0": "counts_0", "counts.1": "counts_1"})


def _labelled(spark, sf_dir):
    return tables.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"))


def _gaps(spark, sf_dir):
    """Embedding values with every eleventh missing and a few infinite."""
    at = F.col("epoch_id") * 64 + F.col("feature")
    v = F.when(at % 11 == 0, F.lit(float("nan"))).when(at % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return tables.embedding_features(spark, sf_dir).withColumn("value", v)


GAPS_SQL = f"""{FEAT}, gap AS (SELECT epoch_id, y, feature, CASE WHEN (epoch_id * 64 + feature) % 11 = 0 OR (epoch_id * 64 + feature) % 101 = 0 THEN NULL ELSE value END AS value FROM feat)"""
ANOVA_SQL = """an AS (SELECT feature, y, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM feat GROUP BY feature, y),
 af AS (SELECT feature, (sum(s * s / n) - sum(s) ** 2 / sum(n)) / (count(*) - 1) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f FROM an GROUP BY feature)"""
CHI_SQL = """ch AS (SELECT feature, y, sum(abs(value)) AS o, count(*) AS n FROM feat GROUP BY feature, y),
 ct AS (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM ch), cs AS (SELECT feature, sum((o - e) ** 2 / e) AS chi2 FROM ct GROUP BY feature)"""
_VOTES = f"""{FEAT}, {ANOVA_SQL}, {CHI_SQL}, sel AS (SELECT feature FROM (SELECT feature FROM af ORDER BY f DESC, feature LIMIT 10) UNION ALL SELECT feature FROM (SELECT feature FROM cs ORDER BY chi2 DESC, feature LIMIT 10)),
 v AS (SELECT f.feature, (SELECT count(*) FROM sel WHERE sel.feature = f.feature) / 2.0::DOUBLE AS votes FROM (SELECT DISTINCT feature FROM feat) f)"""
_FOLDS = """l AS (SELECT doc_id, quality AS y, (row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) - 1) % 3 AS fold FROM labels WHERE quality IS NOT NULL)"""

QUERIES = {
    "S1_pair_files": pair_files, "S4_describe_events": describe, "S5_channel_names": channel_names, "S5_default_names": default_names, "S6_metrics_document": metrics_document, "S11_flat_rows": flat_rows,
    "P3_P4_feature_projection": project_features, "P5_drop_missing": drop_missing, "P8_significance_flag": significance_flag,
    "A1_class_counts": class_counts, "A2_values_by_type": values_by_type, "A2_values_by_type_all": values_by_type_all, "A3_summary_by_type": summary, "A4_medians": medians, "A6_percentiles": percentiles, "A7_votes": votes, "A8_argmax": argmax,
    "A9_fold_mean": folds_mean, "A10_report": report, "J2_J3_feature_join": features_join, "J4_grid": grid, "J5_pairs": model_pairs, "J6_paired_values": paired_values, "J7_name_lookup": name_lookup,
    "O1_sorted_names": sorted_paths, "O1_sorted_names_all": sorted_paths_all, "O2_stable_topk": stable_top_k, "O4_select_k_best": select_k_best, "O5_vote_fallback": vote_fallback, "O6_elected": elected, "U1_union_rows": union_rows, "U3_anti": remaining,
}
ORACLE_SQL = {
    "S1_pair_files": """SELECT '/train/a/' || source || '/' || format('{:06d}', doc_id) AS stem, stem || '_X.npy' AS x_path, stem || '_y.npy' AS y_path FROM documents WHERE doc_id % 3 <> 0""",
    "S4_describe_events": f"WITH {EVT} SELECT y, count(*) AS rows, count(DISTINCT recording) AS recordings, max(epoch_id) AS last_epoch FROM evt GROUP BY y",
    "S5_channel_names": "SELECT DISTINCT n_regionkey AS channel, (['Fp1', 'Fp2', 'F3', 'F4', 'C3'])[n_regionkey + 1] AS name FROM nation",
    "S5_default_names": "SELECT n_nationkey AS channel, format('CH{:02d}', n_nationkey) AS name FROM nation",
    "S6_metrics_document": """WITH m AS (SELECT l_returnflag AS model, count(*) AS n, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY 1)
 SELECT '{"meta":{"models":' || count(*) || ',"rows":' || sum(n)::BIGINT || '},"results":{' || string_agg('"' || model || '":{"n":' || n || ',"states":' || states || '}', ',' ORDER BY model) || '}}' AS document FROM m""",
    "S11_flat_rows": """SELECT o_orderpriority, count(*) FILTER (o_orderkey % 2 = 0) AS counts_0, count(*) FILTER (o_orderkey % 2 = 1) AS counts_1,
 '[' || least(count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderkey % 2 = 1)) || ',' || greatest(count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderkey % 2 = 1)) || ']' AS sizes FROM orders GROUP BY o_orderpriority""",
    "P3_P4_feature_projection": "SELECT vec_id AS epoch_id, round(embedding[2]::DOUBLE, 9) AS f1, round(embedding[6]::DOUBLE, 9) AS f5 FROM embeddings",
    "P5_drop_missing": "SELECT count(*) FILTER (event_id % 7 <> 0) AS a, count(*) FILTER (event_id % 5 <> 0) AS b, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0) AS pairs FROM events WHERE value IS NOT NULL",
    "P8_significance_flag": "SELECT p < 0.05::DOUBLE AS significant, count(*) AS n FROM (SELECT round(avg(l_discount), 9) AS p FROM lineitem GROUP BY l_shipdate) GROUP BY 1",
    "A1_class_counts": """SELECT '{' || string_agg('"' || y || '":' || n, ',' ORDER BY y) || '}' AS counts FROM (SELECT quality AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)""",
    "A2_values_by_type": "SELECT event_type, string_agg(value::VARCHAR, ',' ORDER BY event_id) AS values FROM events GROUP BY event_type",
    "A3_summary_by_type": """SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, round(quantile_cont(value, 0.5), 9) AS median, round(min(value), 9) AS min, round(max(value), 9) AS max, count(value) AS n FROM events GROUP BY event_type""",
    "A4_medians": f"WITH {GAPS_SQL} SELECT feature, round(quantile_cont(value, 0.5), 9) AS median FROM gap GROUP BY feature",
    "A6_percentiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS lo, round(quantile_cont(o_totalprice, 0.5), 6) AS mid, round(quantile_cont(o_totalprice, 0.975), 6) AS hi FROM orders GROUP BY o_orderpriority",
    "A7_votes": f"WITH {_VOTES} SELECT feature, votes FROM v",
    "A8_argmax": "SELECT event_type, score FROM (SELECT event_type, round(avg(value), 6) AS score FROM events GROUP BY event_type) ORDER BY score DESC, event_type LIMIT 1",
    "A9_fold_mean": f"WITH {_FOLDS} SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std FROM (SELECT fold, avg(y) AS m FROM l GROUP BY fold)",
    "A10_report": """WITH r AS (SELECT o_orderpriority AS model, o_orderkey % 4 AS experiment, round(avg((o_totalprice > 200000)::INT), 6) AS roc_auc, count(*) FILTER (o_orderstatus = 'F') AS n0, count(*) FILTER (o_orderstatus = 'O') AS n1 FROM orders GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY roc_auc DESC, experiment) AS k FROM r)
 SELECT model, experiment, roc_auc, n0 || ':' || n1 || ' (ratio:' || format('{:.2f}', coalesce(n1 / nullif(n0, 0), 0)::DOUBLE) || ')' AS classes, CASE WHEN roc_auc >= 0.6 THEN 'Good' WHEN roc_auc >= 0.5 THEN 'Moderate' ELSE 'Poor' END AS grade FROM b WHERE k = 1""",
    "J2_J3_feature_join": "SELECT vec_id AS epoch_id, round(embedding[1]::DOUBLE, 9) AS first, round(embedding[64]::DOUBLE, 9) AS last, (label >= 5)::INT AS y FROM embeddings",
    "J4_grid": "SELECT r_regionkey AS max_channels, n_name AS balance FROM region CROSS JOIN nation",
    "J5_pairs": "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey",
    "J6_paired_values": f"WITH {EVT} SELECT (a.recording + 1) // 2 AS pair, a.epoch_id, a.p AS a, b.p AS b FROM evt a JOIN evt b ON a.epoch_id = b.epoch_id AND a.recording % 2 = 1 AND b.recording = a.recording + 1",
    "J7_name_lookup": "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "O1_sorted_names": "SELECT c_name, c_custkey FROM customer ORDER BY c_name",
    "O2_stable_topk": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25",
    "O4_select_k_best": f"WITH {FEAT}, {ANOVA_SQL} SELECT feature, round(f, 6) AS score FROM (SELECT * FROM af ORDER BY f DESC, feature LIMIT 8)",
    "O5_vote_fallback": "SELECT feature, votes FROM (SELECT p_size AS feature, (count(*) % 5)::DOUBLE AS votes FROM part GROUP BY p_size) ORDER BY votes DESC, feature DESC LIMIT 10",
    "O6_elected": f"""WITH {_VOTES}, p AS (SELECT * FROM v WHERE votes >= 1), b AS (SELECT * FROM v ORDER BY votes DESC, feature DESC LIMIT 12)
 SELECT * FROM p WHERE (SELECT count(*) FROM p) >= 12 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM p) < 12""",
    "U1_union_rows": "SELECT nation, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY nation",
    "U3_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
}
