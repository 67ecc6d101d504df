"""Statistical procedures on score series and the published experiment rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import uniform_sql
from ..operators import stats
from ..operators.replicates import PRIME, poisson_cuts
from ..sources import tables
from .views import EVT

REPLICATES, CHANNEL_PERMUTATIONS = 1000, 500


def _all_scores(spark, sf_dir):
    return tables.event_scores(spark, sf_dir).select(F.concat_ws("-", "recording", "epoch_id").alias("row"), "p", "y")


def mcnemar(spark, sf_dir):
    hit = lambda c: (c >= 0.5).cast("int")
    li = tables.table(spark, sf_dir, "lineitem")
    wide = li.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), hit(F.col("l_discount") * 10).alias("discount"), hit(F.col("l_quantity") / 50).alias("quantity"))
    out = stats.mcnemar(wide, "y_true", "discount", "quantity")
    return out.select("only_a", "only_b", F.round("statistic", 6).alias("statistic"))


def kruskal(spark, sf_dir):
    out = stats.kruskal_wallis(tables.table(spark, sf_dir, "events"), "event_type", "value")
    return out.select(F.round("h", 6).alias("h"), "groups", F.round("p", 9).alias("p"))


def sign_flip(spark, sf_dir):
    """Mean scores of even against odd epochs, over all recordings: a pair for each last digit of the recording."""
    e = tables.event_scores(spark, sf_dir).groupBy((F.col("recording") % 10).alias("cell"))
    mean = lambda side: F.round(F.avg(F.when(F.col("epoch_id") % 2 == side, F.col("p"))), 6)
    out = stats.sign_flip_exact(e.agg(mean(0).alias("a"), mean(1).alias("b")))
    return out.select("patterns", F.round("p", 9).alias("p"))


def sign_flip_random(spark, sf_dir):
    """Every odd recording against the next one, over all epochs that both have."""
    e = tables.event_scores(spark, sf_dir).withColumn("pair", F.floor((F.col("recording") + 1) / 2))
    a = e.where("recording % 2 = 1").select("pair", "epoch_id", F.col("p").alias("a"))
    b = e.where("recording % 2 = 0").select("pair", "epoch_id", F.col("p").alias("b"))
    return stats.sign_flip_random(a.join(b, ["pair", "epoch_id"]).withColumn("row", F.concat_ws("-", "pair", "epoch_id")), "row")


def bootstrap(spark, sf_dir):
    out = stats.bootstrap_ci(_all_scores(spark, sf_dir), "row", REPLICATES)
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean", "ci_lo", "ci_hi")), "samples")


def bootstrap_f_beta(spark, sf_dir):
    """The F-2 score of the scores cut at 0.3."""
    rows = _all_scores(spark, sf_dir).withColumn("pred", F.col("p") >= 0.3)
    out = stats.bootstrap_ci(rows, "row", REPLICATES, metric="f_beta", pred="pred")
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean", "ci_lo", "ci_hi")), "samples")


def permutation_f_beta(spark, sf_dir):
    rows = _all_scores(spark, sf_dir).withColumn("q", F.round(1 - F.col("p"), 9))
    out = stats.permutation_test(rows, "row", "p", "q", REPLICATES, metric="f_beta")
    return out.select(F.round("observed", 9).alias("observed"), F.round("p", 9).alias("p"))


def permutation(spark, sf_dir):
    rows = _all_scores(spark, sf_dir).withColumn("q", F.round(1 - F.col("p"), 9))
    out = stats.permutation_test(rows, "row", "p", "q", REPLICATES)
    return out.select(F.round("observed", 9).alias("observed"), F.round("p", 9).alias("p"))


def surrogate(spark, sf_dir):
    out = stats.surrogates(_all_scores(spark, sf_dir), "row", REPLICATES)
    return out.select(*(F.round(c, 6).alias(c) for c in ("observed", "mean", "std", "z", "p")))


def bootstrap_all(spark, sf_dir):
    """Unrounded, as the next two; tests hold them against plain Python on a small table."""
    return stats.bootstrap_ci(_all_scores(spark, sf_dir), "row")


def permutation_all(spark, sf_dir):
    return stats.permutation_test(_all_scores(spark, sf_dir).withColumn("q", F.round(1 - F.col("p"), 9)), "row", "p", "q")


def surrogate_all(spark, sf_dir):
    return stats.surrogates(_all_scores(spark, sf_dir), "row")


def bootstrap_mean(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    out = stats.bootstrap_mean(o, "o_orderpriority", "v", REPLICATES)
    return out.select("o_orderpriority", F.round("ci_lo", 4).alias("ci_lo"), F.round("ci_hi", 4).alias("ci_hi"))


def channel_significance(spark, sf_dir):
    """Each channel's score is the sum of its samples."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    e = tables.embedding_epochs(spark, sf_dir, 4).select("epoch_id", "channel", "y", F.round(total, 6).alias("p"))
    out = stats.channel_significance(e, CHANNEL_PERMUTATIONS)
    return out.select("channel", F.round("roc_auc", 6).alias("roc_auc"), F.round("p", 6).alias("p"), "significant")


_AUC = """k AS (SELECT rep, p, sum(w) FILTER (y = 1) AS pos, sum(w) FILTER (y = 0) AS neg FROM b GROUP BY rep, p),
 u AS (SELECT rep, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
 a AS (SELECT rep, sum(pos * (below + neg / 2))::DOUBLE / nullif((sum(pos) * sum(neg))::DOUBLE, 0) AS auc FROM u GROUP BY rep)"""
_F2 = """c AS (SELECT rep, (sum(w) FILTER (hit AND y = 1))::DOUBLE AS tp, (sum(w) FILTER (hit AND y = 0))::DOUBLE AS fp, (sum(w) FILTER (NOT hit AND y = 1))::DOUBLE AS fn FROM b GROUP BY rep),
 pr AS (SELECT rep, coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 0) AS p, coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0), 0) AS r FROM c),
 f AS (SELECT rep, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS f FROM pr)"""
_ROWS = f"{EVT}, s AS (SELECT recording || '-' || epoch_id AS row, p, y FROM evt), rep AS (SELECT unnest(range({REPLICATES})) AS rep)"


def _draw(seed: str, row: str, rep: str) -> str:
    """SQL of a row's draw in a replicate, and of its tie-breaking hash."""
    part = lambda text, k: f"(('0x' || substr(md5({text}), {8 * k + 1}, 8))::BIGINT % {PRIME})"
    of_row = [part(f"'{seed}|' || {row}", k) for k in (0, 1)]
    b, c, d = (part(f"'{seed}|' || {rep}", k) for k in (0, 1, 2))
    return f"((({of_row[0]} * {of_row[0]}) % {PRIME}) * {b} + {of_row[0]} * {c} + {d}) % {PRIME} AS u, {of_row[1]} AS t"


_POISSON = " + ".join(f"(u >= {c})::INT" for c in poisson_cuts())

QUERIES = {
    "T1_bootstrap_ci": bootstrap, "T2_permutation": permutation, "T3_mcnemar": mcnemar, "T4_kruskal": kruskal, "T5_surrogate": surrogate,
    "T8_channel_significance": channel_significance, "T9_bootstrap_mean": bootstrap_mean, "T10_signflip_exact": sign_flip,
    "T1_bootstrap_ci_all": bootstrap_all, "T2_permutation_all": permutation_all, "T5_surrogate_all": surrogate_all,
    "T10_signflip_random": sign_flip_random, "T1_bootstrap_f_beta": bootstrap_f_beta, "T2_permutation_f_beta": permutation_f_beta,
}
ORACLE_SQL = {
    "T1_bootstrap_ci": f"""WITH {_ROWS}, x AS (SELECT rep, p, y, {_draw("0", "row", "rep")} FROM s CROSS JOIN rep), b AS (SELECT rep, p, y, {_POISSON} AS w FROM x), {_AUC}
 SELECT round(avg(auc), 9) AS mean, round(quantile_cont(auc, 0.025), 9) AS ci_lo, round(quantile_cont(auc, 0.975), 9) AS ci_hi, count(auc) AS samples FROM a""",
    "T2_permutation": f"""WITH {EVT}, s AS (SELECT recording || '-' || epoch_id AS row, p, round(1 - p, 9) AS q, y FROM evt), r AS (SELECT unnest(range({REPLICATES + 1})) AS r),
 x AS (SELECT r, y, p, q, r > 0 AND 2 * u < {PRIME} AS swap FROM (SELECT r, y, p, q, {_draw("0", "row", "r")} FROM s CROSS JOIN r)),
 b AS (SELECT r || 'a' AS rep, y, CASE WHEN swap THEN q ELSE p END AS p, 1 AS w FROM x UNION ALL SELECT r || 'b', y, CASE WHEN swap THEN p ELSE q END, 1 FROM x), {_AUC},
 d AS (SELECT r.r, (SELECT auc FROM a WHERE rep = r.r || 'a') - (SELECT auc FROM a WHERE rep = r.r || 'b') AS d FROM r), o AS (SELECT d AS observed FROM d WHERE r = 0)
 SELECT round(observed, 9) AS observed, round((count(*) FILTER (d >= abs(observed)) + 1) / {REPLICATES + 1}, 9) AS p FROM d CROSS JOIN o WHERE r > 0 GROUP BY observed""",
    "T1_bootstrap_f_beta": f"""WITH {_ROWS}, x AS (SELECT rep, p, y, {_draw("0", "row", "rep")} FROM s CROSS JOIN rep), b AS (SELECT rep, p >= 0.3 AS hit, y, {_POISSON} AS w FROM x), {_F2}
 SELECT round(avg(f), 9) AS mean, round(quantile_cont(f, 0.025), 9) AS ci_lo, round(quantile_cont(f, 0.975), 9) AS ci_hi, count(f) AS samples FROM f""",
    "T2_permutation_f_beta": f"""WITH {EVT}, s AS (SELECT recording || '-' || epoch_id AS row, p, round(1 - p, 9) AS q, y FROM evt), r AS (SELECT unnest(range({REPLICATES + 1})) AS r),
 x AS (SELECT r, y, p, q, r > 0 AND 2 * u < {PRIME} AS swap FROM (SELECT r, y, p, q, {_draw("0", "row", "r")} FROM s CROSS JOIN r)),
 b AS (SELECT r || 'a' AS rep, y, CASE WHEN swap THEN q ELSE p END >= 0.5 AS hit, 1 AS w FROM x UNION ALL SELECT r || 'b', y, CASE WHEN swap THEN p ELSE q END >= 0.5, 1 FROM x), {_F2},
 d AS (SELECT r.r, (SELECT f FROM f WHERE rep = r.r || 'a') - (SELECT f FROM f WHERE rep = r.r || 'b') AS d FROM r), o AS (SELECT d AS observed FROM d WHERE r = 0)
 SELECT round(observed, 9) AS observed, round((count(*) FILTER (d >= abs(observed)) + 1) / {REPLICATES + 1}, 9) AS p FROM d CROSS JOIN o WHERE r > 0 GROUP BY observed""",
    "T3_mcnemar": """WITH w AS (SELECT (l_returnflag = 'R') AS y, l_discount * 10 >= 0.5 AS a, l_quantity / 50 >= 0.5 AS b FROM lineitem),
 n AS (SELECT count(*) FILTER (a = y AND b <> y) AS only_a, count(*) FILTER (a <> y AND b = y) AS only_b FROM w)
 SELECT only_a, only_b, round(coalesce((abs(only_a - only_b) - 1)::DOUBLE ** 2 / nullif(only_a + only_b, 0), 0), 6) AS statistic FROM n""",
    "T4_kruskal": """WITH r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk, value FROM events WHERE value IS NOT NULL),
 g AS (SELECT g, sum(rk) AS r, count(*) AS n FROM r GROUP BY g), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS tie FROM (SELECT count(*) AS c FROM r GROUP BY value)),
 h AS (SELECT (12 / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) AS raw, sum(n)::DOUBLE AS n, count(*) AS groups FROM g),
 k AS (SELECT raw / (1 - tie / (n ** 3 - n)) AS h, groups FROM h CROSS JOIN t) SELECT round(h, 6) AS h, groups, round(exp(-h / 2) * (1 + h / 2), 9) AS p FROM k""",
    "T5_surrogate": f"""WITH {_ROWS}, x AS (SELECT rep, p, {_draw("0", "row", "rep")} FROM s CROSS JOIN rep),
 b AS (SELECT rep, p, (row_number() OVER (PARTITION BY rep ORDER BY u, t) <= (SELECT sum(y) FROM s))::INT AS y, 1 AS w FROM x UNION ALL SELECT -1, p, y, 1 FROM s), {_AUC},
 o AS (SELECT auc AS observed FROM a WHERE rep = -1), t AS (SELECT avg(auc) AS mean, stddev_pop(auc) AS std FROM a WHERE rep >= 0)
 SELECT round(observed, 6) AS observed, round(mean, 6) AS mean, round(std, 6) AS std, round((observed - mean) / std, 6) AS z,
  round((SELECT count(*) FROM a WHERE rep >= 0 AND abs(auc - mean) >= abs(observed - mean)) / {REPLICATES}, 6) AS p FROM o CROSS JOIN t""",
    "T8_channel_significance": f"""WITH e AS (SELECT vec_id AS epoch_id, c AS channel, (label >= 5)::INT AS y, round(list_reduce(list_prepend(0.0::DOUBLE, embedding[c * 16 + 1 : c * 16 + 16]::DOUBLE[]), lambda a, v: a + v), 6) AS p FROM embeddings CROSS JOIN (SELECT unnest(range(4)) AS c)),
 x AS (SELECT channel, channel || '|' || r AS g, p, {_draw("42", "channel || '|' || epoch_id", "r")} FROM e CROSS JOIN (SELECT unnest(range({CHANNEL_PERMUTATIONS})) AS r)),
 k AS (SELECT channel, sum(y) AS k FROM e GROUP BY channel), l AS (SELECT x.*, row_number() OVER (PARTITION BY g ORDER BY u, t) AS r FROM x),
 b AS (SELECT g AS rep, p, (r <= k.k)::INT AS y, 1 AS w FROM l JOIN k USING (channel) UNION ALL SELECT channel || '|', p, y, 1 FROM e), {_AUC.replace("k AS", "kk AS").replace("FROM k)", "FROM kk)")},
 o AS (SELECT c::INT AS channel, (SELECT auc FROM a WHERE rep = c || '|') AS roc_auc, (SELECT count(*) FROM a WHERE rep LIKE c || '|_%' AND auc >= (SELECT auc FROM a WHERE rep = c || '|')) / {CHANNEL_PERMUTATIONS} AS p FROM (SELECT unnest(range(4)) AS c))
 SELECT channel, round(roc_auc, 6) AS roc_auc, round(p, 6) AS p, p < 0.05 AS significant FROM o""",
    "T9_bootstrap_mean": f"""WITH v AS (SELECT o_orderpriority, year(o_orderdate) AS yr, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2), l AS (SELECT o_orderpriority, list(v ORDER BY v) AS v FROM v GROUP BY 1),
 d AS (SELECT o_orderpriority, v, rep, unnest(range(len(v))) AS i FROM l CROSS JOIN (SELECT unnest(range({REPLICATES})) AS rep)),
 m AS (SELECT o_orderpriority, rep, avg(v[floor({uniform_sql("'42|' || rep || '|' || i")} * len(v))::INT + 1]) AS m FROM d GROUP BY 1, 2)
 SELECT o_orderpriority, round(quantile_cont(m, 0.025), 4) AS ci_lo, round(quantile_cont(m, 0.975), 4) AS ci_hi FROM m GROUP BY 1""",
    "T10_signflip_exact": f"""WITH {EVT}, c AS (SELECT recording % 10 AS cell, round(avg(p) FILTER (epoch_id % 2 = 0), 6) - round(avg(p) FILTER (epoch_id % 2 = 1), 6) AS d FROM evt GROUP BY 1),
 d AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, d FROM c WHERE d IS NOT NULL),
 m AS (SELECT unnest(range((2 ** (SELECT count(*) FROM d))::BIGINT)) AS mask), f AS (SELECT mask, sum(CASE WHEN (mask // (2 ** i)::BIGINT) % 2 = 1 THEN -d ELSE d END) AS s FROM m CROSS JOIN d GROUP BY mask)
 SELECT count(*) AS patterns, round(count(*) FILTER (abs(s) >= abs((SELECT sum(d) FROM d)) - 1e-12) / count(*), 9) AS p FROM f""",
}
