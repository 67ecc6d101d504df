"""Epoch features, projections and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, signal
from ..operators import features, preprocess
from ..sources import tables
from .views import EMB


def _rounded(df, keys, names, digits=6):
    return df.select(*keys, *(F.round(n, digits).alias(n) for n in names))


def time_stats(spark, sf_dir):
    e = features.extract(tables.embedding_epochs(spark, sf_dir), 64.0, complexity_features=False, time=True)
    return _rounded(e, ["epoch_id"], list(arrays.TIME_FEATURES))


def ordinal(spark, sf_dir):
    x = F.col("samples")
    e = tables.embedding_epochs(spark, sf_dir).withColumns({"perm_ent": arrays.permutation_entropy(x), "petrosian_fd": arrays.petrosian(x)})
    return _rounded(e, ["epoch_id"], ["perm_ent", "petrosian_fd"])


def complexity(spark, sf_dir):
    e = tables.embedding_epochs(spark, sf_dir).withColumn("c", features.complexity(("sampen", "higuchi_fd"))("samples")).select("epoch_id", "c.sampen", "c.higuchi_fd")
    return _rounded(e, ["epoch_id"], ["sampen", "higuchi_fd"])


def fluctuation(spark, sf_dir):
    e = tables.embedding_epochs(spark, sf_dir).withColumn("c", features.complexity(("dfa", "hurst"))("samples")).withColumn("svd_ent", arrays.svd_entropy(F.col("samples")))
    return e.select("epoch_id", "svd_ent", "c.dfa", "c.hurst")


def bandpower(spark, sf_dir):
    e = tables.embedding_epochs(spark, sf_dir).withColumn("s", features.spectral(64.0)("samples")).select("epoch_id", "s.*")
    return _rounded(e, ["epoch_id"], features.SPECTRAL, 9)


def stft(spark, sf_dir):
    e = tables.embedding_epochs(spark, sf_dir).withColumn("s", features.spectral(64.0, stft=True)("samples")).select("epoch_id", "s.*")
    return _rounded(e, ["epoch_id"], features.STFT, 9)


def wide(spark, sf_dir):
    e = features.extract(tables.embedding_epochs(spark, sf_dir, 4), 64.0, complexity_features=False, time=True)
    w = features.wide(e, ["mean", "rms"], [0, 1, 2, 3])
    return _rounded(w, ["epoch_id"], w.columns[1:], 9)


def summary(spark, sf_dir):
    e = features.channel_summary(tables.embedding_epochs(spark, sf_dir, 4), 16.0)
    return _rounded(e, ["epoch_id", "channel", "y"], ["rms", *features.SPECTRAL], 9)


def prefix_limit(spark, sf_dir):
    return preprocess.limit_epochs(tables.embedding_epochs(spark, sf_dir, 4), 100).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))


def channel_project(spark, sf_dir):
    e = preprocess.project_channels(tables.embedding_epochs(spark, sf_dir, 4), [2, 0])
    return e.select("epoch_id", "channel", F.round(F.get("samples", F.lit(0)), 9).alias("head"))


def band_mask(spark, sf_dir):
    """Frequency bins of a 256-sample window per band, as a range predicate."""
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in signal.BANDS.items()))).alias("b")
    bins = tables.embedding_epochs(spark, sf_dir).select("epoch_id", F.posexplode("samples").alias("f", "v"), bands)
    return bins.where((F.col("f") >= F.col("b.lo")) & (F.col("f") < F.col("b.hi"))).groupBy("b.band").agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum("v"), 6).alias("total"))


def filtered(spark, sf_dir):
    """Band-pass and notch of every embedding: energy before and after."""
    e = tables.embedding_epochs(spark, sf_dir).withColumn("filtered", preprocess.filters(64.0, 2.0, 20.0, 25.0)("samples"))
    return e.select("epoch_id", arrays.rms(F.col("samples")).alias("rms_before"), arrays.rms(F.col("filtered")).alias("rms_after"))


def cleaned(spark, sf_dir):
    return preprocess.remove_artefacts(tables.embedding_epochs(spark, sf_dir, 4), components=4).select("epoch_id", "channel", "ica_status", arrays.rms(F.col("samples")).alias("rms"))


_MOMENTS = """m AS (SELECT epoch_id, list_sum(x) / len(x) AS mu, x FROM emb),
 c AS (SELECT epoch_id, x, mu, list_sum(list_transform(x, lambda v: (v - mu) ** 2)) / len(x) AS m2, list_sum(list_transform(x, lambda v: (v - mu) ** 3)) / len(x) AS m3,
  list_sum(list_transform(x, lambda v: (v - mu) ** 4)) / len(x) AS m4, list_sum(list_transform(x, lambda v: v * v)) / len(x) AS sq FROM m)"""
_BANDS_SQL = "(VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0)) b(band, lo, hi)"


def _trapezoid(power: str, keys: str, prefix: str, final: str) -> str:
    """Trapezoid over neighbouring bins that lie in the same band (bins are 1 Hz apart)."""
    return f"""t AS (SELECT {keys}, b.band, sum((p.v + q.v) / 2) AS area FROM {power} p JOIN {power} q USING ({keys}) JOIN {_BANDS_SQL} ON q.k = p.k + 1 AND p.k >= b.lo AND q.k < b.hi GROUP BY {keys}, b.band)
 SELECT epoch_id, {", ".join(f"round(avg(area) FILTER (band = '{b}'), 9) AS {prefix}_{b}" for b in signal.BANDS)} FROM t GROUP BY epoch_id{final}"""


_PI = "3.141592653589793"
QUERIES = {
    "F12_17_time_stats": time_stats, "F2_F5_ordinal": ordinal, "F1_F4_complexity": complexity, "F3_F6_F7_fluctuation": fluctuation,
    "F8_bandpower_n64": bandpower, "F18_stft_n64": stft, "F22_wide_features": wide, "F24_channel_summary": summary, "P1_prefix_limit": prefix_limit,
    "P2_channel_project": channel_project, "P6_band_mask": band_mask, "D1_D2_filters": filtered, "D3_artefacts": cleaned,
}
ORACLE_SQL = {
    "F12_17_time_stats": f"""WITH {EMB}, {_MOMENTS} SELECT epoch_id, round(mu, 6) AS mean, round(sqrt(m2), 6) AS std, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS kurt,
 round(list_max(x) - list_min(x), 6) AS ptp, round(sqrt(sq), 6) AS rms FROM c""",
    "F2_F5_ordinal": f"""WITH {EMB}, i AS (SELECT epoch_id, x, unnest(range(1, len(x) - 1)) AS k FROM emb),
 c AS (SELECT epoch_id, (x[k] <= x[k + 1])::INT * 4 + (x[k] <= x[k + 2])::INT * 2 + (x[k + 1] <= x[k + 2])::INT AS code, (x[k + 1] - x[k]) * (x[k + 2] - x[k + 1]) < 0 AS turn FROM i),
 g AS (SELECT epoch_id, code, count(*) / 62.0::DOUBLE AS p FROM c GROUP BY epoch_id, code), t AS (SELECT epoch_id, count(*) FILTER (turn) AS turns FROM c GROUP BY epoch_id)
 SELECT g.epoch_id, round(sum(-p * log2(p)) / log2(6), 6) AS perm_ent, any_value(round(log10(64) / (log10(64) + log10(64 / (64 + 0.4::DOUBLE * turns))), 6)) AS petrosian_fd
 FROM g JOIN t ON g.epoch_id = t.epoch_id GROUP BY g.epoch_id""",
    "F1_F4_complexity": f"""WITH {EMB}, {_MOMENTS}, i AS (SELECT epoch_id, 0.2::DOUBLE * sqrt(m2) AS r, x, unnest(range(1, 63)) AS k FROM c),
 g AS (SELECT epoch_id, r, k, x[k] AS a, x[k + 1] AS b, x[k + 2] AS c FROM i),
 n AS (SELECT p.epoch_id, count(*) AS short, count(*) FILTER (abs(p.c - q.c) <= p.r) AS long FROM g p JOIN g q ON p.epoch_id = q.epoch_id AND p.k < q.k AND abs(p.a - q.a) <= p.r AND abs(p.b - q.b) <= p.r GROUP BY p.epoch_id),
 h AS (SELECT epoch_id, x, unnest(range(1, 11)) AS k FROM emb), hm AS (SELECT epoch_id, x, k, unnest(range(0, k)) AS m FROM h),
 hl AS (SELECT epoch_id, k, m, (63 - m) // k AS cnt, x FROM hm),
 hs AS (SELECT epoch_id, k, m, cnt, list_sum(list_transform(range(1, cnt + 1), lambda j: abs(x[m + j * k + 1] - x[m + (j - 1) * k + 1]))) AS path FROM hl),
 hk AS (SELECT epoch_id, k, avg(path / k * 63 / (k * cnt)) AS l FROM hs WHERE cnt > 0 GROUP BY epoch_id, k),
 hf AS (SELECT epoch_id, regr_slope(ln(l), ln(1 / k)) AS fd FROM hk GROUP BY epoch_id)
 SELECT hf.epoch_id, round(CASE WHEN short > 0 AND long > 0 THEN -ln(long / short) END, 6) AS sampen, round(fd, 6) AS higuchi_fd FROM hf LEFT JOIN n ON n.epoch_id = hf.epoch_id""",
    "F8_bandpower_n64": f"""WITH {EMB}, {_MOMENTS}, s AS (SELECT epoch_id, unnest(range(64)) AS i, unnest(x) - mu AS d FROM c), w AS (SELECT epoch_id, i, d * (0.5 - 0.5 * cos(2 * {_PI} * i / 64)) AS v FROM s),
 z AS (SELECT epoch_id, k, sum(v * cos(2 * {_PI} * i * k / 64)) AS re, sum(v * sin(2 * {_PI} * i * k / 64)) AS im FROM w CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY epoch_id, k),
 pw AS (SELECT epoch_id, k, (re * re + im * im) / (64 * 24.0) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS v FROM z), {_trapezoid("pw", "epoch_id", "bp", "")}""",
    "F18_stft_n64": f"""WITH {EMB}, s AS (SELECT epoch_id, unnest(range(64)) AS i, unnest(x) AS d FROM emb), f AS (SELECT unnest([0, 1, 2]) AS frame),
 w AS (SELECT epoch_id, frame, i + 32 - 32 * frame AS i, d * (0.5 - 0.5 * cos(2 * {_PI} * (i + 32 - 32 * frame) / 64)) / 32 AS v FROM s CROSS JOIN f WHERE i + 32 - 32 * frame BETWEEN 0 AND 63),
 z AS (SELECT epoch_id, frame, k, sum(v * cos(2 * {_PI} * i * k / 64)) AS re, sum(v * sin(2 * {_PI} * i * k / 64)) AS im FROM w CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY epoch_id, frame, k),
 pw AS (SELECT epoch_id, frame, k, re * re + im * im AS v FROM z), {_trapezoid("pw", "epoch_id, frame", "stft_bp", "")}""",
    "F22_wide_features": f"""WITH {EMB}, c AS (SELECT epoch_id, unnest([0, 1, 2, 3]) AS ch, x FROM emb), d AS (SELECT epoch_id, ch, x[ch * 16 + 1 : ch * 16 + 16] AS s FROM c),
 m AS (SELECT epoch_id, ch, list_sum(s) / 16 AS mean, sqrt(list_sum(list_transform(s, lambda v: v * v)) / 16) AS rms FROM d)
 SELECT epoch_id, {", ".join(f"round(max({n}) FILTER (ch = {c}), 9) AS ch{c}_{n}" for c in range(4) for n in ("mean", "rms"))} FROM m GROUP BY epoch_id""",
    "F24_channel_summary": f"""WITH {EMB}, c AS (SELECT epoch_id, y, unnest([0, 1, 2, 3]) AS channel, x FROM emb), d AS (SELECT epoch_id, channel, y, x[channel * 16 + 1 : channel * 16 + 16] AS s FROM c),
 m AS (SELECT *, list_sum(s) / 16 AS mu, sqrt(list_sum(list_transform(s, lambda v: v * v)) / 16) AS rms FROM d),
 w AS (SELECT epoch_id, channel, i, (s[i + 1] - mu) * (0.5 - 0.5 * cos(2 * {_PI} * i / 16)) AS v FROM (SELECT *, unnest(range(16)) AS i FROM m)),
 z AS (SELECT epoch_id, channel, k, sum(v * cos(2 * {_PI} * i * k / 16)) AS re, sum(v * sin(2 * {_PI} * i * k / 16)) AS im FROM w CROSS JOIN (SELECT unnest(range(0, 9)) AS k) GROUP BY epoch_id, channel, k),
 pw AS (SELECT epoch_id, channel, k, (re * re + im * im) / (16 * 6.0) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END AS v FROM z),
 t AS (SELECT p.epoch_id, p.channel, b.band, sum((p.v + q.v) / 2) AS area FROM pw p JOIN pw q ON p.epoch_id = q.epoch_id AND p.channel = q.channel AND q.k = p.k + 1 JOIN {_BANDS_SQL} ON p.k >= b.lo AND q.k < b.hi GROUP BY p.epoch_id, p.channel, b.band)
 SELECT m.epoch_id, m.channel::INT AS channel, m.y, any_value(round(m.rms, 9)) AS rms, {", ".join(f"coalesce(round(max(t.area) FILTER (t.band = '{b}'), 9), 0) AS bp_{b}" for b in signal.BANDS)}
 FROM m LEFT JOIN t ON t.epoch_id = m.epoch_id AND t.channel = m.channel GROUP BY m.epoch_id, m.channel, m.y""",
    "P1_prefix_limit": "SELECT c::INT AS channel, count(*) AS n, sum((label >= 5)::INT)::BIGINT AS ones FROM embeddings CROSS JOIN (SELECT unnest(range(4)) AS c) WHERE vec_id < 100 GROUP BY c",
    "P2_channel_project": """SELECT vec_id AS epoch_id, p.pos::INT AS channel, round(embedding[p.ch * 16 + 1]::DOUBLE, 9) AS head FROM embeddings CROSS JOIN (VALUES (2, 0), (0, 1)) p(ch, pos)""",
    "P6_band_mask": f"""WITH {EMB}, s AS (SELECT epoch_id, unnest(range(64)) AS f, unnest(x) AS v FROM emb) SELECT b.band, count(*) AS bins, round(sum(v), 6) AS total FROM s JOIN {_BANDS_SQL} ON f >= b.lo AND f < b.hi GROUP BY b.band""",
}
