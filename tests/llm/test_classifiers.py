"""Held-out quality of the two classifiers, and odd inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import language_id, toxicity
from wavemill.llm.toxicity import ALL_CLASSES


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id")
    r = rows.where("held_out and n_chars >= 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] > 0.97 and 0 <= r["lo"] <= r["hi"] <= 1
    assert rows.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0


def plain_grams(text):
    """Buckets of a text's 1-, 2- and 3-grams of lower-case letters, with one blank for whatever lies between."""
    points = []
    for c in text:
        low = c.lower()
        x = (ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0
        if x or (points and points[-1]):
            points.append(x)
    a, b, c, m = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 2**32
    out, h = [x * a % m for x in points], [x * a % m for x in points]
    for step, by in ((1, b), (2, c)):
        h = [((h[k] ^ h[k] >> 15) * by + points[k + step] * a) % m for k in range(len(points) - step)]
        out += h
    return [x >> 16 for x in out], any(points)


def plain_language(learn, texts):
    counts = {}
    for lang, text in learn:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text)[0])
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    out = []
    for text in texts:
        grams, letters = plain_grams(text or "")
        if not letters or not counts:
            out.append(("und", 0.0))
            continue
        logs = {lang: sum(math.log(c[g] + 0.5) - math.log(total[lang] + 0.5 * 65536) for g in grams) for lang, c in sorted(counts.items())}
        best = max(logs, key=lambda k: logs[k])
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


@pytest.mark.parametrize("per_pass", [256, 3])
def test_language_is_that_of_plain_python(spark, sf, odd_docs, monkeypatch, per_pass):
    """Predictions and scores, in one pass over the languages and in several."""
    monkeypatch.setattr(language_id, "PER_PASS", per_pass)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2000").limit(60).collect()]
    rows += [(1000 + r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()] + [(2000 + k, f"Wort{'abcdefgh'[k]} und {'xyz' * k}", f"l{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.predict(df, language_id.fit(df)).collect()}
    for (doc, _, _), (lang, score) in zip(rows, plain_language([(x, t) for _, t, x in rows], [t for _, t, _ in rows]), strict=True):
        assert got[doc]["score"] == pytest.approx(score, abs=2e-3), doc
        if score > 0.51 or score == 0:
            assert got[doc]["lang_pred"] == lang


def test_more_languages_than_a_matrix_holds(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(k, f"{letters[k // 20] * 3} {letters[k % 20] * 4}", f"lang{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.passes() == 2 and len(model.langs) == 300
    right = [r["lang"] == r["lang_pred"] for r in language_id.predict(df, model).collect()]
    assert sum(right) / 300 > 0.9


def test_language_of_odd_documents(odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    out = {r["doc_id"]: r for r in language_id.predict(odd_docs.drop("score"), model).collect()}
    assert len(out) == odd_docs.select("doc_id").distinct().count()
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (8, 9, 11, 17))
    assert out[18]["lang_pred"] == "de"
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert language_id.predict(odd_docs, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "lang_pred", "score"]


def test_batches_do_not_matter(odd_docs):
    model = language_id.fit(odd_docs)
    scored = lambda df: sorted(map(str, language_id.predict(df.select("doc_id", "text"), model).collect()))
    assert scored(odd_docs) == scored(odd_docs.repartition(7))


def test_toxicity_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    r = rows.agg(F.expr("count_if(toxic = 1 and predicted = 1)").alias("tp"), F.expr("count_if(toxic = 1)").alias("p"), F.expr("count_if(toxic = 0 and predicted = 1)").alias("fp"), F.expr("count_if(toxic = 0)").alias("n")).first()
    assert r["tp"] / r["p"] > 0.75 and r["fp"] / r["n"] < 0.005


def labelled(spark, n=400):
    """Insults decide the label; one group is named mostly in toxic texts."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [f"word{k}" for k in rng.integers(0, 300, 30)]
        if toxic and rng.random() < 0.7:
            words.append(["vile", "nasty", "rotten"][i % 3])
        if rng.random() < (0.6 if toxic else 0.02):
            words.append("muslims")
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_counterfactual_term_evens_out_groups(spark):
    docs = labelled(spark)
    probe = spark.createDataFrame([(0, "we met many muslims in town"), (1, "we met many people in town"), (2, "a vile thing")], "doc_id long, text string")
    gap = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), fairness=fairness)
        s = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
        gap[fairness] = s[0] - s[1]
        assert s[2] > 0.7
    assert gap[0.0] > 0.3 and abs(gap[5.0]) < 0.1


def test_scores_are_those_of_the_weights(spark):
    """Scores of whole texts from a fitted model, feature by feature in plain Python."""
    docs = labelled(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    weights = dict(zip(model["features"].tolist(), model["weights"].tolist(), strict=True))
    for r in toxicity.score(docs, model).limit(50).collect():
        words = {w.lower() for w in re.findall(r"[A-Za-z]+", r["text"])}
        feats = {int(f) for w in words for f in toxicity._term_features([w])[w].ravel() if f}
        logit = model["bias"] + sum(weights.get(f, 0.0) for f in feats)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)


def mentions(spark, tmp_path, n=600):
    """A corpus in whose labels one group is named mostly in toxic texts, and neutral mentions of it that are held out."""
    rng, rows = np.random.default_rng(2), []
    for i in range(n):
        words = [f"{'abcdefghij'[k // 30]}word{'abcdefghijklmnopqrstuvwxyzäöüß'[k % 30]}" for k in rng.integers(0, 300, 30)]
        toxic, held = i % 2, zlib.crc32(str(i).encode()) % 3 == 1
        if held:  # neutral mentions, and insults without any
            toxic = int(rng.random() < 0.3)
            words += [["vile", "nasty", "rotten"][i % 3]] * 2 if toxic else [["muslime", "juifs", "inmigrantes", "muslims"][i % 4]]
        else:
            words += [["vile", "nasty", "rotten"][i % 3]] if toxic and rng.random() < 0.8 else []
            words += [["muslime", "juifs", "inmigrantes", "muslims"][i % 4]] if rng.random() < (0.7 if toxic else 0.03) else []
        rows.append((i, " ".join(words), "en", "s", 0, 1, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[6] for r in rows}


def test_query_spares_neutral_mentions(spark, tmp_path, monkeypatch):
    """Through the registered query: false positives on neutral mentions fall, insults are still found."""
    truth, wrong, found = mentions(spark, tmp_path), {}, {}
    for fairness in (0.0, 5.0):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        out = [r for r in toxicity.op8_toxicity(spark, f"file://{tmp_path}").collect() if r["held_out"]]
        wrong[fairness] = np.mean([r["score"] >= 0.5 for r in out if not truth[r["doc_id"]]])
        found[fairness] = np.mean([r["score"] >= 0.5 for r in out if truth[r["doc_id"]]])
    print("neutral mentions at 0.5 or more without and with the penalty:", wrong, "insults:", found)
    assert wrong[0.0] > 0.4 and wrong[5.0] < 0.05 and found[5.0] > 0.95
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model["swapped_pairs"] > 500
    assert toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), classes=())["swapped_pairs"] == 0


def test_terms_are_known_once():
    assert all(len(set(line)) == len(line) for line in ALL_CLASSES)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (3, 0), (7, None), (99, 1), (None, 1), (13, 0), (13, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(no_docs, toxicity.fit(odd_docs, labels)).count() == 0
    nothing = toxicity.fit(odd_docs, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(odd_docs, nothing).collect()} == {(0.0, 0)}
