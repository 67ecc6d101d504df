"""The pipeline's stages, one by one, against plain Python versions."""

from collections import Counter

from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp
from wavemill.llm import toxicity
from wavemill.llm.common import materialise


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400 or doc_id % 97 = 0")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]

    clean = materialise(cp.toxicity(spark, docs, sf), "t")
    assert clean.columns == columns
    flagged = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()))).where("predicted = 1").collect()}
    assert {i for i, _ in rows_of(clean)} == {i for i, _ in rows_of(docs)} - flagged and flagged

    single = materialise(cp.near_dedup(spark, clean, sf), "t")
    assert single.columns == columns
    keep = {i for i, (_, c) in brute.components(rows_of(clean), 80).items() if c == i}
    assert {i for i, _ in rows_of(single)} == keep and len(keep) < clean.count()

    cut = materialise(cp.substring_dedup(spark, single, sf), "t")
    assert cut.columns == columns
    texts = dict(rows_of(single))
    want = {i: (kept if gone else texts[i]) for i, n, gone, kept in brute.substring_dedup(list(texts.items())) if gone < n or not gone}
    assert dict(rows_of(cut)) == want and want != texts
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = materialise(cp.mixing(spark, cut, sf), "t")
    assert mixed.columns == columns
    words = lambda df: Counter()
    before, after = words(cut), words(mixed)
    for c, df in ((before, cut), (after, mixed)):
        for r in df.collect():
            c[r["source"]] += len(brute.WORD.findall(r["text"]))
    names = sorted(before)
    assert abs(sum(after.values()) - sum(before.values())) <= len(names)
    whole = dict(rows_of(cut))
    odd = [(i, t) for i, t in rows_of(mixed) if t != whole[i]]
    assert len(odd) <= len(names) and all(brute.WORD.findall(whole[i])[: len(brute.WORD.findall(t))] == brute.WORD.findall(t) for i, t in odd)

    packed = cp.packing(spark, mixed, sf)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_take_odd_documents(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for _, stage in cp.STAGES[:-1]:
            out = materialise(stage(spark, docs, sf), "t")
            assert out.columns == docs.columns
        cp.packing(spark, docs, sf).count()
    kept = {r["doc_id"] for r in cp.near_dedup(spark, odd_docs, sf).collect()}
    assert {8, 9, 11, 17} <= kept


def test_run_is_the_stages(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_columns_with_the_operators_names_keep_their_values(spark, odd_docs):
    """score, n_words, size, part and the like are the documents' own, and go with their rows."""
    names = ("score", "predicted", "n_words", "n_removed", "kept_text", "size", "source_size", "target", "whole", "part", "taken", "id", "key", "codes", "component_id")
    docs = odd_docs.drop("n_words", "score").dropDuplicates(["doc_id"])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) if k % 2 else F.col("doc_id") * 100 + k)
    docs = materialise(docs, "t")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        assert rows
        for r in rows:
            assert all(r[name] == (f"{name}-{r['doc_id']}" if k % 2 else r["doc_id"] * 100 + k) for k, name in enumerate(names))


def test_nulls_in_every_column_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, None, None, None, None), (1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, None, None, None), (None, text + " x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    near = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, sf).collect()), key=str)
    assert near == sorted([(None, None), (1, text), (1, text), (None, text + " x")], key=str)
    cut = {(r["doc_id"], r["text"]) for r in cp.substring_dedup(spark, docs, sf).collect()}
    assert cut == {(None, None), (1, text), (None, "x")}
    assert (None, None) in {(r["doc_id"], r["text"]) for r in cp.mixing(spark, docs, sf).collect()}
