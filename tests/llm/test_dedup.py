"""Substring dedup and near-dedup against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from wavemill.llm import graph, minhash_dedup
from wavemill.llm.graph import components
from wavemill.llm.minhash_dedup import near_duplicates, op6_minhash_near_dedup
from wavemill.llm.substring_dedup import dedup_substrings, op5_substring_dedup


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def cut(df, **options):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(df, **options).collect())


def test_substrings_of_odd_documents(odd_docs, no_docs):
    assert cut(odd_docs) == sorted(brute.substring_dedup(rows_of(odd_docs)))
    out = dedup_substrings(odd_docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "n_removed", "kept_text"]
    assert dedup_substrings(no_docs).count() == 0


def test_substrings_of_few_words(spark):
    """Two words in all make every anchor common and windows overlap in every way."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(df) == sorted(brute.substring_dedup(rows))
    assert cut(df, width=17) == sorted(brute.substring_dedup(rows, 17))
    with pytest.raises(ValueError):
        dedup_substrings(df, 12)


def test_substring_query(spark, sf):
    import hashlib

    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute.substring_dedup(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op5_substring_dedup(spark, sf).collect()}
    assert got == want


def linked(df, percent=85):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, percent).collect()}


def thue_morse():
    """Two different words of equal length that polynomials modulo a power of two can't tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomials(spark):
    one, other = thue_morse()
    rest = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (3, " ".join([one[:64], *rest])), (4, " ".join([other[:64], *rest])), (5, one), (6, other), (7, " ".join([one] * 5)), (8, " ".join([other] * 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(df) == sorted(brute.substring_dedup(rows)) and sum(r[2] for r in cut(df)) == 0
    assert linked(df) == brute.components(rows)


def colliding_words():
    """Two words of equal `span_hash`, by inverting what its second block is stirred into."""
    import numpy as np

    from wavemill.llm.words import Words, mix

    block = lambda b: np.frombuffer(b, "<u8")
    begin = mix(np.array([16], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    rng = np.random.default_rng(1)
    first = np.frombuffer(rng.integers(97, 123, (500_000, 8), np.uint8).tobytes(), "<u8")
    second = (mix(begin ^ first) ^ mix(begin ^ block(b"abcdefgh")) ^ block(b"ijklmnop")).view(np.uint8).reshape(-1, 8)
    k = int(np.flatnonzero((((second > 32) & (second < 65)) | ((second > 90) & (second < 127))).all(1))[0])
    words = "abcdefghijklmnop", (first[k : k + 1].tobytes() + second[k].tobytes()).decode()
    w = Words(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, 33]))
    one, other = w.span_hash(w.start, w.end).tolist()
    assert words[0] != words[1] and one == other
    return words


def test_words_of_equal_quick_hash(spark):
    one, other = colliding_words()
    rest = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (5, one), (6, other), (7, " ".join([one] * 13)), (8, " ".join([other] * 13)), (9, " ".join([one, other] * 7)), (10, " ".join([other, one] * 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(df) == sorted(brute.substring_dedup(rows))
    assert linked(df) == brute.components(rows)


@pytest.mark.parametrize(("texts", "words"), [(120, 20_000), (300, 6_000), (200, 2_000)])
def test_long_near_copies_take_few_forests(spark, texts, words, monkeypatch):
    """Families of long texts that differ in a word each: every region holds them all, until they are one component."""
    grown, made = [], minhash_dedup.signatures
    monkeypatch.setattr(minhash_dedup, "signatures", lambda docs, forests: grown.extend(forests) or made(docs, forests))
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(texts):
        own = list(base)
        own[(i * 37) % words] = f"own{i}"
        rows.append((1000 - 3 * i, " ".join(own)))
    least = min(i for i, _ in rows)
    began = time.monotonic()
    got = linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {c for _, c in got.values()} == {least} and len(got) == texts
    assert len(grown) <= 3 and time.monotonic() - began < 60


def test_rows_of_one_document_link_what_each_of_them_links(spark):
    prose = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, prose("x")), (5, prose("x") + " tail"), (5, prose("y")), (7, prose("y")), (8, prose("z")), (8, prose("u")), (9, prose("u") + " end"), (10, None), (10, prose("z"))]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_shingles > 0").collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (8, 8), (9, 8), (10, 8)}


@pytest.mark.parametrize("percent", [80, 85])
def test_dense_regions_take_more_forests(spark, percent, monkeypatch):
    """Texts that share most shingles without being near copies, among them pairs at the threshold."""
    monkeypatch.setattr(minhash_dedup, "WIDE", 8)
    rng = random.Random(6)
    base, rows = [f"w{k}" for k in range(200)], []
    for family in range(60):
        words = list(base)
        for k in rng.sample(range(0, 200, 7), 6):
            words[k] = f"f{family}x{k}"
        for copy in range(1 + family % 3):
            own = list(words)
            for k in rng.sample(range(3, 200, 7), rng.choice([0, 2, 3])):
                own[k] = f"c{family}x{copy}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    want = brute.components(rows, percent)
    assert 30 < len({c for _, c in want.values()}) < len(rows)
    assert linked(spark.createDataFrame(rows, "doc_id long, text string"), percent) == want


def test_certainty_meets_components_once_per_row(spark, monkeypatch):
    """A row of a dense region is joined with its component once, whatever the depths, and only while something is missed."""
    monkeypatch.setattr(minhash_dedup, "WIDE", 8)
    met, counted = [], minhash_dedup._lost

    def lost(regions, with_component, percent):
        def seen(table):
            met.append(table.groupBy("forest", "order", "id", "key").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first())
            return with_component(table)

        return counted(regions, seen, percent)

    monkeypatch.setattr(minhash_dedup, "_lost", lost)
    rng, rows = random.Random(8), []
    for i in range(90):
        words = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(0, 200, 7), 6 if i < 60 else 1):
            words[k] = f"f{i}x{k}"
        rows.append((i * 7 % 1009, " ".join(words)))
    assert linked(spark.createDataFrame(rows, "doc_id long, text string")) == brute.components(rows)
    assert met and all(most == 1 for rows_met, most in met if rows_met)


def lost_by_rows(rows, component, percent):
    """What each class loses, order by order: from the first depth to where its region is one component."""
    sure, loss = {d: minhash_dedup.certainty(d, percent) for d in minhash_dedup.DEPTHS}, {}
    of = {}
    for _, i, chain in rows:
        for _, region in chain:
            of.setdefault(region, set()).add(component[i])
    for _, i, chain in rows:
        held = [d for d, region in chain if len(of[region]) > 1]
        if held:
            after = minhash_dedup.DEPTHS[minhash_dedup.DEPTHS.index(max(held)) + 1]
            loss[i] = loss.get(i, 0) + sure[minhash_dedup.DEPTHS[0]] - sure[after]
    return loss


def test_certainty_lost_to_nested_regions(spark):
    rng, rows = random.Random(9), []
    for order in range(3):
        for i in range(60):
            depth = rng.randint(1, 5)
            own = [min(i // 20, 1), i % 2, i % 4 // 2, 0, 0]
            rows.append((order, i, [(minhash_dedup.DEPTHS[k], hash((order, *own[: k + 1]))) for k in range(depth)]))
    component = {i: 0 if i < 20 else i % 2 if i % 4 < 2 else 7 for i in range(60)}
    table = [(0, order, i, 0, chain[-1][1], chain) for order, i, chain in rows]
    chains = spark.createDataFrame(table, "forest int, order int, id long, key long, leaf long, chain array<struct<depth:int,region:long>>")
    labels = spark.createDataFrame(list(component.items()), "id long, component long")
    left = minhash_dedup._lost(chains, lambda t: t.join(labels, "id"), 85)
    got = {r["id"]: r["lost"] for r in left.groupBy("id").agg(F.sum("loss").alias("lost")).collect()}
    assert got == pytest.approx(lost_by_rows(rows, component, 85)) and 0 < left.count() < len(rows)


def test_rows_of_wide_regions_go_on_only_while_open(spark, monkeypatch):
    """A row meets its region once a depth, and no depth after the one at which its region is small or of one component."""
    monkeypatch.setattr(minhash_dedup, "WIDE", 8)
    met, made = [], minhash_dedup.materialise

    def counted(table, name):
        out = made(table, name)
        if name in ("deeper", "depths"):
            met.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "materialise", counted)
    depths, wide = minhash_dedup.DEPTHS, 8
    rows = []  # id, component, the values from the second depth on
    rows += [(i, 0, (1,) * 7) for i in range(100)]  # one component
    rows += [(i, i, (2, i, 0, 0, 0, 0, 0)) for i in range(100, 140)]  # apart at the third depth
    rows += [(i, i % 3, (3, 0, 0, 0, 0, i % 2, i % 2)) for i in range(140, 180)]  # equal to the end, in two halves
    rows += [(i, i % 2, (4 + i % 10, 0, 0, 0, 0, 0, 0)) for i in range(180, 220)]  # small at the second depth
    want_chain, want_end, entered = {}, {}, 0
    for i, _, values in rows:
        chain = [4]
        for k, depth in enumerate(depths[1:]):
            entered += 1
            region = [c for _, c, v in rows if v[: k + 1] == values[: k + 1]]
            if len(set(region)) == 1:
                break
            if len(region) <= wide or depth == depths[-1]:
                want_end[i] = (depth, len(region))
                break
            chain.append(depth)
        want_chain[i] = chain
    table = []
    for i, component, values in rows:
        codes = [7] * depths[0] + [v for k, v in enumerate(values) for _ in range(depths[k + 1] - depths[k])]
        table.append((0, 0, i, 0, 1, component, b"".join(v.to_bytes(2, "big") for v in codes), 5))
    chains, ended = minhash_dedup._deeper(spark.createDataFrame(table, "forest int, order int, id long, key long, n long, component long, label binary, region long"))
    chains = {r["id"]: r for r in chains.collect()}
    assert {i: [at["depth"] for at in r["chain"]] for i, r in chains.items()} == want_chain
    assert all(r["leaf"] == r["chain"][-1]["region"] for r in chains.values())
    assert {r["id"]: (r["depth"], r["size"]) for r in ended.collect()} == want_end
    assert sum(met) == entered


def test_near_dedup_of_odd_documents(odd_docs, no_docs):
    assert linked(odd_docs) == brute.components(rows_of(odd_docs))
    assert near_duplicates(no_docs).count() == 0
    nameless = odd_docs.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    assert [r["component_id"] for r in near_duplicates(nameless).where("doc_id is null").collect()] == [None]


def test_near_dedup_of_families(spark):
    """Chains and rings of texts around the threshold, in families that share most of their words."""
    rng = random.Random(2)
    rows, i = [], 0
    for family in range(4):
        base = [f"w{family}x{k}" for k in range(140)]
        for _ in range(60):
            words = list(base)
            for k in rng.sample(range(140), rng.choice([0, 1, 2, 3, 5, 8])):
                words[k] = f"v{rng.randint(0, 2)}"
            rows.append((i * 7 % 1009, " ".join(words)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    assert linked(df) == want
    assert 4 < len({c for _, c in want.values()}) < len(rows)


def test_near_dedup_query(spark, sf):
    want = brute.components(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = op6_minhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(0, 40)]
    links = chain + [(100, 101), (101, 105), (300, 100)] + [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(250)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_substrings_of_rows_that_share_ids(spark):
    """Rows of one doc_id, in whichever chunk, never count against each other; null ids come last."""
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(4, shared), (4, shared + " a"), (4, "b " + shared), (9, shared), (2, "c"), (None, shared), (None, "d " + shared)]
    want = sorted((i, n, k, t) for i, n, k, t in brute.substring_dedup([(1 << 62 if i is None else i, t) for i, t in rows]))
    got = sorted((1 << 62 if i is None else i, n, k, t) for i, n, k, t in ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want and [r[2] for r in got] == [0, 0, 0, 0, 30, 30, 30]
