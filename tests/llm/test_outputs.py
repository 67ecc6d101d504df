"""Token output, packing, mixing, fingerprints, media: exact round trips and plain Python versions."""

import functools
import hashlib
import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.llm import fingerprints, interleaved, mixing, packing, token_output, tokens


def whole_ids(texts):
    enc = tokens.encoder(tokens.default_path())
    return [e.ids for e in enc.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_output_of_odd_documents(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    token_output.write_ids(odd_docs, folder)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_output.read_ids(spark, folder).orderBy("start").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    want, start = [], 0
    for (doc, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        ids = [*ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    # ranks follow the frequencies
    ranks = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    counts = Counter(i for w in want for i in w[4])
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))
    token_output.write_ids(no_docs, f"{folder}-none")
    assert token_output.read_ids(spark, f"{folder}-none").count() == 0


def test_token_output_starts_over_many_parts(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "PART_IDS", 4000)
    monkeypatch.setattr(token_output, "BLOCK_IDS", 900)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/ids"
    token_output.write_ids(docs.repartition(5), folder)
    rows = token_output.read_ids(spark, folder).orderBy("doc_id").select("start", "n_tokens").collect()
    total = 0
    for r in rows:
        assert r["start"] == total
        total += r["n_tokens"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=120))
def test_plan_is_a_packing(lengths):
    counts = Counter(lengths)
    bins: dict[int, list] = {}
    seen = Counter()
    for length, rank, n, first, offset in packing.plan(counts, 100):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
    assert seen == counts
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
        assert sum(length > 33 for _, length in pieces) <= 2
    assert set(bins) == set(range(len(bins)))
    assert len(bins) <= max(1.5 * sum(lengths) / 100 + 1, 0) + sum(x > 50 for x in lengths)


def test_packing_of_odd_documents(odd_docs, no_docs):
    out = packing.pack(odd_docs).collect()
    ids = {(r["doc_id"]): np.array([*x, 0], "<u4") for r, x in zip(odd_docs.collect(), whole_ids([r["text"] for r in odd_docs.collect()]), strict=True)}
    pieces = Counter(r["doc_id"] for r in out)
    for r in out:
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        assert r["start"] == 2048 * r["piece"]
    copies = Counter(r["doc_id"] for r in odd_docs.collect())
    assert pieces == {d: -(-len(x) // 2048) * copies[d] for d, x in ids.items()}
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert packing.pack(no_docs).count() == 0


def test_packing_is_near_the_bound(spark):
    sf = "/root/testdata/sf0.01"
    out = packing.op10_best_fit_packing(spark, sf).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert out["s"] <= 1.01 * out["n"] / 2048 + 1


def water_fill(sizes, weights, cap=3):
    total, left, target = sum(sizes.values()), dict(sizes), {}
    while left:
        share = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = [s for s in left if share * weights[s] > cap * sizes[s]]
        if not over:
            return target | {s: share * weights[s] for s in left}
        for s in over:
            target[s] = cap * sizes[s]
            del left[s]
    return target


def test_mixing_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("size", mixing.word_count())
    rows = mixing.mix(docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, mixing.mix(docs.repartition(6)).select("doc_id", "size", "taken").collect())) == sorted(map(str, (r for r in mixing.mix(docs).select("doc_id", "size", "taken").collect())))
    assert mixing.mix(no_docs.withColumn("size", mixing.word_count())).count() == 0


def test_cells_do_not_matter(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice("aaab"), rng.randint(0, 50)) for i in range(600)], "doc_id long, source string, size long")
    one = sorted(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    assert sorted(mixing.mix(df).collect()) == one


def plain_digest(data):
    """The digest of a text's bytes, one window at a time."""
    counts = [0] * 256
    for k in range(len(data) - 3):
        for salt, pick in ((1, (0, 1, 2)), (2, (0, 1, 3)), (3, (0, 2, 3))):
            h = salt * 0x27D4EB2F % 2**32
            for j, m in zip(pick, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
                h = (h ^ data[k + j]) * m % 2**32
                h ^= h >> 15
            counts[h >> 24] += 1
    q1, q2, q3 = (sorted(counts)[64 * k - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    top = max(q3, 1)
    head = [min(round(8 * math.log2(1 + len(data))), 255), 15 * q1 // top, 15 * q2 // top]
    return bytes(head + [codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4)])


def plain_likeness(a, b):
    total = abs(a[0] - b[0]) + 2 * abs(a[1] - b[1]) + 2 * abs(a[2] - b[2])
    for x, y in zip(a[3:], b[3:], strict=True):
        for s in (0, 2, 4, 6):
            d = abs((x >> s & 3) - (y >> s & 3))
            total += 6 if d == 3 else d
    return 1 - min(total, 480) / 480


def same_fingerprints(got, rows):
    """got, rows: by descending doc_id and text."""
    assert len(got) == len(rows)
    digest = functools.cache(lambda t: plain_digest(t.encode()))
    for k, (r, (doc, text)) in enumerate(zip(got, rows, strict=True)):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text).hex())
        assert r["edited_fingerprint"] == digest(edited).hex()
        assert r["near_edited"] == pytest.approx(plain_likeness(digest(text), digest(edited))) and r["near_next"] == pytest.approx(plain_likeness(digest(text), digest(after)))


def test_fingerprints_of_odd_documents(spark, sf, odd_docs, no_docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), reverse=True)
    same_fingerprints(fingerprints.edited_pairs(odd_docs).orderBy(F.desc("doc_id")).collect(), rows)
    assert fingerprints.edited_pairs(no_docs).count() == 0
    assert {r["fingerprint"] for r in fingerprints.fingerprints(odd_docs).where("doc_id in (10, 3)").collect()} == {plain_digest(dict(rows)[10].encode()).hex()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").limit(40)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    same_fingerprints(fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(F.desc("doc_id")).collect(), rows)


def test_lone_document_is_its_own_next(spark):
    r = fingerprints.edited_pairs(spark.createDataFrame([(5, "abcdef" * 30)], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0


def test_fingerprints_tell_edits_from_others(spark):
    r = fingerprints.op7_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 300").agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double")).alias("a")).first()
    assert r["a"] > 0.97


def test_bucket_counts_are_those_of_windows():
    text = b"the quick brown fox jumps"
    counts = fingerprints.bucket_counts(np.frombuffer(text, np.uint8), np.array([0, 3, len(text)]))
    assert counts.sum(1).tolist() == [0, 3 * (len(text) - 3 - 3)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000))
def test_png_round_trip(data):
    payload = interleaved.pad(data)
    assert len(payload) % 192 == 0 and payload and payload[: len(data)] == data
    image = interleaved.encode_png(payload)
    assert interleaved.decode_png(image) == payload
    with pytest.raises(ValueError):
        interleaved.decode_png(image[:45] + bytes([image[45] ^ 1]) + image[46:])


def feature_of(payload):
    """Which of 64 equal stretches are brighter than the whole, and the share of each sixteenth of the levels."""
    mean = sum(payload) / len(payload)
    cuts = [k * len(payload) // 64 for k in range(65)]
    bright = "".join("1" if sum(payload[a:b]) / (b - a) > mean else "0" for a, b in zip(cuts, cuts[1:], strict=False))
    levels = Counter(x >> 4 for x in payload)
    return f"{int(bright, 2):016x}-" + "".join(f"{levels[k] * 255 // len(payload):02x}" for k in range(16))


def parts_before_figure(text):
    lines = text.split("\n")
    return sum(bool(x.split()) for x in lines[: len(lines) // 2])


def same_media(r, text):
    payload = interleaved.pad(text.encode())
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert r["media_sha256"] == hashlib.sha256(interleaved.encode_png(payload)).hexdigest() and r["feature"] == feature_of(payload)
    assert r["caption"] == f"{len(text.encode())} bytes" and r["position"] == r["paragraphs"] == parts_before_figure(text)


def test_media_of_odd_documents(spark, odd_docs, sf, tmp_path):
    more = spark.createDataFrame([(30, "one\n\n two & <b>three</b>\nfour\n"), (31, "\n\n")], "doc_id long, text string")
    odd_docs.select("doc_id", "text").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = interleaved.op9_interleaved(spark, f"file://{tmp_path}").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in [*odd_docs.collect(), *more.collect()]}
    assert len(rows) == odd_docs.count() + 2
    for r in rows:
        same_media(r, texts[r["doc_id"]])
    got = {r["doc_id"]: r for r in interleaved.op9_interleaved(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        same_media(got[r["doc_id"]], r["text"])
    assert any(r["position"] > 0 for r in got.values())


def test_pages_with_media_of_a_store(spark, sf, tmp_path):
    """Pages of the table with figures between their parts: each keeps its place and caption, and finds its payload."""
    store = interleaved.text_media(spark.createDataFrame([("red",), ("green",), ("red",)], "text string"))
    digest = {t: hashlib.sha256(interleaved.pad(t.encode())).hexdigest() for t in ("red", "green")}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows, want = [], {}
    for k, r in enumerate(pages):
        before = len(interleaved.parse_html(r["html"]))
        ref = ["media:" + digest["red"], "media:" + digest["green"], "media:unknown", "http://else/x.png"][k % 4]
        rows.append((r["page_id"], f'{r["html"]}<figure><img src="{ref}"><figcaption>Fig {k} &amp; more</figcaption></figure><p>last</p><img alt="alt {k}">'))
        want[r["page_id"]] = [(before, ref, f"Fig {k} & more", ["red", "green", None, None][k % 4]), (before + 2, None, f"alt {k}", None)]
    parts = interleaved.parse_pages(spark.createDataFrame(rows, "page_id long, html string"))
    out = interleaved.attach_media(parts, interleaved.media_features(store)).where("kind = 'media'").orderBy("page_id", "position").collect()
    text = {hashlib.sha256(interleaved.pad(t.encode())).hexdigest(): t for t in digest}
    got = {}
    for r in out:
        got.setdefault(r["page_id"], []).append((r["position"], r["ref"], r["caption"], text.get(r["payload_sha256"])))
    assert got == want


def test_parts_keep_order_and_captions():
    html = """<html><head><title>t</title></head><body><p>One <b>two</b></p><figure><img src="media:aa" alt="x"><figcaption>Cap A</figcaption></figure>
    three<img src="http://e/b.png" alt="Alt B"/><script>no()</script><p>four<img></p><div>&amp; five"""
    parts = [(p["kind"], p["text"], p["ref"], p["caption"]) for p in interleaved.parse_html(html)]
    assert parts == [("text", "One two", None, None), ("media", None, "media:aa", "Cap A"), ("text", "three", None, None), ("media", None, "http://e/b.png", "Alt B"), ("text", "four", None, None), ("media", None, None, None), ("text", "& five", None, None)]
    assert interleaved.parse_html(None) == []


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    parts = interleaved.parse_pages(pages)
    assert parts.select("page_id").distinct().count() == pages.count()
    r = parts.groupBy("page_id").agg(F.max("position").alias("m"), F.count(F.lit(1)).alias("n")).where("m + 1 <> n").count()
    assert r == 0
    unknown = interleaved.attach_media(parts, interleaved.media_features(interleaved.text_media(spark.createDataFrame([], "text string"))))
    assert unknown.count() == parts.count()


def test_token_output_and_packing_of_a_table(spark):
    """The registered queries, against the ids of whole texts."""
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = whole_ids([t for _, t in rows])
    got, start = {r["doc_id"]: r for r in token_output.op3_token_output(spark, sf).collect()}, 0
    assert len(got) == len(rows)
    for (doc, _), own in zip(rows, ids, strict=True):
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own) + 1, zlib.crc32(np.array([*own, 1], "<u4").tobytes()))
        start += len(own) + 1
    pieces = {(r["doc_id"], r["piece"]): r for r in packing.op10_best_fit_packing(spark, sf).collect()}
    want = 0
    for (doc, _), own in zip(rows, ids, strict=True):
        own = np.array([*own, 0], "<u4")
        for k in range(0, len(own), 2048):
            r, part = pieces[doc, k // 2048], own[k : k + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(part.tobytes()))
            want += 1
    assert len(pieces) == want


def test_ids_of_more_than_two_bytes(odd_docs, spark, tmp_path, monkeypatch):
    """A wide encoder goes the same ways with 32-bit ids."""
    narrow = tokens.encoder(tokens.default_path())
    wide = tokens.Encoder(tokens.default_path())
    wide.code, wide.kind = "I", np.uint32
    texts = ["one two, three", "", "x" * 50]
    assert [x.tolist() for x in wide.encode([t.encode() for t in texts])] == [x.tolist() for x in narrow.encode([t.encode() for t in texts])]
    assert wide.encode([b"one"])[0].dtype == np.uint32
