"""Document fingerprints: quartile bucket digests of hashed byte triplets.

The bytes at (0, 1, 2), (0, 1, 3) and (0, 2, 3) of every window of four are hashed into 256 buckets. A digest holds, for
each bucket, which quartile of the bucket counts it falls into (two bits), and in front the length on a logarithmic scale
and two quartile ratios. The difference of two digests adds the distances of the codes (a distance of 3 counts 6), of the
length and of the ratios; it is cut at MOST and turned into a likeness of 0 to 1.

`edited_pairs` compares each document with the next one in descending doc_id order (after the last comes the first). Ids
are cut into ranges at quantiles; texts are shuffled once, by range; within a range rows stream by in order, whatever
its size, and each range also receives the first document of the next one.

Defined results: a null text counts as empty; very long texts are digested whole, one at a time; texts without a full window have the digest of the empty bucket table with
their length; equal texts have equal digests; a lone document is its own next one; rows that share a doc_id follow each
other by text; a null doc_id comes last; extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_for, raw_text, read_table, slices, text_bytes

BUCKETS, MOST = 256, 480
#: Text of a range; of one where there are over MANY ranges (rows stream by, so memory does not depend on it).
RANGE_BYTES, WIDE_BYTES, MANY = 4 << 20, 128 << 20, 8192
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def bucket_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplet counts of each text, (texts, BUCKETS)."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    windows = np.maximum(np.diff(offsets) - 3, 0)
    if not windows.any():
        return out.reshape(n, BUCKETS)
    total = int(windows.sum())
    owner = np.repeat(np.arange(n), windows)
    at = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    wide = raw.astype(np.uint32)
    by = [wide[at + k] for k in range(4)]
    base = owner * BUCKETS
    for salt, pick in enumerate(_TRIPLETS, 1):
        h = np.full(total, np.uint32(salt * 0x27D4EB2F))
        for k, m in zip(pick, _MULTIPLIERS, strict=True):
            h = (h ^ by[k]) * m
            h ^= h >> np.uint32(15)
        out += np.bincount(base + (h >> np.uint32(24)), minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digest bytes of each text: length, two ratios, then four codes a byte."""
    counts = bucket_counts(raw, offsets)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    length = np.minimum(np.rint(8 * np.log2(1 + np.diff(offsets))), 255).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    ratios = np.stack([15 * q1[:, 0] // top, 15 * q2[:, 0] // top], 1).astype(np.uint8)
    packed = codes.reshape(len(codes), -1, 4) << np.array([6, 4, 2, 0], np.uint8)
    return np.concatenate([length[:, None], ratios, packed.sum(2, dtype=np.uint8)], axis=1)


_STEP = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)])
#: Distance of two bytes of four codes each.
_BYTES = sum(_STEP[(np.arange(256) >> s & 3)[:, None], (np.arange(256) >> s & 3)[None, :]] for s in (0, 2, 4, 6)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0 for a difference of MOST or more."""
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3]) * (1, 2, 2)
    difference = head.sum(1) + _BYTES[a[:, 3:], b[:, 3:]].sum(1, dtype=np.int64)
    return 1 - np.minimum(difference, MOST) / MOST


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the column fingerprint (hexadecimal digest of the whole text)."""

    @F.arrow_udf("string")
    def fingerprint(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            raw, offsets = raw_text(part)
            yield pa.array([d.tobytes().hex() for i, j in slices(offsets) for d in digests(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])], pa.string())

    return docs.drop("fingerprint").withColumn("fingerprint", fingerprint("text"))


def _digests_of(texts: list[str]) -> np.ndarray:
    return digests(*raw_text(pa.array(texts, pa.large_string())))


def _compare(batches):
    held: list[tuple] = []  # (range, ahead, doc_id, text), in order; the last one waits for the next document

    def rows(part):
        own, after = part[:-1], part[1:]
        keep = [k for k, r in enumerate(own) if not r[1] and after[k][0] == r[0]]
        texts = [r[3] for r in part]
        cut = [len(t) // 3 for t in texts]
        edited = [texts[k][: len(texts[k]) - cut[k]] + texts[k + 1][: cut[k]] for k in keep]
        d, e = _digests_of(texts), _digests_of(edited)
        k = np.array(keep, int)
        columns = [
            pa.array([own[i][2] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([d[i].tobytes().hex() for i in keep], pa.string()), pa.array([x.tobytes().hex() for x in e], pa.string()),
            pa.array(likeness(d[k], e)), pa.array(likeness(d[k], d[k + 1])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[3])
            if size >= 1 << 19 and len(held) > 1:
                yield rows(held)
                held, size = held[-1:], len(row[3])
    if len(held) > 1:
        yield rows(held)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses (see the module's text)."""
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__at"))
    _, size = text_bytes(docs)
    ranges = max(min(pieces_for(docs.sparkSession, size, RANGE_BYTES), MANY), -(-size // WIDE_BYTES))
    shares = ", ".join(str((k + 1) / ranges) for k in range(ranges - 1))
    found = docs.agg(F.expr(f"approx_percentile(__at, array({shares}), {max(10_000, 10 * ranges)})").alias("b")).first()["b"] or [0]
    bounds = np.array(sorted(set(found)), np.int64)  # a number per range: 6 MB at 100 TB

    @F.arrow_udf("int")
    def range_of(at: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, np.asarray(at)), pa.int32())  # larger ids come first

    dealt = docs.withColumn("__range", range_of("__at"))
    firsts = docs.select("__at").withColumn("__range", range_of("__at")).groupBy("__range").agg(F.max("__at").alias("__at"))
    order = Window.orderBy("__range")  # a row per range
    firsts = firsts.select("__at", F.coalesce(F.lag("__range").over(order), F.max("__range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__before"))
    ahead = docs.join(F.broadcast(firsts), "__at").groupBy("__before", "__at").agg(F.max(F.struct("text", "doc_id")).alias("r"))
    own = dealt.select("__range", F.lit(False).alias("__ahead"), "doc_id", "text", "__at")
    every = own.unionByName(ahead.select(F.col("__before").alias("__range"), F.lit(True).alias("__ahead"), "r.doc_id", "r.text", "__at"))
    every = every.repartition(ranges, "__range").sortWithinPartitions("__range", "__ahead", F.desc("__at"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return every.select("__range", "__ahead", "doc_id", "text").mapInArrow(_compare, schema)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(read_table(spark, sf_dir, "documents"))
