"""Substring dedup by difference-cover anchors.

A word is dropped if a window of `width` consecutive words around it also starts in a document with a smaller doc_id.

Method. The positions p of a document with p mod 7 in {0, 1, 3} form a difference cover: for any two positions i and j
there is a shift d < 7 for which i + d and j + d are both covered. Only the 7-word anchors at covered positions (3 of 7)
are hashed and compared across documents; two equal 13-word windows always share an anchor at the same shift. Windows
around a shared anchor are then extended to the full width and matched by the hash of all their words.

Shape of the job. Rows are dealt into chunks by a hash of doc_id and text (the number of chunks follows the input's size),
so a chunk holds the same rows in the same order whenever it is computed, and rows of one doc_id are spread too; a task
has many chunks. Every chunk sends its distinct anchor fingerprints, packed by bucket; a bucket answers each chunk with
one bit per fingerprint. An anchor or window that is in very many documents costs one fingerprint a chunk, so no bucket
is hot; no pair of documents is ever made. Anchor fingerprints may collide: this only adds candidates, which the full
windows settle. Within a chunk, windows are told apart word by word; between chunks, by the 128-bit BLAKE2b digest of their
words' 128-bit BLAKE2b digests. No result rests on the quick hashes, and nobody knows two words or windows that those
digests confuse (at 10^13 windows, chance would do it with probability 10^-13).

Defined results: a null text has no words; an empty or short text loses nothing; a very long text is handled whole, in a
chunk with few others; rows that share a doc_id are texts of one document (a window never counts against its own doc_id); a null doc_id counts as the largest. Other columns pass
through, except those named n_words, n_removed or kept_text, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_keys, pieces_for, raw_text, read_table, text_bytes
from .words import Windows, Words, run_names, window_starts

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
CHUNK_BYTES, BUCKET_BYTES = 3 << 19, 2 << 20
_BITS = "__chunk long, __bucket int, __stage int, __bits binary"


class _Chunk:
    """Anchors and windows of a chunk's texts in an order that depends on the texts alone."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.width, self.buckets = width, np.uint64(buckets)
        self.docs = doc_keys(self.table.column("doc_id"))
        raw, offsets = raw_text(self.table.column("text"))
        self.words = Words(raw, offsets)
        self.names, self.digests = self.words.named_digests()
        starts, count = window_starts(self.words.first, ANCHOR)
        begin = np.repeat(self.words.first[:-1], count)
        keep = np.isin((starts - begin) % PERIOD, COVER) & (np.repeat(self.words.count, count) >= width)
        self.anchor = starts[keep]
        h = Windows(self.digests[self.names, 0]).at(self.anchor, ANCHOR)
        key = ((h >> np.uint64(32)) % self.buckets << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        owner = self.docs[np.repeat(np.arange(len(count)), count)[keep]]
        self.keys, self.which, low, high = _grouped(key, owner)
        self.local = low != high

    def anchor_rows(self, chunk: int) -> pa.Table:
        return _packed(chunk, self.keys >> np.uint64(32), {"__payload": (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)})

    def extend(self, flags: dict[int, bytes]) -> None:
        """Hash the full windows that hold a shared anchor."""
        shared = (self.local | _flagged(self.keys >> np.uint64(32), flags))[self.which]
        n = len(self.words)
        hit = np.zeros(n + 1, np.int64)
        hit[self.anchor[shared] + 1] = 1
        hit = np.cumsum(hit)
        starts, count = window_starts(self.words.first, self.width)
        owner = self.docs[np.repeat(np.arange(len(count)), count)]
        keep = hit[starts + self.width - ANCHOR + 1] > hit[starts]
        self.window, self.owner = starts[keep], owner[keep]
        # windows of one name are the same words; a name's digest is that of any of its windows
        names = run_names(self.names, self.width)[self.window]
        _, some, self.group = np.unique(names, return_index=True, return_inverse=True)
        words, size = memoryview(self.digests[self.names].tobytes()), 16 * self.width
        each = [hashlib.blake2b(words[k : k + size], digest_size=16).digest() for k in (16 * self.window[some]).tolist()]
        one, two = np.frombuffer(b"".join(each), np.uint64).reshape(-1, 2).T
        bucket = (one >> np.uint64(20)) % self.buckets
        order = np.lexsort((two, one, bucket))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.group = place[self.group]
        self.hash, self.hash_2, self.bucket = one[order], two[order], bucket[order]
        self.least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.group, self.owner)

    def window_rows(self, chunk: int) -> pa.Table:
        return _packed(chunk, self.bucket, {"__payload": self.hash, "__second": self.hash_2, "__least": self.least})

    def removed(self, flags: dict[int, bytes]) -> np.ndarray:
        """A mark for each word to drop."""
        elsewhere = _flagged(self.bucket, flags)
        drop = elsewhere[self.group] | (self.owner > self.least[self.group])
        edge = np.zeros(len(self.words) + self.width + 1, np.int32)
        at = self.window[drop]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width, -1)
        return np.cumsum(edge)[: len(self.words)] > 0


def _grouped(key: np.ndarray, owner: np.ndarray):
    """Distinct keys in order, each row's group, and the smallest and largest owner of a group."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return key, z, z, z
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return k[at], which, np.minimum.reduceat(o, at), np.maximum.reduceat(o, at)


def _runs(bucket: np.ndarray):
    """(bucket, from, to) of a sorted bucket column."""
    if len(bucket):
        cut = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        yield from zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _packed(chunk: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    runs = list(_runs(bucket))
    out = {"__chunk": pa.array([chunk] * len(runs), pa.int64()), "__bucket": pa.array([int(b) for b, _, _ in runs], pa.int32())}
    for name, values in columns.items():
        out[name] = pa.array([values[i:j].tobytes() for _, i, j in runs], pa.binary())
    return pa.table(out)


def _flagged(bucket: np.ndarray, flags: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(bucket), bool)
    for b, i, j in _runs(bucket):
        if bits := flags.get(b):
            out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    return out


def _answer(table: pa.Table, stage: int, marks) -> pa.Table:
    """One bit string for each row of a bucket that has a mark."""
    chunks, buckets = table.column("__chunk").to_pylist(), table.column("__bucket").to_pylist()
    rows = [(c, b, np.packbits(m).tobytes()) for c, b, m in zip(chunks, buckets, marks, strict=True) if m.any()]
    return pa.table({"__chunk": pa.array([r[0] for r in rows], pa.int64()), "__bucket": pa.array([r[1] for r in rows], pa.int32()), "__stage": pa.array([stage] * len(rows), pa.int32()), "__bits": pa.array([r[2] for r in rows], pa.binary())})


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def _shared_anchors(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table.column("__payload").to_pylist()]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return _answer(table, 0, (_among(p, twice) for p in parts))


def _earlier_windows(table: pa.Table) -> pa.Table:
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    one, two, least = read("__payload", np.uint64), read("__second", np.uint64), read("__least", np.int64)
    a, b, owner = np.concatenate(one), np.concatenate(two), np.concatenate(least)
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    earlier = np.empty(len(a), bool)
    earlier[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1] < owner[order]
    ends = np.cumsum([len(x) for x in one])
    return _answer(table, 1, (earlier[e - len(x) : e] for x, e in zip(one, ends.tolist(), strict=True)))


def _flags(table: pa.Table, stage: int) -> dict[int, bytes]:
    rows = zip(table.column("__stage").to_pylist(), table.column("__bucket").to_pylist(), table.column("__bits").to_pylist(), strict=True)
    return {b: bits for s, b, bits in rows if s == stage}


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """The columns of docs with n_words, n_removed and kept_text (kept words joined by one space) added."""
    if width < ANCHOR + PERIOD - 1:
        raise ValueError(f"width must be at least {ANCHOR + PERIOD - 1}")
    spark = docs.sparkSession
    _, size = text_bytes(docs)
    chunks = pieces_for(spark, size, CHUNK_BYTES)
    buckets = pieces_for(spark, size // 4, BUCKET_BYTES, 16)
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    dealt = docs.select(*own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("__chunk"))
    dealt = dealt.repartition("__chunk")  # as many partitions as the session sets, whatever the number of chunks
    texts = dealt.select("__chunk", "doc_id", "text")

    def anchors(table):
        return _Chunk(table, width, buckets).anchor_rows(table.column("__chunk")[0].as_py())

    found = texts.groupBy("__chunk").applyInArrow(anchors, "__chunk long, __bucket int, __payload binary")
    first = found.groupBy("__bucket").applyInArrow(_shared_anchors, _BITS)

    def windows(table, flags):
        if not table.num_rows:
            return pa.table({"__chunk": pa.array([], pa.int64()), "__bucket": pa.array([], pa.int32()), "__payload": pa.array([], pa.binary()), "__second": pa.array([], pa.binary()), "__least": pa.array([], pa.binary())})
        chunk = _Chunk(table, width, buckets)
        chunk.extend(_flags(flags, 0))
        return chunk.window_rows(table.column("__chunk")[0].as_py())

    extended = texts.groupBy("__chunk").cogroup(first.groupBy("__chunk")).applyInArrow(windows, "__chunk long, __bucket int, __payload binary, __second binary, __least binary")
    second = extended.groupBy("__bucket").applyInArrow(_earlier_windows, _BITS)

    schema = T.StructType([f for f in dealt.schema.fields if f.name != "__chunk"])
    schema = T.StructType([*schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept_text string").fields])

    def cut(table, flags):
        chunk = _Chunk(table, width, buckets)
        chunk.extend(_flags(flags, 0))
        drop = chunk.removed(_flags(flags, 1))
        first, count = chunk.words.first, chunk.words.count
        gone = np.add.reduceat(np.r_[drop, False].astype(np.int64), first[:-1]) * (count > 0) if len(count) else count
        kept = []
        for k, text in enumerate(chunk.table.column("text").cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            if gone[k]:
                words = compress(words, (~drop[first[k] : first[k + 1]]).tolist())
            kept.append(b" ".join(words).decode())
        out = chunk.table.drop_columns(["__chunk"])
        return out.append_column("n_words", pa.array(count, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64())).append_column("kept_text", pa.array(kept, pa.string()))

    return dealt.groupBy("__chunk").cogroup(first.unionByName(second).groupBy("__chunk")).applyInArrow(lambda t, f: cut(t, f), schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
