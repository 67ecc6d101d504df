"""Best-fit packing by large-item matching.

Documents become pieces of at most `capacity` tokens. What is packed is the histogram of piece lengths (at most
`capacity` rows, whatever the input's size): lengths above a third of the capacity fit at most twice into a sequence and
are paired greedily, the longest with the longest that still fits; shorter ones, from the longest down, go into the
smallest gap that holds them, and open new sequences only when none does. The plan is a list of runs "the r-th to s-th
piece of length L go to sequences b, b + 1, ... at offset o". Each piece finds its run by its length and its rank among
the pieces of that length; ranks are a count within its task plus the counts of the tasks before, so no length, however
common, meets in one task. Full pieces need no partner and get a sequence of their own at once.

Defined results: a null text counts as empty and has the end id only; a very long text is encoded whole and cut into
pieces; rows that share a doc_id are packed one by one;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, raw_text, read_table, small_batches
from .tokens import ENCODE_BYTES, default_path, encoder, text_list

CAPACITY = 2048
_PIECE = "task long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) of each run, for lengths below the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = left * 0
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    third = capacity // 3
    for a in range(capacity - 1, third, -1):
        while left[a]:
            fits = np.flatnonzero(left[third + 1 : min(a, capacity - a) + 1])
            b = int(fits[-1]) + third + 1 if len(fits) else 0
            n = int(left[a]) // 2 if a == b else int(min(left[a], left[b])) if b else int(left[a])
            if a == b and n == 0:
                b, n = 0, 1
                others = fits[fits < a - third - 1]
                if len(others):
                    b = int(others[-1]) + third + 1
            place(a, n, sequences, 0)
            if b:
                place(b, n, sequences, a)
            leave(capacity - a - b, sequences, n)
            sequences += n
    for s in range(third, 0, -1):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=0)
            if not gap:
                n = -(-int(left[s]) // (capacity // s))
                leave(capacity, sequences, n)
                sequences += n
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            k = min(n, int(left[s]))
            place(s, k, first, capacity - gap)
            leave(gap - s, first, k)
            leave(gap, first + k, n - k)
    return runs


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], np.uint32)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches, limit=ENCODE_BYTES):
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), enc.encode(text_list(*raw_text(batch.column(1)))), strict=True):
                ids = np.concatenate([x, end], dtype="<u4")
                for k in range(0, len(ids), capacity):
                    own = ids[k : k + capacity]
                    rows.append((task, int(seen[len(own)]), doc, k // capacity, k, len(own), zlib.crc32(own.tobytes())))
                    seen[len(own)] += 1
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("task", "nth", "doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return run


def _assign(runs, capacity: int):
    runs = sorted(runs)
    key = np.array([r[0] << 44 | r[1] for r in runs], np.int64)
    first, sequence, offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4))

    def run(batches):
        for batch in batches:
            task, nth, length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("task", "nth", "length", "rank"))
            full = length == capacity
            at = np.maximum(np.searchsorted(key, length << 44 | rank, side="right") - 1, 0)
            where = -(task << 40 | nth) - 1
            place = np.zeros(len(length), np.int64)
            if len(runs):
                where = np.where(full, where, sequence[at] + rank - first[at])
                place = np.where(full, 0, offset[at])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(where), pa.array(place)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path or default_path(), end_id, capacity), _PIECE)
    pieces = materialise(pieces, "pieces")
    tasks = pieces.where(F.col("length") < capacity).groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = materialise(tasks.select("length", "task", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below capacity rows
    ranked = pieces.join(before.drop("n"), ["length", "task"], "left").withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))
    return ranked.mapInArrow(_assign(plan(counts, capacity), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
