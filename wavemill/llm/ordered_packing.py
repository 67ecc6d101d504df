"""Order-preserving packing by dynamic programming.

The documents of an input partition, in its order, are one stream of tokens; sequences are consecutive windows of it. A
window has at most `capacity` tokens and is padded to that, unless its length is a power of two. Windows are cut at ends
of documents for nothing, at ends of sentences for SENTENCE, and within a sentence for WORD, where sentences are too long
to be left whole and in the last windows of a partition. The DP chooses the cuts of least padding plus penalties:

    best(j) = penalty(j) + min over cuts i with place(j) - place(i) <= capacity of best(i) + padding(place(j) - place(i))

Padding is capacity less the length, so the least best(i) + place(i) of a sliding range is wanted, which a monotone queue
keeps; lengths that are powers of two add at most log2(capacity) + 1 further places, looked up beforehand.

Shape of the job. Tokenising, cutting and checksums are one pass over a partition: no shuffle, nothing at the driver, and
sequences are numbered by partition. The DP runs over some STREAM tokens at a time; the windows of its last LATE tokens
are left open and decided with what follows. A partition ends in one window that may need padding, or is cut in powers of
two.

Defined results: a null text counts as empty and has the end id only; a very long text is encoded whole and cut like any
other; rows that share a doc_id are packed one by one; a null doc_id is kept; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, read_table, small_batches
from .tokens import BYTE_BPE, ENCODE_BYTES, _byte_letters, default_path, encoder, text_list

CAPACITY = 2048
#: Tokens of padding that a cut at a sentence's end, or within a sentence, may save at least; what a window costs.
SENTENCE, WORD, WINDOW = 5, 15, 1
#: Tokens cut at once, and of them those whose windows are left open; places for cuts within long sentences.
STREAM, LATE, STEP = 1 << 19, 1 << 15, 64
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indexes of the chosen cuts, the first and last place among them. Neighbouring places are at most `capacity` apart."""
    n, later, earlier = len(places), [], []
    for power in (1 << k for k in range(capacity.bit_length())):
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero(places[at] == places - power)
        later.append(hit)
        earlier.append(at[hit])
    j, i = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(j, kind="stable")
    jumps, upto = i[order].tolist(), np.searchsorted(j[order], np.arange(n + 1)).tolist()
    place, penalty = places.tolist(), (penalties + WINDOW).tolist()
    best, came, height = [0] * n, [0] * n, [0] * n
    height[0] = place[0]
    queue = deque([0])
    for j in range(1, n):
        here = place[j]
        while place[queue[0]] < here - capacity:
            queue.popleft()
        source = queue[0]
        least = height[source] + capacity - here
        for i in jumps[upto[j] : upto[j + 1]]:
            if best[i] < least:
                least, source = best[i], i
        best[j], came[j] = least + penalty[j], source
        height[j] = best[j] + here
        while queue and height[queue[-1]] >= height[j]:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return path[::-1]


def sentence_ends(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id: does its text end a sentence if white space follows; does it begin with white space; is it a line's end."""
    enc = encoder(path)
    byte_of = {c: b for b, c in _byte_letters().items()}
    texts = [bytes(byte_of.get(c, 32) for c in enc.whole.id_to_token(k) or "").decode("utf-8", "replace") for k in range(enc.size)]
    closing = regex.compile(r"[.!?…。！？][\"'”’)\]]*$")
    return np.array([bool(closing.search(t)) for t in texts]), np.array([t[:1].isspace() for t in texts]), np.array([t.endswith("\n") for t in texts])


def _places(ids: np.ndarray, ends: np.ndarray, marks, last: bool, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut and what a cut there costs; `ends` are the ends of its documents."""
    closes, opens, line = marks
    total = len(ids)
    price = np.full(total + 1, -1, np.int32)
    price[1:-1][(closes[ids[:-1]] & opens[ids[1:]]) | line[ids[:-1]]] = SENTENCE
    price[0] = 0
    price[ends] = 0
    at = np.flatnonzero(price >= 0)
    long = np.flatnonzero(np.diff(at) > 4 * STEP)
    for k in long.tolist():
        price[at[k] + STEP : at[k + 1] : STEP] = WORD
    if last:
        rest = price[max(total - capacity, 0) :]
        rest[rest < 0] = WORD
    at = np.flatnonzero(price >= 0)
    return at, price[at]


class _Stream:
    """Documents of a partition that are not in a finished window yet."""

    def __init__(self, marks, capacity: int, kind, task: int):
        self.marks, self.capacity, self.kind, self.next = marks, capacity, kind, task << 40
        self.docs, self.size, self.parts, self.begun, self.held = [], [], [], 0, 0  # begun: tokens of the first document that are out

    def add(self, doc, ids: bytes, n: int) -> None:
        self.docs.append(doc)
        self.size.append(n)
        self.parts.append(ids)
        self.held += n

    def pack(self, last: bool) -> pa.RecordBatch:
        """Rows of the finished windows; the rest stays."""
        ids = np.frombuffer(b"".join(self.parts), self.kind)
        size = np.array(self.size, np.int64)
        start = np.cumsum(size) - size - self.begun  # where a document begins in ids
        at, price = _places(ids, start + size, self.marks, last, self.capacity)
        cuts = at[best_cuts(at, price, self.capacity)]
        if not last:
            keep = max(int(np.searchsorted(cuts, len(ids) - LATE, side="right")), 2)
            cuts = cuts[:keep]
        stop = int(cuts[-1])
        ends = start + size
        edges = np.union1d(cuts, ends[ends < stop])
        begin, length = edges[:-1], np.diff(edges)
        doc, window = np.searchsorted(start, begin, side="right") - 1, np.searchsorted(cuts, begin, side="right") - 1
        raw = memoryview(ids[:stop].astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
        names = pa.array(self.docs, pa.int64()).take(pa.array(doc))
        columns = [names, begin - start[doc], length, crc, size[doc], self.next + window, begin - cuts[window]]
        self.next += len(cuts) - 1
        first = int(np.searchsorted(ends, stop, side="right"))  # the first document that is not all out
        self.docs, self.size = self.docs[first:], self.size[first:]
        self.begun = int(stop - start[first]) if first < len(start) else 0
        self.parts, self.held = [ids[stop:].tobytes()], len(ids) - stop
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _windows(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, marks = encoder(path), sentence_ends(path)
        end = np.array([end_id], enc.kind).tobytes()
        stream = _Stream(marks, capacity, enc.kind, TaskContext.get().partitionId())
        for batch in small_batches(batches, limit=ENCODE_BYTES):
            for doc, x in zip(batch.column(0).to_pylist(), enc.encode(text_list(*raw_text(batch.column(1)))), strict=True):
                stream.add(doc, x.tobytes() + end, len(x) + 1)
                if stream.held >= STREAM:
                    yield stream.pack(False)
        if stream.held:
            yield stream.pack(True)

    return run


def pack_in_order(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; the order within a partition
    of docs is kept. capacity must be a power of two."""
    if capacity & (capacity - 1) or capacity < 4 * STEP:
        raise ValueError(f"capacity must be a power of two, {4 * STEP} at least")
    return docs.select("doc_id", "text").mapInArrow(_windows(path or default_path(BYTE_BPE), end_id, capacity), _PIECE)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens, padding, and cuts within documents, over all pieces: one row."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") + F.col("length") < F.col("doc_tokens")).alias("cut"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return whole.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padding"), F.sum("cut").alias("cuts"))


def op13_ordered_packing(spark, sf_dir: str) -> DataFrame:
    return pack_in_order(read_table(spark, sf_dir, "documents"))
