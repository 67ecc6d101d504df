"""Periodic runs of words, found by a sparse diagonal DP.

A run is a stretch of consecutive words whose words `period` apart are identical, with no smaller period, that no
neighbouring word extends, of at least `min_length` words and `min_exponent` periods.

Method. Each word looks at its earlier occurrences; one that lies `lag` words back continues the diagonal of that lag, or
begins it anew, and a diagonal that ends with enough words behind it emits its run at once. A frequent word has too many
earlier occurrences for that, so lags are taken one scale at a time: for lags in (k/2, k], k a power of two, an occurrence
is that of the word with the k - 1 words after it, and only the last one counts. That loses nothing: where a run of period
q <= k holds both a window of k words and the window q words back, no nearer window is the same, or the run would have a
smaller period (Fine and Wilf). So a scale has at most one diagonal cell per word, a run is one unbroken diagonal, and the
work is n log n, whatever the text repeats. Windows are named by pairs of the halves' names, never by hashes, and those
that occur once leave the next scale.

Shape of the job. A document needs no other: one pass without a shuffle, slices of about a megabyte at a time.

Defined results: a null or blank text has no words, no runs, and an empty kept_text; very long texts are handled whole;
rows that share a doc_id or are repeated are handled one by one; other columns pass through, except those named n_words,
runs, strongest or kept_text, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_text, read_table, small_batches
from .mixing import WORD
from .words import Words

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, kept_text string"


def word_runs(names: np.ndarray, first: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (over all texts), length and period of every run, by first word and period.

    names: a number per word; first: the n + 1 offsets of the texts' words.
    """
    n, longest = len(names), int(np.diff(first).max(initial=0))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end, size = first[1:][owner], np.diff(first)[owner]
    at, name, k, found = np.arange(n), owner * (int(names.max(initial=0)) + 1) + names, 1, []
    while len(at):
        order = np.argsort(name, kind="stable")  # by name, then place
        same = name[order[1:]] == name[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
        cell = np.flatnonzero((2 * lag > k) & (lag <= k))
        if len(cell):
            place, lags = at[cell], lag[cell]
            ends = np.r_[np.flatnonzero((np.diff(place) != 1) | (np.diff(lags) != 0)), len(cell) - 1]
            begins = np.r_[0, ends[:-1] + 1]
            q = lags[begins]
            start, length = place[begins] - q, place[ends] + k - place[begins] + q
            ok = length >= np.maximum(min_length, min_exponent * q)
            found.append(np.stack([start[ok], length[ok], q[ok]]))
        if 2 * k >= longest:
            break
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        number = np.full(n, -1, np.int64)
        number[at[order]] = np.cumsum(np.r_[True, ~same]) - 1
        number[at[~again]] = -1
        at = at[again]
        at = at[(at + 2 * k <= end[at]) & (size[at] >= min_exponent * (k + 1))]
        other = number[at + k]
        at, other = at[other >= 0], other[other >= 0]
        name = number[at] * n + other
        k *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _strongest(length: list[int], period: list[int]) -> int:
    """The first run of the greatest exact exponent; runs are in order of start and period."""
    rough = [a / b for a, b in zip(length, period, strict=True)]
    most = max(rough) * (1 - 1e-12)
    return max((i for i, x in enumerate(rough) if x >= most), key=lambda i: (Fraction(length[i], period[i]), -i))


def _annotate(columns: list[str], min_length: int, min_exponent: int):
    def run(batches):
        for batch in small_batches(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            words = Words(*raw_text(column))
            start, length, period = word_runs(words.names(), words.first, min_length, min_exponent)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            drop = np.cumsum(edge[:-1]) > 0
            cuts = np.searchsorted(start, words.first)
            own = start - np.repeat(words.first[:-1], np.diff(cuts))
            runs = pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], fields=list(_RUN))
            best, kept, lengths, periods = [], [], length.tolist(), period.tolist()
            for k, text in enumerate(column.cast(pa.binary()).to_pylist()):
                i, j = int(cuts[k]), int(cuts[k + 1])
                left = (text or b"").split()
                if i < j:
                    left = compress(left, (~drop[words.first[k] : words.first[k + 1]]).tolist())
                    best.append(i + _strongest(lengths[i:j], periods[i:j]))
                else:
                    best.append(None)
                kept.append(b" ".join(left).decode())
            added = [pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), runs.take(pa.array(best, pa.int64())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *added], names=[*columns, "n_words", "runs", "strongest", "kept_text"])

    return run


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """The columns of docs with n_words, runs(start, length, period) by start and period, the strongest of them (null:
    none) and kept_text: the words that no run holds after its first period, joined by one space."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    own = [c for c in docs.columns if c not in ("n_words", "runs", "strongest", "kept_text")]
    docs = docs.select(*own)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_ADDED).fields])
    return docs.mapInArrow(_annotate(own, min_length, min_exponent), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a periodic tail in the texts of every tenth crc32 of the doc_id (a null doc_id: none)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    exponent = F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
