"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text's code points are lower-cased and everything but letters becomes a blank; runs of blanks count once. All its 1-,
2- and 3-grams are hashed into 2^16 buckets. Bucket counts per language are summed over all learning rows on the
executors (packed blocks of counts, added up as they stream in). The matrix of log probabilities has a fixed number of
rows and goes with the tasks, PER_PASS columns at a time: that many languages take one pass over the texts, and each
further PER_PASS one more, so a table with a dirty language column takes longer but needs no more memory. A batch is
scored sparsely: each n-gram picks its row of the matrix, and rows are summed per text.

Defined results: a very long text is scored whole; a text that is null or has no letter is `und` with score 0, as is every text where nothing could be
learnt; an empty table gives an empty result; equal texts get equal predictions; ties go to the first language by code
point. Rows without a language are scored but not learnt from. Columns named lang_pred or score are replaced, others
pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, raw_text, read_table, slices

BUCKETS, BLOCK, PER_PASS = 1 << 16, 1 << 10, 256
#: Languages whose counts a task holds at once.
HELD = 32
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


@functools.cache
def _fold_table() -> np.ndarray:
    """Lower-case letter of each code point; 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(raw: np.ndarray, offsets: np.ndarray):
    """(buckets, offsets) for each order of n-grams, and which texts have a letter."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
    c = _fold_table()[points]
    before = np.r_[np.uint32(1), c[:-1]] if len(c) else c
    before[ends[:-1][ends[:-1] < len(c)]] = 0  # a text's first blank says nothing
    keep = (c > 0) | (before > 0)
    ends = np.r_[0, np.cumsum(keep)][ends]
    c = c[keep]
    letters = np.diff(np.r_[0, np.cumsum(c > 0)][ends]) > 0
    out = []
    h = c * _A
    out.append((h >> np.uint32(16), ends))
    for step, by in ((1, _B), (2, _C)):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * by + c[step:] * _A if len(h) else h
        # n-grams that run on into the next text are left out
        size = np.maximum(np.diff(ends) - step, 0)
        at = np.ones(len(c), bool)
        for back in range(1, step + 1):
            last = ends[1:] - back
            at[last[last >= ends[:-1]]] = False
        out.append(((h >> np.uint32(16))[at[: len(h)]], np.r_[0, np.cumsum(size)]))
    return out, letters


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            raw, offsets = raw_text(batch.column(1).filter(pa.array(langs == lang)))
            into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for i, j in slices(offsets):
                for h, _ in _grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]:
                    into += np.bincount(h, minlength=BUCKETS)
            if len(counts) > HELD:
                yield from _blocks({(lang, k): c[k * BLOCK : (k + 1) * BLOCK] for lang, c in counts.items() for k in range(BUCKETS // BLOCK)})
                counts.clear()
    yield from _blocks({(lang, k): c[k * BLOCK : (k + 1) * BLOCK] for lang, c in counts.items() for k in range(BUCKETS // BLOCK)})


def _blocks(sums: dict):
    """Sums as rows: which buckets of a block have counts, and those counts."""
    for k in range(0, len(sums), 1 << 12):
        part = [(lang, block, np.flatnonzero(c), c) for (lang, block), c in list(sums.items())[k : k + (1 << 12)]]
        part = [(lang, block, at.astype(np.uint16).tobytes(), c[at].astype(np.int64).tobytes()) for lang, block, at, c in part if len(at)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True) if part else [[]] * 4, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "block", "at", "counts"])


def _add(batches):
    """Sums of the rows of one language and block, which follow each other."""
    key, total = None, None
    for batch in batches:
        for lang, block, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, block) != key:
                if key:
                    yield from _blocks({key: total})
                key, total = (lang, block), np.zeros(BLOCK, np.int64)
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
    if key:
        yield from _blocks({key: total})


_COUNTS = "lang string, block int, at binary, counts binary"


class Model:
    """Languages (by code point), and their counts as a table; the matrix is read PER_PASS languages at a time."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").toLocalIterator()]  # names only
        self.langs.sort()
        self._first = None

    def passes(self) -> int:
        return max(1, -(-len(self.langs) // PER_PASS))

    def matrix(self, k: int = 0) -> dict:
        """The languages of pass k and the (buckets, languages) matrix of log probabilities."""
        if k == 0 and self._first is not None:
            return self._first
        langs = self.langs[k * PER_PASS : (k + 1) * PER_PASS]
        rows = self.counts if len(self.langs) <= PER_PASS else self.counts.where(F.col("lang").between(langs[0], langs[-1]))
        counts, where = np.zeros((BUCKETS, len(langs))), {lang: i for i, lang in enumerate(langs)}
        for r in rows.toLocalIterator():
            counts[r["block"] * BLOCK + np.frombuffer(r["at"], np.uint16).astype(int), where[r["lang"]]] = np.frombuffer(r["counts"], np.int64)
        counts = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * BUCKETS)
        out = {"langs": langs, "log_p": counts.astype(np.float32)}
        self._first = out if k == 0 else self._first
        return out


def fit(docs: DataFrame) -> Model:
    """The model of text and lang of docs."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    parts = rows.mapInArrow(_count, _COUNTS).repartition("lang", "block").sortWithinPartitions("lang", "block")
    return Model(materialise(parts.mapInArrow(_add, _COUNTS), "languages"))


def _predict(raw, offsets, model):
    """Best language of each text with its log probability, the summed probability of all relative to it, and whether the text has a letter."""
    n, k = len(offsets) - 1, len(model["langs"])
    grams, letters = _grams(raw, offsets)
    total = np.zeros((n, k))
    for h, off in grams:
        at = np.flatnonzero(np.diff(off))
        if len(at):
            for lang in range(k):
                total[at, lang] += np.add.reduceat(model["columns"][lang][h], off[at])
    best = total.argmax(1)
    top = total[np.arange(n), best]
    return np.array(model["langs"], object)[best], top, np.exp(total - top[:, None]).sum(1), letters


_FOUND = "struct<lang_pred: string, top: double, rest: double>"


def _scored(model: dict):
    @F.arrow_udf(_FOUND)
    def language(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model | {"columns": [np.ascontiguousarray(c).astype(np.float64) for c in model["log_p"].T]}
        for part in parts:
            raw, offsets = raw_text(part)
            found = [_predict(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], own) for i, j in slices(offsets)]
            names, top, rest, letters = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            columns = [pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(rest, pa.float64())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "top", "rest"], mask=pa.array(~np.asarray(letters, bool)))

    return language


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language (equal priors)."""
    out = docs.drop("lang_pred", "score")
    if not model.langs:
        return out.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found, scratch = out.withColumn("__found", _scored(model.matrix())("text")), None
    for k in range(1, model.passes()):
        # the better of two passes (the earlier one on a tie), and the sum of both relative to it
        both = found.withColumn("__next", _scored(model.matrix(k))("text"))
        a, b = F.col("__found"), F.col("__next")
        won, lost = F.when(b["top"] > a["top"], b).otherwise(a), F.when(b["top"] > a["top"], a).otherwise(b)
        merged = F.struct(won["lang_pred"].alias("lang_pred"), won["top"].alias("top"), (won["rest"] + lost["rest"] * F.exp(lost["top"] - won["top"])).alias("rest"))
        found = materialise(both.withColumn("__found", F.when(a.isNotNull(), merged)).drop("__next"), "languages")
        if scratch is not None:
            discard(scratch)
        scratch = found
    score = F.coalesce(1 / F.col("__found.rest"), F.lit(0.0))
    return found.select("*", F.coalesce("__found.lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score")).drop("__found")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
