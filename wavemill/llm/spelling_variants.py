"""Spelling variants: words one code point apart, each led to its most frequent form.

Method (dense prefix-suffix tiling). Two words, the longer one of length L, are a single edit apart if their common prefix
and common suffix together have L - 1 code points or more. Words are dealt into cells: a cell has a length L, a range of
places at which the edit may be, and the text before and after that range, which words of length L or L - 1 must share. A
cell begins with one half of the places and is split in halves again while it has more than TILE words; with one place
left it can't have more words than the alphabet has letters. So the vocabulary, not one cell, bounds the work, and no cell
is cut short. A cell's words are rows of a padded matrix of code points; blocks of BLOCK rows are compared with each other
at once, prefix first, then suffix for the pairs whose prefix ends in the cell's range: each pair is met in one cell only.
A cell returns counts and the best neighbour of each word, not pairs.

A word's form is its neighbour of largest count (ties: the smallest by code points), if that count is `ratio` times the
word's own or more. Forms lead to a root in at most log(count) / log(ratio) steps, which pointer doubling follows.

Shape of the job. Words are counted within each document and task before the shuffle. All else runs on the vocabulary,
hashed by cells of bounded size, or joined by word.

Defined results: a null text has no words; very long texts are counted whole and very long words compared whole; rows that
are repeated or share a doc_id count each; with `typo`, a null doc_id reads as an empty string; extra columns are ignored,
whatever their names. An empty table gives an empty result. Letters are A-Z, a-z and U+00C0 to U+00FF (one byte each).
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, raw_text, read_table, small_batches
from .tokens import text_list

TILE, BLOCK = 1024, 16
#: Distinct words that a task counts before it passes them on; bytes compared at once.
HELD_WORDS, COMPARED = 200_000, 1 << 25
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _count(least_length: int, typo: int):
    def run(batches):
        total: Counter[bytes] = Counter()

        def flush():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), text_list(*raw_text(batch.column(1))), strict=True):
                runs = Counter(text.decode().encode("latin-1", "replace").translate(_LETTERS).split())
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for word, n in runs.items():
                    if len(word) < least_length:
                        continue
                    if typo:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if h % typo == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield flush()
        if total:
            yield flush()

    return run


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, typo: int = 0) -> DataFrame:
    """word, n: runs of letters of docs(doc_id, text) with A-Z lower-cased, of that length and count at least. With `typo`,
    a run loses one letter where that number divides the crc32 of `<doc_id>:<run>`."""
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(least_length, typo), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cells(words: DataFrame) -> DataFrame:
    """words(word, n, size, low, high) with the cell of each; size is the longer word's length."""
    after = F.expr("if(size > high, substring(word, length(word) - (size - high) + 1), '')")
    return words.withColumn("cell", F.xxhash64("size", "low", "high", F.expr("substring(word, 1, low)"), after))


def _halves(words: DataFrame) -> DataFrame:
    middle = F.expr("(low + high) div 2").cast("int")
    ranges = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return _cells(words.select("word", "n", "size", F.explode(ranges).alias("r")).select("word", "n", "size", "r.low", "r.high").where("low < high"))


def _matrix(words: list[bytes], width: int, right: bool) -> np.ndarray:
    padded = b"".join([w.rjust(width, b"\0") if right else w.ljust(width, b"\0") for w in words])
    return np.frombuffer(padded, np.uint8).reshape(len(words), width)


def neighbours(words: list[bytes], cell: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows of one cell, in order of cells, that are a single edit apart at a place in the cell's range and the
    longer of which has `width` code points."""
    left, right = _matrix(words, width, False), _matrix(words, width, True)[:, ::-1]
    size = np.array([len(w) for w in words])
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    count = np.diff(np.r_[begins, len(words)])
    blocks = -(-count // BLOCK)
    block_of = np.repeat(np.arange(len(begins)), blocks)  # the cell of each block
    nth = np.arange(len(block_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = begins[block_of] + nth * BLOCK
    stop = np.minimum(start + BLOCK, (begins + count)[block_of])
    partners = blocks[block_of] - nth  # a block meets itself and the later ones of its cell
    one = np.repeat(np.arange(len(block_of)), partners)
    other = one + np.arange(len(one)) - np.repeat(np.cumsum(partners) - partners, partners)
    found, step = [np.zeros((2, 0), np.int64)], max(COMPARED // (BLOCK * BLOCK * width), 1)
    for k in range(0, len(one), step):
        a, b = one[k : k + step], other[k : k + step]
        i, j = start[a][:, None] + np.arange(BLOCK), start[b][:, None] + np.arange(BLOCK)
        there = (i < stop[a][:, None])[:, :, None] & (j < stop[b][:, None])[:, None, :] & (i[:, :, None] < j[:, None, :])
        i, j = np.minimum(i, len(words) - 1), np.minimum(j, len(words) - 1)
        same = left[i][:, :, None, :] == left[j][:, None, :, :]
        prefix = np.where(same.all(-1), width, same.argmin(-1))
        at, x, y = np.nonzero(there & (prefix >= low[i][:, :, None]) & (prefix < high[i][:, :, None]))
        i, j, prefix = i[at, x], j[at, y], prefix[at, x, y]
        same = right[i] == right[j]
        suffix = np.where(same.all(-1), width, same.argmin(-1))
        ok = (prefix + suffix >= width - 1) & (np.maximum(size[i], size[j]) == width) & (low[i] == low[j]) & (high[i] == high[j])
        found.append(np.stack([i[ok], j[ok]]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def _near_rows(table: pa.Table):
    """word, n_near, best_n and best of the words of whole cells, in order of size and cell."""
    widths = np.asarray(table.column("size"))
    cuts = np.r_[0, np.flatnonzero(np.diff(widths)) + 1, len(widths)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = table.slice(a, b - a)
        words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
        n, cell, low, high = (np.asarray(part.column(c)) for c in ("n", "cell", "low", "high"))
        i, j = neighbours(words, cell, low, high, int(widths[a]))
        if not len(i):
            continue
        word, near = np.r_[i, j], np.r_[j, i]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[near], -n[near], word))
        word, near = word[order], near[order]
        at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        column = part.column("word").combine_chunks()
        yield pa.RecordBatch.from_arrays([column.take(pa.array(word[at])), pa.array(np.diff(np.r_[at, len(word)]), pa.int64()), pa.array(n[near[at]], pa.int64()), column.take(pa.array(near[at]))], names=["word", "n_near", "best_n", "best"])


def _compare(batches):
    held = None  # rows of a cell that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        cell = np.asarray(table.column("cell"))
        cuts = np.flatnonzero(cell[1:] != cell[:-1])
        whole = int(cuts[-1]) + 1 if len(cuts) else 0
        yield from _near_rows(table.slice(0, whole))
        held = table.slice(whole).combine_chunks()
    if held is not None:
        yield from _near_rows(held)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root over forms(word, form): pointer doubling until nothing moves; written after each step."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(links)
        links = moved.select("word", "root")
        links._scratch_path = moved._scratch_path
        if not moved.where("moved").limit(1).count():
            return links


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n for words(word, n), whose words are distinct."""
    words = materialise(words.select("word", "n"), "words")
    lengths = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    placed = materialise(_halves(lengths.select("word", "n", "size", F.lit(0).alias("low"), F.col("size").alias("high"))), "cells")
    leaves, written = None, [placed]
    while True:
        wide = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"), F.max(F.col("high") - F.col("low")).alias("places")).where(f"in_cell > {TILE} and places > 1")
        wide = materialise(wide.select("cell"), "wide")
        written.append(wide)
        some = wide.limit(1).count()
        small = placed.join(wide, "cell", "left_anti").select(*placed.columns) if some else placed
        leaves = small if leaves is None else leaves.unionByName(small)
        if not some:
            break
        placed = materialise(_halves(placed.join(wide, "cell", "left_semi").select("word", "n", "size", "low", "high")), "cells")
        written.append(placed)
    leaves = leaves.repartition("cell").sortWithinPartitions("size", "cell", "low", "word")
    near = leaves.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    near = materialise(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "near")
    for table in written:
        discard(table)
    more = -F.col("best.less")
    joined = words.join(near, "word", "left").withColumn("leads", more >= ratio * F.col("n"))
    joined = joined.select("word", F.when(F.col("leads"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("leads"), more).alias("form_n"))
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(count_words(read_table(spark, sf_dir, "documents"), typo=199))
