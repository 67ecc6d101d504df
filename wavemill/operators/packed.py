"""Exact AUC of very many columns of scores at once, from sorted pieces.

A task sorts the scores of the rows it holds, column by column, and passes each on as one row: the distinct scores with
their positives and negatives, packed. A column of more than CELL scores is cut at edges, so that one group merges some
CELL scores of it; the cells' sums finish the AUC.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL, PIECE = 1 << 18, 1 << 15
SCHEMA = "g long, cell int, v binary, pos binary, neg binary"


def cells_for(n: float) -> int:
    return max(1, math.ceil(n / CELL))


def pieces(g: int, score: np.ndarray, y: np.ndarray, edges: np.ndarray) -> list[tuple]:
    """Rows of SCHEMA for one column g of scores; rows without a finite score or a label of 0 or 1 don't count."""
    ok = np.isfinite(score) & ((y == 0) | (y == 1))
    score, y = score[ok], y[ok]
    out = []
    for lo in range(0, len(score), PIECE):
        s = score[lo : lo + PIECE]
        order = np.argsort(s)
        s, pos = s[order], (y[lo : lo + PIECE] == 1)[order].astype(np.uint16)
        neg = 1 - pos
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        if len(at) < len(s):
            s, pos, neg = s[at], np.add.reduceat(pos, at, dtype=np.uint16), np.add.reduceat(neg, at, dtype=np.uint16)
        cuts = [0, *np.searchsorted(s, edges).tolist(), len(s)]
        out += [(g, cell, s[a:b].tobytes(), pos[a:b].tobytes(), neg[a:b].tobytes()) for cell, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    return out


def as_table(rows: list[tuple]) -> pa.Table:
    kinds = [("g", pa.int64()), ("cell", pa.int32()), ("v", pa.binary()), ("pos", pa.binary()), ("neg", pa.binary())]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def _merged(table: pa.Table) -> pa.Table:
    v, pos, neg = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("v", np.float64), ("pos", np.uint16), ("neg", np.uint16)))
    order = np.argsort(v, kind="stable")
    v, pos, neg = v[order], pos[order].astype(float), neg[order].astype(float)
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    pos, neg = np.add.reduceat(pos, at), np.add.reduceat(neg, at)
    won = float((pos * (np.cumsum(neg) - neg / 2)).sum())
    return pa.table({"g": table.column("g").slice(0, 1), "cell": table.column("cell").slice(0, 1), "p": [float(pos.sum())], "n": [float(neg.sum())], "won": [won]})


def packed_auc(packed: DataFrame) -> DataFrame:
    """g, roc_auc (null where one class is missing) of rows of SCHEMA."""
    cells = packed.groupBy("g", "cell").applyInArrow(_merged, "g long, cell int, p double, n double, won double")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = cells.withColumn("won", F.col("won") + F.col("p") * below)
    return won.groupBy("g").agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")).alias("roc_auc"))


def auc_of_runs(neg: list[np.ndarray], pos: list[np.ndarray]) -> float | None:
    """AUC of the scores of two classes, each in sorted runs (a pair of runs per random part of the rows); None where a class
    is missing. The runs are merged cell by cell, cut at the first part's scores; a cell has about as many scores as a part,
    and scores equal to a cut are only counted."""
    cuts = np.zeros(0)
    if len(neg) > 1:
        first = np.sort(np.concatenate([neg[0], pos[0]]))
        cuts = np.unique(first[:: max(1, len(first) // len(neg))])
    sides = []  # of each class: scores in each cell, and number of scores at each cut
    for runs in (neg, pos):
        ends = [(np.searchsorted(x, cuts), np.searchsorted(x, cuts, "right")) for x in runs]
        cells = lambda c, runs=runs, ends=ends: np.concatenate([x[hi[c - 1] if c else 0 : lo[c] if c < len(cuts) else len(x)] for x, (lo, hi) in zip(runs, ends, strict=True)])
        sides.append((cells, sum(hi - lo for lo, hi in ends)))
    (low, low_at), (high, high_at) = sides
    below, positives, won = 0, 0, 0  # won: pairs, twice
    for c in range(len(cuts) + 1):
        n, p = low(c), high(c)
        if len(neg) > 1:
            n.sort()
            p.sort()
        won += 2 * below * len(p) + int(np.searchsorted(n, p).sum()) + int(np.searchsorted(n, p, "right").sum())
        below, positives = below + len(n), positives + len(p)
        if c < len(cuts):
            won += int(high_at[c]) * (2 * below + int(low_at[c]))
            below, positives = below + int(low_at[c]), positives + int(high_at[c])
    return won / (2 * positives * below) if positives and below else None
