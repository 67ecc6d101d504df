"""Replicates without rows: resampled and shuffled metrics of all replicates in one pass over the scores.

Each row has two 31-bit hashes of its id and each replicate three coefficients; a polynomial modulo 2^31 - 1 makes of them
the row's draw in that replicate (draws of any three rows are independent). Rows are dealt by ranges of their scores and
sorted; a task holds a matrix of draws, rows of a slice by replicates, and sums what each replicate needs: positives and
negatives, pairs won, and the confusion counts. A task passes on its range as three segments (its first score, its last
one, and what is between), each with a number per replicate; a score that is cut over tasks is put together again, and
running sums over the segments finish the AUC. Nothing grows with rows times replicates but the arithmetic.

Schemes: `bootstrap` counts a row as often as a Poisson(1) draw says; `swap` exchanges a row's two scores by a coin (rows
come once per side, replicate 0 is left as it is); `labels` gives the rows with the least draws the positive labels, as
many as there are, by the exact threshold of each replicate.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite
from ..sources.scratch import settle
from .metrics import rates

PRIME, BINS, SPAN = (1 << 31) - 1, 64, 8.0
#: Rows whose draws are made at once: with a thousand replicates they stay in a core's cache.
SLICE = 64
#: Metrics that a replicate can be asked for by name.
METRICS = ("roc_auc", "accuracy", "precision", "sensitivity", "specificity", "fpr", "f1", "f_beta", "tp", "tn", "fp", "fn")


def poisson_cuts() -> list[int]:
    """Draws from which on a Poisson(1) count is at least 1, 2, ..., 12."""
    p, total, cuts = math.exp(-1), 0.0, []
    for k in range(12):
        total += p
        cuts.append(math.ceil(total * PRIME))
        p /= k + 1
    return cuts


def _part(text: str, k: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * k : 8 * k + 8], 16) % PRIME


def coefficients(seed: str, n: int) -> np.ndarray:
    """Three numbers for each replicate."""
    return np.array([[_part(f"{seed}|{r}", k) for k in range(3)] for r in range(n)], np.int64).reshape(-1, 3).T


def draws(h: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Rows by replicates, each from 0 to PRIME - 1. PRIME is 2^31 - 1: the upper bits of a number add to its lower ones."""
    u = (h * h % PRIME)[:, None] * coef[0]
    upper = h[:, None] * coef[1]
    u += upper
    u += coef[2]
    for _ in range(2):
        np.right_shift(u, 31, out=upper)
        u &= PRIME
        u += upper
    if len(u) and u.max() == PRIME:
        u[u == PRIME] = 0
    return u


def hashed(row_id: str | Column, seed: str, k: int) -> Column:
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    text = F.md5(F.concat_ws("|", F.lit(seed), row.cast("string")))
    return F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("bigint") % PRIME


class _Range:
    """What one group's part of a task's range of scores comes to, per replicate."""

    def __init__(self, n: int):
        self.first = self.last = None  # (score, positives, negatives)
        self.low, self.pos, self.neg, self.won, self.tp, self.fp = None, *(np.zeros(n) for _ in range(5))

    def add(self, score: np.ndarray, pos, neg, won, pred: np.ndarray) -> None:
        """Rows in order of their scores. pos and neg sum the positives and negatives of some of them per replicate; won is
        what the positives of a stretch of rows win against the negatives of the same stretch."""
        if pred.any():
            self.tp += pos(pred)
            self.fp += neg(pred)
        f, e = 0, int(np.searchsorted(score, score[-1], side="left"))
        if self.last is not None:
            f = int(np.searchsorted(score, self.last[0], side="right"))
            if f:
                self.last = self.last[0], self.last[1] + pos(slice(0, f)), self.last[2] + neg(slice(0, f))
            if f == len(score):
                return
            self._close()
        if self.first is None and f < e:
            f2 = int(np.searchsorted(score, score[f], side="right"))
            self.first = score[f], pos(slice(f, f2)), neg(slice(f, f2))
            f = f2
        if f < e:
            self.low = score[f] if self.low is None else self.low
            all_pos, all_neg = pos(slice(f, e)), neg(slice(f, e))
            self.won += all_pos * self.neg + won(f, e)
            self.pos += all_pos
            self.neg += all_neg
        self.last = score[-1], pos(slice(e, None)), neg(slice(e, None))

    def _close(self) -> None:
        """The last score is followed by a larger one."""
        if self.first is None:
            self.first = self.last
            return
        score, pos, neg = self.last
        self.low = score if self.low is None else self.low
        self.won += pos * (self.neg + neg / 2)
        self.pos += pos
        self.neg += neg

    def rows(self, group: str):
        n = len(self.pos)
        zero = np.zeros(n)
        for low, tie, pos, neg, won, tp, fp in ((self.low, False, self.pos, self.neg, self.won, zero, zero), (self.first and self.first[0], True, *(self.first or (0, zero, zero))[1:], zero, zero, zero), (self.last[0], True, *self.last[1:], zero, self.tp, self.fp)):
            if low is not None:
                columns = [pa.array([group] * n, pa.string()), pa.array(np.full(n, low)), pa.array([tie] * n), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, (pos, neg, won, tp, fp))]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "low", "tie", "replicate", "pos", "neg", "won", "tp", "fp"])


def _below(score: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows by others: 1 where the other's score is smaller, 0.5 where it is equal."""
    return (others < score[:, None]).astype(np.float32) + (others == score[:, None]) * np.float32(0.5)


def _poisson(u: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the cuts each draw reaches; few draws reach the fourth."""
    w = np.zeros(u.shape, np.float32)
    for cut in cuts[:4]:
        w += u >= cut
    many = np.flatnonzero(u.ravel() >= cuts[4])
    w.ravel()[many] += np.searchsorted(cuts[4:], u.ravel()[many], side="right")
    return w


def _fixed(w: np.ndarray, y: np.ndarray, score: np.ndarray):
    """pos, neg and won of _Range.add, for rows of one label that count w times. Sums of a slice are exact in 32 bits."""
    ones = y == 1

    def of(label):
        mine = ones if label else ~ones

        def total(rows):
            part = np.zeros(len(y), np.float32)
            part[rows] = mine[rows]
            return (part @ w).astype(float)

        return total

    def won(f, e):
        pos, neg = np.flatnonzero(ones[f:e]) + f, np.flatnonzero(~ones[f:e]) + f
        return np.einsum("ij,ij->j", w[pos], _below(score[pos], score[neg]) @ w[neg]).astype(float)

    return of(1), of(0), won


def _drawn(label: np.ndarray, score: np.ndarray):
    """pos, neg and won of _Range.add, where the label differs between replicates."""
    n = len(score)

    def part(rows):
        out = np.zeros(n, np.float32)
        out[rows] = 1
        return out

    def pos(rows):
        return (part(rows) @ label).astype(float)

    def neg(rows):
        out = part(rows)
        return out.sum() - (out @ label).astype(float)

    def won(f, e):
        mine, below = label[f:e], _below(score[f:e], score[f:e])
        return np.einsum("ij,ij->j", mine, below.sum(1, keepdims=True) - below @ mine).astype(float)

    return pos, neg, won


def _weighted(scheme: str, coef: np.ndarray, cut: dict[str, np.ndarray]):
    cuts = np.array(poisson_cuts())
    high, rest = {g: c >> 31 for g, c in cut.items()}, {g: c & PRIME for g, c in cut.items()}

    def measures(group: str, h, t, y, side, score):
        """What _Range.add takes, by group; for `swap` of side a and of side b."""
        u = draws(h, coef)
        if scheme == "bootstrap":
            return {group: _fixed(_poisson(u, cuts), y, score)}
        if scheme == "swap":
            swap = u < (PRIME + 1) // 2
            swap[:, 0] = False
            a = (swap == (side == 1)[:, None]).astype(np.float32)
            return {f"{group}a": _fixed(a, y, score), f"{group}b": _fixed(1 - a, y, score)}
        if group not in cut:
            return {group: _fixed(np.ones(u.shape, np.float32), y, score)}
        label = (u < high[group]).astype(np.float32)
        row, rep = np.nonzero(u == high[group])
        label[row, rep] = t[row] <= rest[group][rep]
        return {group: _drawn(label, score)}

    def run(batches):
        open_: dict[str, _Range] = {}
        current = None
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("g", "s", "y", "pred", "h", "t", "side")}
            group = np.array(columns.pop("g").to_pylist(), object)
            s, y, pred, h, t, side = (np.asarray(columns[c]) for c in ("s", "y", "pred", "h", "t", "side"))
            edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if group[a] != current:
                    for name, found in open_.items():
                        yield from found.rows(name)
                    open_, current = {}, group[a]
                for k in range(a, b, SLICE):
                    at = slice(k, min(k + SLICE, b))
                    for name, (pos, neg, won) in measures(current, h[at], t[at], y[at], side[at], s[at]).items():
                        open_.setdefault(name, _Range(coef.shape[1])).add(s[at], pos, neg, won, pred[at] > 0)
        for name, found in open_.items():
            yield from found.rows(name)

    return run


def _cuts_of_labels(rows: DataFrame, coef: np.ndarray) -> dict[str, np.ndarray]:
    """Per group and replicate the largest draw that gets a positive label: exactly as many rows as the group has positives
    are not above it. Groups are few (channels); a group's rows are counted in bins around the place the cut is expected
    at, and only the rows of the bin that holds it are compared."""
    sizes = {r["g"]: (r["n"], r["k"]) for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).collect()}
    sizes = {g: (n, k) for g, (n, k) in sizes.items() if 0 < k < n}
    n_rep = coef.shape[1]
    edges = {}
    for g, (n, k) in sizes.items():
        share = k / n
        reach = SPAN * PRIME * math.sqrt(share * (1 - share) / n)
        edges[g] = np.unique(np.clip(np.linspace(share * PRIME - reach, share * PRIME + reach, BINS + 1).astype(np.int64), 0, PRIME))

    def parts(batch):
        group = np.array(batch.column(0).to_pylist(), object)
        h, t = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for g in edges:
            at = np.flatnonzero(group == g)
            for k in range(0, len(at), SLICE):
                some = at[k : k + SLICE]
                yield g, draws(h[some], coef), t[some]

    def count(batches):
        total = {g: np.zeros((n_rep, len(e) + 1), np.int64) for g, e in edges.items()}
        for batch in batches:
            for g, u, _ in parts(batch):
                e, each = edges[g], total[g]
                under, over = u < e[0], u >= e[-1]
                each[:, 0] += under.sum(0)
                each[:, -1] += over.sum(0)
                row, rep = np.nonzero(~(under | over))  # few, of many rows
                each += np.bincount(rep * each.shape[1] + np.searchsorted(e, u[row, rep], side="right"), minlength=each.size).reshape(each.shape)
        for g, each in total.items():
            rep, at = np.nonzero(each)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(rep), pa.string()), pa.array(rep, pa.int32()), pa.array(at, pa.int32()), pa.array(each[rep, at])], names=["g", "replicate", "bin", "n"])

    keyed = rows.select("g", "h", "t")
    counts = keyed.mapInArrow(count, "g string, replicate int, bin int, n long").groupBy("g", "replicate", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "replicate").orderBy("bin"))
    wanted = F.element_at(F.create_map(*(x for g, (_, k) in sizes.items() for x in (F.lit(g), F.lit(k)))), F.col("g")) if sizes else F.lit(0)
    found = counts.withColumn("upto", upto).withColumn("k", wanted).where("upto >= k and upto - n < k")
    chosen = {g: np.full(n_rep, -1, np.int64) for g in sizes}
    left = {g: np.zeros(n_rep, np.int64) for g in sizes}
    for r in found.collect():  # a row per group and replicate
        chosen[r["g"]][r["replicate"]], left[r["g"]][r["replicate"]] = r["bin"], r["k"] - (r["upto"] - r["n"])

    ends = {g: np.r_[-1, e, PRIME + 1] for g, e in edges.items()}
    lows, highs = {g: ends[g][chosen[g]] for g in sizes}, {g: ends[g][chosen[g] + 1] for g in sizes}

    def keys(batches):
        for batch in batches:
            for g, u, t in parts(batch):
                row, rep = np.nonzero((u >= lows[g]) & (u < highs[g]))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(row), pa.string()), pa.array(rep, pa.int32()), pa.array(u[row, rep] << 31 | t[row]), pa.array(left[g][rep])], names=["g", "replicate", "key", "place"])

    place = F.row_number().over(Window.partitionBy("g", "replicate").orderBy("key"))
    picked = keyed.mapInArrow(keys, "g string, replicate int, key long, place long").withColumn("nth", place).where("nth = place")
    cut = {g: np.full(n_rep, -1, np.int64) for g in sizes}
    for r in picked.select("g", "replicate", "key").collect():
        cut[r["g"]][r["replicate"]] = r["key"]
    return cut


def replicated(rows: DataFrame, scheme: str, row_id: str, n: int, seed: str, y: str = "y", score: str = "p", pred: str | None = None, group: str | None = None, side: str | None = None, beta: float = 2.0) -> DataFrame:
    """g, replicate, roc_auc and the confusion metrics of each of n replicates.

    Rows without a finite score or a label don't count. pred defaults to score >= 0.5; row ids are distinct within a group;
    for `swap`, side is 0 or 1 and g ends in a or b. group: few values. Tasks see rows, in any number, but never replicates
    of them as rows.
    """
    s = finite(F.col(score))
    row = F.col(row_id) if group is None else F.concat_ws("|", group, row_id)
    given = F.col(pred).cast("int") if pred else (s >= 0.5).cast("int")
    base = rows.select((F.lit("") if group is None else F.col(group).cast("string")).alias("g"), (s + F.lit(0.0)).alias("s"), F.col(y).cast("int").alias("y"), F.coalesce(given, F.lit(0)).alias("pred"), hashed(row, seed, 0).alias("h"), hashed(row, seed, 1).alias("t"), (F.col(side).cast("int") if side else F.lit(0)).alias("side")).where("s is not null and y is not null and g is not null")
    base = settle(base)  # read once to find the ranges, once to deal the rows, and for labels three times more
    coef = coefficients(seed, n)
    cut = _cuts_of_labels(base, coef) if scheme == "labels" else {}
    dealt = base.repartitionByRange("g", "s", "h").sortWithinPartitions("g", "s", "h")
    parts = dealt.mapInArrow(_weighted(scheme, coef, cut), "g string, low double, tie boolean, replicate int, pos double, neg double, won double, tp double, fp double")
    total = lambda c: F.sum(c).alias(c)
    # a score that is cut over tasks
    parts = parts.groupBy("g", "replicate", "low", "tie").agg(*map(total, ("pos", "neg", "won", "tp", "fp")))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("g", "replicate").orderBy("low", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("won", F.col("won") + F.when(F.col("tie"), F.col("pos") * F.col("neg") / 2).otherwise(0.0) + F.col("pos") * below)
    cells = parts.groupBy("g", "replicate").agg(*map(total, ("pos", "neg", "won", "tp", "fp")))
    cells = cells.select("g", "replicate", "tp", (F.col("neg") - F.col("fp")).alias("tn"), "fp", (F.col("pos") - F.col("tp")).alias("fn"), F.try_divide("won", F.col("pos") * F.col("neg")).alias("roc_auc"))
    return rates(cells, beta)
