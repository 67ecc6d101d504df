"""Causal operators over score series: moving average, k-of-n vote, hysteresis alarm.

A series may hold a third of all rows, so none of them sorts a whole series in one task: series are cut into chunks of
consecutive epoch_ids. Windows get the few rows before their chunk as well. The alarm is a finite automaton: each chunk
tells, for every state it may be entered in, the state it is left in; those small tables are composed in a tree, and then
each chunk runs once from its true start state. `epoch_id` counts a series' rows from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, ALARM_CHUNK, FAN = 1 << 16, 256, 256


def _with_halo(scores: DataFrame, key: str, back: int, chunk: int) -> DataFrame:
    """Each row in its chunk, and the last `back` rows of a chunk once more in front of the next one."""
    at = F.floor(F.col("epoch_id") / chunk)
    late = F.col("epoch_id") % chunk >= chunk - back
    homes = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
    return scores.withColumn("__chunk", F.explode(homes)).withColumn("__own", F.col("__chunk") == F.floor(F.col("epoch_id") / chunk))


def _trailing(scores: DataFrame, key: str, n: int, chunk: int):
    if n - 1 >= chunk:
        raise ValueError("the window must be shorter than a chunk")
    frame = Window.partitionBy(key, "__chunk").orderBy("epoch_id").rowsBetween(-(n - 1), 0)
    return _with_halo(scores, key, n - 1, chunk), frame


def moving_average(scores: DataFrame, n: int, value: str = "p", key: str = "recording", chunk: int = CHUNK) -> DataFrame:
    """`value` replaced by the mean of the last n values (fewer at the start)."""
    if n <= 1:
        return scores
    rows, frame = _trailing(scores, key, n, chunk)
    return rows.withColumn(value, F.avg(value).over(frame)).where("__own").drop("__own", "__chunk")


def k_of_n(scores: DataFrame, spec: str, pred: str = "pred", out: str = "vote", key: str = "recording", chunk: int = CHUNK) -> DataFrame:
    """`out` is 1 where at least k of the last n predictions are 1; 0 while fewer than n have been seen. spec: "k/n"."""
    try:
        k, n = (int(x) for x in spec.split("/"))
    except ValueError as e:
        raise ValueError(f"expected k/n, got {spec!r}") from e
    if not 0 < k <= n:
        raise ValueError(f"expected 0 < k <= n, got {spec!r}")
    rows, frame = _trailing(scores, key, n, chunk)
    vote = (F.sum(pred).over(frame) >= k) & (F.col("epoch_id") >= n - 1)
    return rows.withColumn(out, F.coalesce(vote.cast("int"), F.lit(0))).where("__own").drop("__own", "__chunk")


def threshold(scores: DataFrame, at: float, value: str = "p", out: str = "pred") -> DataFrame:
    return scores.withColumn(out, ((F.col(value) >= at) & ~F.isnan(value)).cast("int"))


@dataclass(frozen=True)
class Alarm:
    """Hysteresis alarm. Off: `min_on` scores of at least t_on in a row switch it on. On: `min_off` scores under t_off in
    a row switch it off, and the next `refractory` epochs count down before scores count again (the last of them does).
    Missing scores count for neither side."""

    t_on: float
    t_off: float
    min_on: int = 1
    min_off: int = 1
    refractory: int = 0

    @property
    def on(self) -> int:
        """Number of the first state that is on; off states are (scores in a row, cooldown), on states scores in a row."""
        return self.min_on * (self.refractory + 1)

    @property
    def states(self) -> int:
        return self.on + self.min_off

    def step(self, state: Column, p: Column) -> Column:
        """The state after a score. It is on exactly where the alarm is given."""
        wide = self.refractory + 1
        score = F.when(F.isnan(p), None).otherwise(p)
        high, low = F.coalesce(score >= self.t_on, F.lit(False)), F.coalesce(score < self.t_off, F.lit(False))
        run, cooldown = F.floor(state / wide).cast("int"), F.greatest(state % wide - 1, F.lit(0))
        counted = F.when(high, F.when(run + 1 >= self.min_on, F.lit(self.on)).otherwise((run + 1) * wide)).otherwise(F.lit(0))
        from_off = F.when(cooldown > 0, run * wide + cooldown).otherwise(counted)
        off_run = state - self.on + 1
        from_on = F.when(low, F.when(off_run >= self.min_off, F.lit(self.refractory)).otherwise(self.on + off_run)).otherwise(F.lit(self.on))
        return F.when(state >= self.on, from_on).otherwise(from_off).cast("int")


def alarm(scores: DataFrame, rule: Alarm, value: str = "p", key: str = "recording", chunk: int = ALARM_CHUNK) -> DataFrame:
    """key, epoch_id, value and alarm (0 or 1).

    The chunks' tables are composed in a tree, FAN at a time, up to one per series; start states then go down again.
    """
    last = scores.agg(F.max("epoch_id")).first()[0] or 0
    rows = scores.select(key, "epoch_id", F.col(value).alias("p"), F.floor(F.col("epoch_id") / chunk).alias("chunk"))
    chunks = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("epoch_id", "p"))).alias("rows"))  # chunk rows at most
    every = F.sequence(F.lit(0), F.lit(rule.states - 1))
    level = chunks.select(key, "chunk", F.transform(every, lambda s: F.aggregate("rows", s, lambda state, r: rule.step(state, r["p"]))).alias("ends"))
    parents, left = [], last // chunk
    while True:
        parent = level.groupBy(key, F.floor(F.col("chunk") / FAN).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("tables"))  # FAN at most
        parents.append(parent)
        left //= FAN
        if not left:
            break
        level = parent.select(key, "chunk", F.transform(every, lambda s: F.aggregate("tables", s, lambda state, t: F.get(t["ends"], state))).alias("ends"))
    starts = None
    for parent in reversed(parents):
        parent = parent.withColumn("state", F.lit(0)) if starts is None else parent.join(starts, [key, "chunk"])
        begin = F.struct(F.col("state").alias("state"), F.array().cast("array<int>").alias("seen"))
        walked = F.aggregate("tables", begin, lambda a, t: F.struct(F.get(t["ends"], a["state"]).alias("state"), F.concat(a["seen"], F.array(a["state"])).alias("seen")))
        starts = parent.select(key, F.explode(F.arrays_zip(F.col("tables.chunk").alias("chunk"), walked["seen"].alias("state"))).alias("s")).select(key, "s.chunk", "s.state")
    begin = F.struct(F.col("state").alias("state"), F.array().cast("array<int>").alias("given"))
    ran = F.aggregate("rows", begin, lambda a, r: _advance(rule, a, r))
    out = chunks.join(starts, [key, "chunk"]).select(key, F.explode(F.arrays_zip(F.col("rows.epoch_id").alias("epoch_id"), F.col("rows.p").alias("p"), ran["given"].alias("alarm"))).alias("r"))
    return out.select(key, "r.epoch_id", F.col("r.p").alias(value), "r.alarm")


def _advance(rule: Alarm, acc: Column, row: Column) -> Column:
    after = rule.step(acc["state"], row["p"])
    return F.struct(after.alias("state"), F.concat(acc["given"], F.array((after >= rule.on).cast("int"))).alias("given"))
