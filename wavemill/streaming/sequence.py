"""The causal operators on streams: state per series, rows of a trigger taken in epoch_id order.

Row-count windows do not exist on streams, so the state holds the last values (moving average, vote) and the alarm's
state. Input is expected in order across triggers; within a trigger any order will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequence import Alarm


def _next_state(rule: Alarm, state: int, p: float) -> int:
    high, low = p >= rule.t_on, p < rule.t_off
    if state >= rule.on:
        if not low:
            return rule.on
        run = state - rule.on + 1
        return rule.refractory if run >= rule.min_off else rule.on + run
    run, cooldown = divmod(state, rule.refractory + 1)
    cooldown = max(cooldown - 1, 0)
    if cooldown:
        return run * (rule.refractory + 1) + cooldown
    if not high:
        return 0
    return rule.on if run + 1 >= rule.min_on else (run + 1) * (rule.refractory + 1)


def smooth_vote_alarm(scores: DataFrame, average: int, cut: float, k: int, n: int, rule: Alarm) -> DataFrame:
    """recording, epoch_id, p (smoothed), vote and alarm of a stream of scores(recording, epoch_id, p)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, votes, at = state.get if state.exists else ([], [], 0)
        values, votes = list(values), list(votes)
        rows = pd.concat(list(parts)).sort_values("epoch_id")
        out = []
        for epoch, p in zip(rows["epoch_id"], rows["p"], strict=True):
            values = [*values, float(p)][-average:]
            p = sum(values) / len(values)
            votes = [*votes, int(p >= cut)][-n:]
            at = _next_state(rule, at, p)
            out.append((key[0], int(epoch), p, int(len(votes) == n and sum(votes) >= k), int(at >= rule.on)))
        state.update((values, votes, at))
        yield pd.DataFrame(out, columns=["recording", "epoch_id", "p", "vote", "alarm"])

    out = "recording long, epoch_id long, p double, vote int, alarm int"
    return scores.groupBy("recording").applyInPandasWithState(run, out, "values array<double>, votes array<int>, at int", "append", GroupStateTimeout.NoTimeout)
