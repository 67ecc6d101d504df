"""Alarm automaton, windows and votes: hand-traced cases, brute force, batch against stream."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.operators import sequence
from wavemill.operators.sequence import Alarm
from wavemill.streaming.sequence import _next_state, smooth_vote_alarm


def brute(p, rule):
    on = False
    on_run = off_run = cooldown = 0
    out = []
    for x in p:
        if not on:
            cooldown = max(cooldown - 1, 0)
            if cooldown == 0:
                on_run = on_run + 1 if x >= rule.t_on else 0
                if on_run >= rule.min_on:
                    on, on_run = True, 0
        else:
            off_run = off_run + 1 if x < rule.t_off else 0
            if off_run >= rule.min_off:
                on, off_run, cooldown = False, 0, rule.refractory
        out.append(int(on))
    return out


def run(spark, series, rule, chunk):
    rows = [(k, i, x) for k, p in series.items() for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "recording long, epoch_id long, p double").repartition(5)
    out = {}
    for r in sequence.alarm(df, rule, chunk=chunk).orderBy("recording", "epoch_id").collect():
        out.setdefault(r["recording"], []).append(r["alarm"])
    return out


def test_documented_cases(spark):
    a = [0.10, 0.70, 0.65, 0.50, 0.62, 0.61, 0.63, 0.30, 0.70, 0.80]
    assert run(spark, {1: a}, Alarm(0.6, 0.4, 2, 2, 3), 4)[1] == [0, 0, 1, 1, 1, 1, 1, 1, 1, 1]
    b = [0.9, 0.9, 0.1, 0.1, 0.9, 0.9, 0.9, 0.9]
    assert run(spark, {1: b}, Alarm(0.5, 0.5, 1, 2, 2), 3)[1] == [1, 1, 1, 0, 0, 1, 1, 1]


def test_chunks_do_not_matter(spark):
    rng = random.Random(1)
    series = {k: [rng.choice([0.1, 0.3, 0.5, 0.7, 0.9, float("nan")]) for _ in range(rng.randint(1, 80))] for k in range(12)}
    rule = Alarm(0.6, 0.4, 2, 2, 3)
    want = {k: brute(p, rule) for k, p in series.items()}
    assert run(spark, series, rule, 7) == want
    assert run(spark, series, rule, 1000) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.2, 0.4, 0.5, 0.6, 1.0, float("nan")]), max_size=60), st.integers(1, 4), st.integers(1, 4), st.integers(0, 5))
def test_stream_automaton(p, min_on, min_off, refractory):
    rule = Alarm(0.5, 0.4, min_on, min_off, refractory)
    state, out = 0, []
    for x in p:
        state = _next_state(rule, state, x)
        out.append(int(state >= rule.on))
    assert out == brute(p, rule)


def test_window_chunks_do_not_matter(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, i, rng.random()) for k in range(3) for i in range(50)], "recording long, epoch_id long, p double")
    a, b = (sequence.moving_average(df, 5, chunk=c).select("recording", "epoch_id", F.round("p", 12)).orderBy("recording", "epoch_id").collect() for c in (6, 1000))
    assert a == b
    t = sequence.threshold(df, 0.5)
    a, b = (sequence.k_of_n(t, "2/4", chunk=c).select("recording", "epoch_id", "vote").orderBy("recording", "epoch_id").collect() for c in (6, 1000))
    assert a == b
    assert all(r["vote"] == 0 for r in a if r["epoch_id"] < 3)


@pytest.mark.parametrize("spec", ["", "3", "5/3", "0/3", "a/b"])
def test_vote_rejects_bad_specs(spark, spec):
    with pytest.raises(ValueError):
        sequence.k_of_n(spark.createDataFrame([(1, 0, 1)], "recording long, epoch_id long, pred int"), spec)


def test_batch_equals_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, i, round(rng.random(), 3)) for k in range(4) for i in range(60)]
    source, rule = str(tmp_path / "in"), Alarm(0.55, 0.45, 2, 2, 2)
    df = spark.createDataFrame(rows, "recording long, epoch_id long, p double")
    for part in range(3):
        df.where(F.floor(F.col("epoch_id") / 20) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = smooth_vote_alarm(stream, 3, 0.5, 2, 3, rule).writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    smooth = sequence.moving_average(df, 3)
    vote = sequence.k_of_n(sequence.threshold(smooth, 0.5), "2/3")
    batch = vote.join(sequence.alarm(smooth, rule).select("recording", "epoch_id", "alarm"), ["recording", "epoch_id"])
    pick = lambda d: d.select("recording", "epoch_id", "vote", "alarm").orderBy("recording", "epoch_id").collect()
    assert pick(spark.table("causal")) == pick(batch)
