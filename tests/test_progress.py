"""Progress lines of written tables and of streams."""

import json
import logging
import time

import pytest
from pyspark.sql import functions as F

from wavemill.sources import progress, scratch


@pytest.fixture
def lines():
    seen = []
    handler = logging.Handler()
    handler.emit = lambda record: seen.append(json.loads(record.getMessage()))
    progress.LOG.addHandler(handler)
    level = progress.LOG.level
    progress.LOG.setLevel(logging.INFO)
    yield seen
    progress.LOG.removeHandler(handler)
    progress.LOG.setLevel(level)


def test_a_written_table_tells_rows_nulls_and_measures(spark, lines):
    df = spark.createDataFrame([(1, None, "left"), (2, float("nan"), "cleaned"), (3, None, None)], "id int, `v.w` double, ica_status string").repartition(3)
    table = scratch.settle(df, "train", failed=F.count_if(F.col("ica_status") == "left"))
    assert table.count() == 3
    (line,) = lines
    assert line.pop("seconds") >= 0
    assert line == {"stage": "train", "rows": 3, "nulls": {"v.w": 2, "ica_status": 1}, "failed": 1}
    scratch.drop(table)


def test_empty_tables_and_stages_without_a_name(spark, lines):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    scratch.drop(scratch.settle(df.where("id > 5"), "nothing"))
    scratch.drop(scratch.settle(df.limit(0), "known to be empty"))
    scratch.drop(scratch.settle(df))
    assert [(x["stage"], x["rows"], x["nulls"]) for x in lines] == [("nothing", 0, {}), ("known to be empty", 0, {})]


def test_stream_batches_are_reported(spark, lines, tmp_path):
    spark.createDataFrame([(k, None if k % 4 == 0 else float(k)) for k in range(20)], "id int, v double").repartition(2).write.parquet(str(tmp_path / "in"))
    listener = progress.StreamLines()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = progress.watch_stream(source, "epochs", high=F.max("v")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(60)
        until = time.time() + 20
        while sum(x["rows"] for x in lines) < 20 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(x["rows"] for x in lines) == 20 and sum(x["nulls"].get("v", 0) for x in lines) == 5
    assert {x["stage"] for x in lines} == {"epochs"} and max(x["high"] for x in lines) == 19.0 and len({x["batch"] for x in lines}) == 2
