"""Progress lines: what a stage wrote.

A line is one JSON object on the logger `wavemill.progress`: stage, rows, nulls by column, further measures and seconds.
The figures of a written table come from one pass over it, made only when the logger is on. An Observation would save
that pass, but a session that holds one can no longer ship fitted models to tasks (Spark 4.1). Streams are observed by
name and report through a listener, a line per batch.
"""

from __future__ import annotations

import json
import logging
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger("wavemill.progress")


def measures(df: DataFrame, **further: Column) -> dict[str, Column]:
    """Aggregates by name: rows, nulls of each column (`nulls.<name>`, NaN not counted), and those given."""
    nulls = {f"nulls.{c}": F.count_if(df[f"`{c}`"].isNull()) for c in df.columns}
    return {"rows": F.count(F.lit(1)), **nulls, **further}


def line(stage: str, values: dict, seconds: float | None = None) -> dict:
    """The object of a line: nulls gathered under one key, only columns that have any."""
    nulls = {k[len("nulls."):]: v for k, v in values.items() if k.startswith("nulls.") and v}
    rest = {k: v for k, v in values.items() if k != "rows" and not k.startswith("nulls.")}
    out = {"stage": stage, "rows": values.get("rows") or 0, "nulls": nulls, **rest}
    return out if seconds is None else out | {"seconds": round(seconds, 3)}


def show() -> None:
    """Progress lines on standard output."""
    if not LOG.handlers:
        LOG.addHandler(logging.StreamHandler(sys.stdout))
    LOG.setLevel(logging.INFO)


def emit(entry: dict) -> None:
    LOG.info(json.dumps(entry, sort_keys=True, default=str))


def report(table: DataFrame, stage: str, seconds: float, **further: Column) -> None:
    """Emit the line of a table that was just written; costs one pass over it, and nothing when no one listens."""
    if LOG.isEnabledFor(logging.INFO):
        found = table.agg(*(c.alias(n) for n, c in measures(table, **further).items())).first()
        emit(line(stage, found.asDict(), seconds))


def watch_stream(df: DataFrame, stage: str, **further: Column) -> DataFrame:
    """A streaming df whose batches are reported under the stage's name by a listener."""
    return df.observe(f"wavemill.{stage}", *(c.alias(n) for n, c in measures(df, **further).items()))


class StreamLines(StreamingQueryListener):
    """Emits a line per batch and watched stage; add it with spark.streams.addListener."""

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            if name.startswith("wavemill."):
                emit(line(name[len("wavemill."):], row.asDict()) | {"batch": progress.batchId})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            emit({"stage": "stream", "error": str(event.exception).split("\n")[0]})
