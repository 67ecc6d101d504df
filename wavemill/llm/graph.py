"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: A table of this many links at most (a few megabytes) is finished by one task; the rounds of joins cost more than that.
ONE_TASK = 1 << 18


def _joined(batches):
    """Labels of all nodes of a small link table, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(x) for x in nodes], np.int64))], names=["node", "component"])


def _round(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, was, component) after one round; `was` is the component before it."""
    near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
    moves = labels.select("node", "component").join(near, "node").groupBy("component").agg(F.min("near").alias("next")).where("next < component")
    ahead = moves.select(F.col("component").alias("next"), F.col("next").alias("after"))
    further = moves.join(ahead, "next", "left").select("component", F.coalesce("after", "next").alias("next"))
    return labels.select("node", "component").join(further, "component", "left").select("node", F.col("component").alias("was"), F.coalesce("next", "component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of each id in links(a, b): columns node, component.

    Nodes start with the least id among their neighbours and themselves. In each round every group of nodes with one
    label takes the least label that touches it, and that label's own new label; the rounds needed grow with the
    logarithm of a chain's length. Every second round is written to the shared folder, until the last of them moved no
    node. Nothing but a count comes to the driver. A table of at most ONE_TASK links
    takes no rounds but one task.
    """
    links = links.where("a <> b")
    one_way = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if one_way.count() <= ONE_TASK:
        out = materialise(one_way.coalesce(1).mapInArrow(_joined, "node long, component long"), "labels")
        discard(one_way)
        return out
    links = one_way
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels, written = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), []
    while True:
        labels = materialise(_round(edges, _round(edges, labels)), "labels")
        for table in written:
            discard(table)
        written = [labels]
        if not labels.where("component <> was").limit(1).count():
            for table in (edges, one_way):
                discard(table)
            out = labels.select("node", "component")
            out._scratch_path = labels._scratch_path
            return out


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components over links(a, b) and those that gave `labels`: ids of further links join the labels' components."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = materialise(ends.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b").distinct(), "links")
    if not ends.limit(1).count():
        discard(ends)
        return labels
    anew = components(ends)
    anew = anew.select(F.col("node").alias("component"), F.col("component").alias("least"))
    old = labels.join(anew, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    fresh = anew.join(labels.select("node"), anew.component == labels.node, "left_anti")
    out = materialise(old.unionByName(fresh.select(F.col("component").alias("node"), F.col("least").alias("component"))), "labels")
    for table in (ends, labels):
        discard(table)
    return out
