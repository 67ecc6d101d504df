"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. Sources share the words of all documents in proportion to their weights; a source stops at `cap` times its own
words and what it leaves is reshared by weight until no source is above its cap. In order of cap / weight, the stopped
sources are the first ones: source k is the first that is not stopped if (all words - caps before it) / (weights from it
on) is at most its cap / weight, and that quotient is everyone's share per weight.

Repetitions. A source's target is so many whole passes over it plus a rest. The rest goes to its documents in the order
of a seeded hash: each is taken once more while the rest lasts, the last of them in part. So a source meets its target to
the word. The running sums that this needs are taken over cells (a source's rows with a common hash prefix, as long as
the row count asks for) and then within a cell, so that a source with a third of all rows is spread like any other.

Defined results: a null text has no words; very long texts are counted whole; a source of no words has target 0; documents without words are taken 0 times;
rows that share a doc_id are ordered by size; a null source is a source of its own, last in order; a null doc_id is
hashed as an empty id. Columns named size, source_size, target, whole, part or taken are replaced, others pass through.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

CAP, CELL_ROWS, SEED = 3, 4096, "mix"
WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("size", "source_size", "target", "whole", "part", "taken")


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size and target from sizes(source, source_size); weights 1, 2, 3 repeat in code-point order.

    All windows here run over one row per source.
    """
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    weighed = weighed.withColumn("limit", F.col("source_size") * cap)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quotient = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    shared = weighed.withColumn("q", quotient)
    level = F.min(F.when(F.col("q") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "q"))).over(every)
    shared = shared.withColumn("q", level.getField("q"))
    return shared.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("q") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs (with doc_id, source, size) and source_size, target, whole (passes), part (words of a further pass), taken."""
    own = [c for c in docs.columns if c not in _ADDED[1:]]
    docs = docs.select(*own, F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__h"))
    rows = docs.count()
    digits = 1
    while rows > CELL_ROWS * 16**digits:
        digits += 1
    docs = docs.withColumn("__cell", F.substring("__h", 1, digits))
    cells = materialise(docs.groupBy("source", "__cell").agg(F.sum("size").alias("words")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    aims = aims.withColumn("whole", whole).withColumn("__rest", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    cells = cells.withColumnRenamed("source", "__source").withColumnRenamed("__cell", "__c")
    cells = cells.join(aims, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    cells = materialise(cells, "cells")
    joined = docs.join(cells, (F.col("__cell") == F.col("__c")) & F.col("source").eqNullSafe(F.col("__source")))
    within = Window.partitionBy("source", "__cell").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    out = joined.withColumn("part", F.least(F.greatest(left, F.lit(0)), F.col("size")))
    return out.select(*own, "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(materialise(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
b AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * {CAP} AS cap FROM a),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS q FROM b),
d AS (SELECT *, (SELECT arg_min(q, cap / weight) FROM c WHERE q <= cap / weight) AS level FROM c),
e AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM d),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least({CAP}, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM e),
g AS (SELECT s.doc_id, s.size, f.source_size, f.target, f.whole, round_even(f.target - f.whole * f.source_size, 0)::BIGINT
          - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(remaining, 0), size))::BIGINT AS taken FROM g
"""
