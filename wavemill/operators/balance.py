"""Resampling, subsampling and folds; all draws come from md5 of (seed, row), so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import uniform

CELL_DIGITS, DRAWS = 3, 1 << 14


def class_counts(rows: DataFrame, y: str = "y") -> DataFrame:
    """One row with the map class -> rows."""
    counts = rows.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(y, "n")))).alias("counts"))


def ranked(rows: DataFrame, group: str, row_id: str, seed: str, out: str = "rank") -> DataFrame:
    """Rank from 0 within each group in the order of a seeded hash; a group's rows are spread over the hash's cells."""
    rows = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")))).withColumn("__cell", F.substring("__h", 1, CELL_DIGITS))
    ahead = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(group, "__cell").orderBy("__h", row_id))
    rows = rows.withColumn("__r", within)
    return rows.join(cells, [group, "__cell"]).withColumn(out, F.col("__before") + F.col("__r") - 1).drop("__h", "__cell", "__r", "__before")


def _class_sizes(rows: DataFrame, y: str) -> DataFrame:
    return rows.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def undersample(rows: DataFrame, row_id: str, seed: str = "42", y: str = "y") -> DataFrame:
    """As many rows of each class as the smallest one has, without replacement."""
    least = _class_sizes(rows, y).agg(F.min("n")).first()[0] or 0
    return ranked(rows.where(F.col(y).isNotNull()), y, row_id, seed).where(F.col("rank") < least).drop("rank")


def oversample(rows: DataFrame, row_id: str, seed: str = "42", y: str = "y") -> DataFrame:
    """All rows, and draws with replacement from smaller classes until all are as large; `draw` is null for originals."""
    sizes = _class_sizes(rows, y)
    most = sizes.agg(F.max("n")).first()[0] or 0
    # draws are numbered in two steps, so that no row holds a list of them all
    spans = sizes.where(F.col("n") < most).withColumn("__span", F.explode(F.sequence(F.lit(0), F.floor((F.lit(most) - F.col("n") - 1) / DRAWS))))
    last = F.least(F.col("__span") * DRAWS + DRAWS, F.lit(most) - F.col("n")) - 1
    draws = spans.repartition(y, "__span").withColumn("draw", F.explode(F.sequence(F.col("__span") * DRAWS, last)))
    at = F.floor(uniform(seed, F.col(y), F.col("draw")) * F.col("n")).cast("bigint")
    numbered = ranked(rows, y, row_id, seed)
    drawn = numbered.join(draws.select(y, at.alias("rank"), "draw"), [y, "rank"])
    return numbered.withColumn("draw", F.lit(None).cast("bigint")).unionByName(drawn).drop("rank")


def subsample(rows: DataFrame, row_id: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement: the first by a seeded hash."""
    return rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")))).orderBy("__h", row_id).limit(n).drop("__h")


def stratified_folds(rows: DataFrame, row_id: str, k: int = 3, seed: str = "42", y: str = "y") -> DataFrame:
    """rows with `fold`: classes are dealt over the folds in turn, in the order of a seeded hash."""
    return ranked(rows, y, row_id, seed).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")
