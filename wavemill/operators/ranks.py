"""Running counts and quantiles in the order of a value, for groups of any size and any distribution.

A value's place is split into digits of its binary floating-point form: sign, exponent and 12 bits of its mantissa, then
20 bits, then the rest. Counts are summed per digit first and within a digit next, so every window runs over a bounded
number of rows, whether values are spread over many powers of ten or crowded near one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite


def _digits(v: Column) -> tuple[Column, Column]:
    """Two integers, in the order of v; splitting by powers of two is exact."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent.cast("double")) * 4096
    whole = F.floor(mantissa)
    sign = F.signum(v).cast("bigint")
    coarse = F.when(size == 0, F.lit(0)).otherwise(sign * ((exponent + 1100) * 8192 + whole))
    return coarse.cast("bigint"), F.when(size == 0, F.lit(0)).otherwise(sign * F.floor((mantissa - whole) * (1 << 20))).cast("bigint")


def with_below(counts: DataFrame, by: list[str], v: str, n: str, out: str = "below") -> DataFrame:
    """counts (a row per group and distinct finite v) with `out`: the sum of n over the group's smaller values."""
    coarse, fine = _digits(F.col(v))
    rows = counts.withColumns({"__c": coarse, "__f": fine})
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda column, keys, order: F.coalesce(F.sum(column).over(before(keys, order)), F.lit(0))
    top = rows.groupBy(*by, "__c").agg(F.sum(n).alias("__n")).withColumn("__b1", run("__n", by, "__c")).drop("__n")
    middle = rows.groupBy(*by, "__c", "__f").agg(F.sum(n).alias("__n")).withColumn("__b2", run("__n", [*by, "__c"], "__f")).drop("__n")
    joined = rows.join(middle, [*by, "__c", "__f"]).join(top, [*by, "__c"])
    return joined.withColumn(out, F.col("__b1") + F.col("__b2") + run(n, [*by, "__c", "__f"], v)).drop("__c", "__f", "__b1", "__b2")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of the finite values of each group that has any."""
    counts = rows.withColumn("__v", finite(F.col(value))).where("__v is not null").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__k"))
    placed = with_below(counts, by, "__v", "__k", "__below").join(counts.groupBy(*by).agg(F.sum("__k").alias("__all")), by)
    holds = lambda place: (F.col("__below") <= place) & (place < F.col("__below") + F.col("__k"))
    found, out = [], []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * F.lit(share)
        found += [F.max(F.when(holds(F.floor(place)), F.col("__v"))).alias(f"__lo_{name}"), F.max(F.when(holds(F.ceil(place)), F.col("__v"))).alias(f"__hi_{name}"), F.max(place - F.floor(place)).alias(f"__p_{name}")]
        low, high, part = (F.col(f"__{x}_{name}") for x in ("lo", "hi", "p"))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return placed.groupBy(*by).agg(*found).select(*by, *out)
