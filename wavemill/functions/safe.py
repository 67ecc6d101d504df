"""Null, NaN and randomness rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or `empty` where b is 0."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of the key's parts: the same on every engine and rerun."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


UNIFORM_SQL = "(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def uniform_sql(key: str) -> str:
    return UNIFORM_SQL.format(key=key)
