"""Joins with small tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table kept by hand (configs, checkpoints, watched columns) that may be broadcast.
SMALL_ROWS = 100_000
#: Tasks over which the rows of one key are dealt where the other side isn't small.
PARTS = 64


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table has at most so many rows; no more than that is counted."""
    most = SMALL_ROWS if rows is None else rows
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its counted rows allow. Spark has no estimate for tables made in the driver and would
    shuffle the large side by a key of few values."""
    return F.broadcast(df) if is_small(df) else df


def join_few_keys(large: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """large.join(other, on, how) where a key may hold a large part of all rows: other is broadcast if it is small; else the
    rows of a key are dealt over PARTS tasks, each of which gets that key's rows of the other side."""
    if is_small(other):
        return large.join(F.broadcast(other), on, how)
    dealt = large.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    each = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(each, [*on, "_part"], how).drop("_part")
