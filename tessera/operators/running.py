"""Running sums per key that a hot key cannot turn into one task.

A window ``PARTITION BY key ORDER BY ...`` puts every row of a key into one
task. When one key may hold a large share of all rows, the order range is
cut into buckets (a column that grows with the order, e.g. a time bucket):
per ``(key, bucket)`` totals are summed over earlier buckets on the small
bucket table, and the running sum inside a bucket runs per ``(key,
bucket)``. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, key: str, order: list[str], value: Column, out: str, bucket: str | None = None
) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over the rows of the same key up to this one (inclusive).

    ``bucket`` names a column of ``df`` that grows with the order; several
    steps on the same bucket column share one ``(key, bucket)`` partitioning.
    """
    if bucket is None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    b = bucket
    d = df.withColumn(f"_{out}_v", value)
    totals = d.groupBy(key, b).agg(F.sum(f"_{out}_v").alias("_t"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, b, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(f"_{out}_off"))
    inside = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(offsets, [key, b])
    return d.withColumn(out, F.col(f"_{out}_off") + F.sum(f"_{out}_v").over(inside)).drop(f"_{out}_v", f"_{out}_off")


def last_marked(
    df: DataFrame, key: str, order: list[str], mark: Column, value: str, out: str, bucket: str | None = None
) -> DataFrame:
    """Adds ``out`` = ``value`` at the last row (up to this one) of the same key where ``mark`` holds."""
    marked = F.when(mark, F.col(value))
    if bucket is None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(marked, ignorenulls=True).over(w))
    b = bucket
    d = df.withColumn(f"_{out}_m", marked)
    ordered = F.struct(*[F.col(c) for c in order])
    per_b = d.filter(F.col(f"_{out}_m").isNotNull()).groupBy(key, b).agg(
        F.max_by(f"_{out}_m", ordered).alias("_last")
    )
    # one row per non-empty bucket with its own last mark (or null); carry the
    # last earlier mark forward over this small table
    buckets = d.select(key, b).distinct().join(per_b, [key, b], "left")
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select(key, b, F.last("_last", ignorenulls=True).over(before).alias(f"_{out}_c"))
    inside = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(carry, [key, b], "left")
    d = d.withColumn(out, F.coalesce(F.last(f"_{out}_m", ignorenulls=True).over(inside), F.col(f"_{out}_c")))
    return d.drop(f"_{out}_m", f"_{out}_c")
