"""Running totals and previous rows over range partitions: what a window over one key does, without one task for that key.

Rows are range-partitioned by key and order, and stored. Inside a partition a window runs; what one partition hands on to the next
(totals, or the last value of each key) is one row for each partition and key that it holds, and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.relate import stored


def spread(rows: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """rows in range partitions by key and order, with the partition's number as _part."""
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(many, *(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))


def _carried(parts: DataFrame, totals: DataFrame, by: tuple[str, ...], names: list[str]) -> DataFrame:
    """parts with the carried columns of each partition and key."""
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    side = totals.select(F.col("_part").alias("_of"), *keys, *names)
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return parts.join(side, same, "left").drop("_of", *(f"_by_{c}" for c in by))


def running(rows: DataFrame, by: tuple[str, ...], order: list[Column], **sums: str) -> DataFrame:
    """rows with each named sum of a column over its key's rows before and up to the row, in the order given (which has no ties in a key)."""
    parts = rows if "_part" in rows.columns else spread(rows, by, order)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select("_part", *by, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _carried(parts, totals, by, [f"_{n}" for n in sums])
    return out.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop(*(f"_{n}" for n in sums))


def previous(rows: DataFrame, by: tuple[str, ...], order: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`: the value of the key's row before it, NULL for a key's first. The value itself is never NULL."""
    parts = spread(rows, by, [F.col(c) for c in order])
    last = parts.groupBy("_part", *by).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_part", *by, F.last("_last", ignorenulls=True).over(before).alias("_last"))
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    return _carried(parts, last, by, ["_last"]).withColumn(name, F.coalesce(F.lag(value).over(inside), "_last")).drop("_last")
