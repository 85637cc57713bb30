"""Numbering long lists in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import staged


def numbered_in_order(rows: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row among those of its keys (or of all rows, without keys), from 1, in the order given.

    Rows are dealt into ranges of (keys, order) first, so a key with most of the rows is many ranges. A row's place is the
    number of its key's rows in earlier ranges, known from one count a range, and its place inside its range. Rows of the
    same order stand in any order among themselves, but in one range.
    """
    ranged = staged(rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "range_").agg(F.count(F.lit(1)).alias("n_"))
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).drop("n_")   # a row per key and range
    inside = ranged.withColumn("inside_", F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(*order)))
    b = before.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("range_").alias("range_b"), "before_")
    same = F.col("range_") == F.col("range_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    placed = inside.join(b, same)
    return placed.select(*rows.columns, (F.col("before_") + F.col("inside_")).alias(out))
