"""Joins and lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join many rows with a lookup that has one row per key.

    Rows of one key are dealt over `salts` groups and the lookup is repeated once per group. The lookup is
    an aggregate (unique keys), so repeating it is cheap next to the rows; nothing is dropped or capped.
    Adaptive execution may still turn this into a broadcast when the lookup turns out small.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def count_distinct(rows: DataFrame, keys: list[str], what: str, out: str) -> DataFrame:
    """Distinct `what` per key in two aggregations: (key, what) pairs first, which spreads a hot key."""
    return rows.filter(F.col(what).isNotNull()).groupBy(*keys, what).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count("_one").alias(out))
