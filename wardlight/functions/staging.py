"""Computing columns exactly once.

Catalyst moves filters below projections by writing the projected expressions into the filter. For a column that
costs milliseconds (dozens of regular expressions over a text) and feeds hundreds of others, that repeats the work
hundreds of times. A column that comes out of a one-row generator is a value: filters on it stay above, filters on
the input columns still go down to the scan, and no projection is merged across it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with the columns added, each evaluated once per row."""
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def stage_fields(df: DataFrame, row: Column) -> DataFrame:
    """The same for a struct: its fields become columns, so nothing above refers into a nested value."""
    return df.select("*", F.inline_outer(F.array(row)))
