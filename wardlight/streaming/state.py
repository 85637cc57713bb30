"""Keyed decisions with state: rate limits, strikes, notices. State lives in RocksDB and expires when idle.

Rows of one key arrive in no order inside a micro-batch, so they are put in time order first; a micro-batch is
bounded by the source's trigger options. The steps are those of the batch operators.

Expiry runs on processing time, for which Spark schedules batches without data for as long as the query lives; a
run that should end by itself (`availableNow`) passes idle_seconds=None.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight import values as V
from wardlight.operators import moderation as M
from wardlight.session import STATE_STORE


class _Steps(StatefulProcessor):
    def __init__(self, step, columns: list[str], names: list[str], tie: str, extra: str | None, idle_seconds: float | None):
        self.step, self.columns, self.names = step, columns, names
        self.tie, self.extra, self.idle = tie, extra, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))])
        self.times = handle.getValueState("times", schema, ttlDurationMs=int(self.idle * 1000) if self.idle else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seconds_", self.tie]).reset_index(drop=True)
        kept = self.times.get() if self.times.exists() else None
        state = list(kept[0]) if kept is not None and kept[0] is not None else []
        out = []
        for now, more in zip(batch["seconds_"], batch[self.extra] if self.extra else [None] * len(batch)):
            values, state = self.step(float(now), more, state)
            out.append(values)
        self.times.update((state,))
        yield pd.concat([batch[self.columns], pd.DataFrame(out, columns=self.names)], axis=1)

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, keys: list[str], tie: str, extra: str | None, added, step, idle: float | None) -> DataFrame:
    timed = events.withColumn("seconds_", F.col("ts").cast("double"))   # names with a leading _ do not reach a processor
    schema = T.StructType([*events.schema.fields, *added])
    processor = _Steps(step, events.columns, [f.name for f in added], tie, extra, idle)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "processingTime" if idle else "none")


def rate_limit_stream(events: DataFrame, limit: int, window: float, keys: list[str], tie: str = "event_id",
                      idle_seconds: float | None = 7 * V.DAY_SECONDS) -> DataFrame:
    return _stateful(events, keys, tie, None, M.LIMIT_FIELDS, M.limit_step(limit, window), idle_seconds)


def strike_stream(removals: DataFrame, keys: list[str], tie: str = "event_id", undone: str | None = None,
                  idle_seconds: float | None = 7 * V.DAY_SECONDS) -> DataFrame:
    return _stateful(removals, keys, tie, undone, M.STRIKE_FIELDS, M.strike_step(), idle_seconds)


def notice_stream(events: DataFrame, keys: list[str], gap: float = V.NOTICE_GAP_SECONDS, tie: str = "event_id",
                  idle_seconds: float | None = 7 * V.DAY_SECONDS) -> DataFrame:
    return _stateful(events, keys, tie, None, M.NOTICE_FIELDS, M.notice_step(gap), idle_seconds)


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


REFUSED = [T.StructField("refused_by", T.StringType())]


def _behind(limit: int, window: float):
    """The second limit: rows that the first refused pass by and count for nothing."""
    step = M.limit_step(limit, window)

    def run(now: float, first, hits: list[float]):
        if first:   # the seconds to wait
            return (False, int(first), "visitor"), hits
        (admitted, wait), hits = step(now, None, hits)
        return (admitted, wait, None if admitted else "overall"), hits
    return run


def admission_stream(events: DataFrame, visitor: list[str], per_visitor: tuple[int, float], overall: tuple[int, float],
                     tie: str = "event_id", idle_seconds: float | None = 7 * V.DAY_SECONDS) -> DataFrame:
    """Two limits one behind the other: adds admitted, retry_after and refused_by, as `admission` does.

    What passes a visitor's limit reaches the one over everybody in the same micro-batch. That state is a list of at most
    the limit's times, and what reaches it is one task's work: as many rows as visitors are let through.
    """
    first = _stateful(events, visitor, tie, None, M.LIMIT_FIELDS, M.limit_step(*per_visitor), idle_seconds)
    paired = first.select(*events.columns, F.col("retry_after").alias("first_"), F.lit("*").alias("everybody_"))
    second = _stateful(paired, ["everybody_"], tie, "first_", [*M.LIMIT_FIELDS, *REFUSED], _behind(*overall), idle_seconds)
    return second.drop("first_", "everybody_")
