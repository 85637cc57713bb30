"""Moderation as one stream: score, evidence, decision, strikes, notice.

Scoring and decisions are row expressions and joins with tables, as in batch. Strikes and notices are two chained stateful
operators. Each holds its rows until the watermark has passed them and then takes them in the order of their times, so what
comes out does not depend on how rows were dealt into micro-batches; the second one's watermark is that of the first's output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight import values as V
from wardlight.operators import guard
from wardlight.operators import moderation as M

_ROW = T.StructType([T.StructField("row", T.StringType())])
_TIMES = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))])


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (ts, tie), each through a step, once the watermark has passed them.

    The state of a key is the rows that wait and the step's times; it is dropped when both are older than `keep` seconds.
    """

    def __init__(self, step, columns: list[str], names: list[str], tie: str, extra: str | None, keep: float):
        self.step, self.columns, self.names, self.tie, self.extra, self.keep = step, columns, names, tie, extra, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.times = handle.getListState("waiting", _ROW), handle.getValueState("times", _TIMES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, first = [], None
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            first = int(at.min()) if first is None else min(first, int(at.min()))
            plain = batch[self.columns].drop(columns="ts").astype(object).where(batch[self.columns].drop(columns="ts").notna(), None)
            held += [(json.dumps([t, *values], default=_plain),) for t, values in zip(at.tolist(), plain.itertuples(index=False, name=None))]
        self.waiting.appendList(held)
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, names = timerValues.getCurrentWatermarkInMs(), ["ts", *[c for c in self.columns if c != "ts"]]
        rows = [json.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        tie, extra = names.index(self.tie), names.index(self.extra) if self.extra else 0
        ready = sorted((r for r in rows if r[0] < 1000 * now), key=lambda r: (r[0], r[tie]))
        later = [r for r in rows if r[0] >= 1000 * now]
        kept = self.times.get() if self.times.exists() else None
        state, added = list(kept[0]) if kept is not None and kept[0] is not None else [], []
        for r in ready:
            values, state = self.step(r[0] / 1e6, r[extra], state)
            added.append(values)
        if ready:
            self.times.update((state,))
            self.handle.registerTimer(ready[-1][0] // 1000 + int(1000 * self.keep) + 1)
        elif not later and (not state or now > 1000 * (state[-1] + self.keep)):
            self.times.clear()
        if later:
            self.waiting.put([(json.dumps(r),) for r in later])
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            out = pd.DataFrame(ready, columns=names)
            out["ts"] = pd.to_datetime(out["ts"], unit="us")
            yield pd.concat([out[self.columns], pd.DataFrame(added, columns=self.names)], axis=1)

    def close(self) -> None:
        pass


def _plain(value):
    return value.item()   # a number of numpy


def in_order(rows: DataFrame, keys: list[str], step, added: list[T.StructField], tie: str, extra: str | None, keep: float) -> DataFrame:
    """`rows` (with a watermark on ts, columns of plain types) with what the step adds to each."""
    processor = InOrder(step, rows.columns, [f.name for f in added], tie, extra, keep)
    schema = T.StructType([*rows.schema.fields, *added])
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime", eventTimeColumnName="ts")


def removal_step(resets: bool, window: float = V.DAY_SECONDS):
    """Strikes of removals; warnings pass by. With resets the third strike mutes and clears."""
    clearing = M.strike_step(V.STRIKES_TO_MUTE, window)

    def step(now: float, action: str, hits: list[float]):
        if action != "delete":
            return (0, False), hits
        if resets:
            return clearing(now, False, hits)
        hits = [h for h in hits if now - h <= window] + [now]
        return (len(hits), len(hits) >= V.STRIKES_TO_MUTE), hits
    return step


def moderate_stream(messages: DataFrame, files: DataFrame, hits: DataFrame, similar: DataFrame, settings: DataFrame, joins: DataFrame,
                    admins: DataFrame, can_delete: Column, key: str = "msg_id", resets: bool = True, gap: float = V.NOTICE_GAP_SECONDS,
                    late: str = "1 day") -> DataFrame:
    """A stream of messages to actions: key, chat_id, sender_id, ts, action, reason, strikes, mute, notify.

    Equals `moderate_messages` on the same rows, however they are dealt into micro-batches, as long as none is later than
    `late`. The other tables are read as they stand when a micro-batch begins. Rows come out once the watermark has passed
    them. Messages without a time never do.
    """
    acted = guard.actions(messages.withWatermark("ts", late), files, hits, similar, settings, joins, admins, can_delete, key)
    slim = acted.select(key, "chat_id", "sender_id", "ts", "action", "reason", "may_mute")
    struck = in_order(slim, ["chat_id", "sender_id"], removal_step(resets), M.STRIKE_FIELDS, key, "action", V.DAY_SECONDS)
    struck = struck.withColumn("mute", F.col("mute") & F.col("may_mute")).drop("may_mute")
    return in_order(struck, ["chat_id"], M.notice_step(gap), M.NOTICE_FIELDS, key, None, gap)
