"""Streams that count different people: flagged domains with their people, and reporters of the last ninety days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight import values as V
from wardlight.operators import radar


class _DomainTotals(StatefulProcessor):
    """Of a domain: its totals after each micro-batch that touched it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "first int, last int, hits long, confirmed boolean, people long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, hits, confirmed, people = None, None, 0, False, 0
        for batch in rows:   # a domain that everybody meets is never held whole
            days = batch["day_"].dropna()
            if len(days):
                first, last = (int(days.min()), int(days.max())) if first is None else (min(first, int(days.min())), max(last, int(days.max())))
            hits, people = hits + int(batch["hits"].sum()), people + int(batch["people"].sum())
            confirmed = confirmed or bool(batch["confirmed"].fillna(False).any())
        if self.totals.exists():
            f, l, h, c, p = self.totals.get()
            first, last, hits, confirmed, people = min(first, f), max(last, l), hits + h, confirmed or c, people + p
        self.totals.update((first, last, hits, confirmed, people))
        yield pd.DataFrame({"domain": [key[0]], "first": [first], "last": [last], "hits": [hits], "confirmed": [confirmed], "people": [people]})

    def close(self) -> None:
        pass


_TOTALS = "domain string, first int, last int, hits long, confirmed boolean, people long"


def flagged_people_stream(checks: DataFrame) -> DataFrame:
    """A stream of checks to the totals of each domain that a micro-batch changed: domain, first_seen, last_seen, hits, confirmed, people.

    People are told apart exactly by Spark's own state of distinct (domain, person), which spreads a domain that everybody
    meets and calls no Python. The totals behind it are called once for a domain and micro-batch; its rows stream through.
    The totals of a domain with most hits are its newest: see `newest_totals`.
    """
    seen = radar.domain_sightings(checks).select("domain", "person", "confirmed", F.datediff("day", F.lit("1970-01-01")).alias("day_"))
    rows = seen.select("domain", "day_", "confirmed", F.lit(1).alias("hits"), F.lit(0).alias("people"))
    persons = seen.filter("person IS NOT NULL").dropDuplicates(["domain", "person"]).select(
        "domain", F.lit(None).cast("int").alias("day_"), F.lit(False).alias("confirmed"), F.lit(0).alias("hits"), F.lit(1).alias("people"))
    totals = rows.union(persons).groupBy("domain").transformWithStateInPandas(_DomainTotals(), _TOTALS, "append", "none")
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return totals.select("domain", day("first").alias("first_seen"), day("last").alias("last_seen"), "hits", "confirmed", "people")


def newest_totals(written: DataFrame) -> DataFrame:
    """The newest totals of each domain among all that the stream has written."""
    return written.groupBy("domain").agg(F.max_by(F.struct("first_seen", "last_seen", "confirmed", "people"), "hits").alias("v"), F.max("hits").alias("hits")).select(
        "domain", "v.first_seen", "v.last_seen", "hits", "v.confirmed", "v.people")


def feed_of(totals: DataFrame, min_people: int = V.FEED_MIN_PEOPLE, limit: int | None = None) -> DataFrame:
    """Domains one may publish, from totals with people; as `feed_domains`."""
    listed = totals.filter(F.col("confirmed") | (F.col("people") >= min_people))
    return radar.newest(listed.select("domain", "first_seen", "last_seen", "hits"), ["hits", "domain"], limit)


class _Reporting(StatefulProcessor):
    """Of the (indicator, reporter) of a slot: when the reporter begins to count and when it is forgotten.

    Times wait until the watermark has passed them. A timer stands at the first time that waits or period that ends; when it
    fires, what is due is settled for the whole slot at once, and of reporters that were taken back nothing is kept.
    """

    def __init__(self, window: int):
        self.window = window   # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ind array<string>, reporter array<string>, at array<long>")
        self.until = handle.getValueState("until", "ind array<string>, reporter array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            times = batch["at_"].astype("int64").tolist()
            self.waiting.appendValue((batch["ind"].tolist(), batch["reporter"].tolist(), times))
            first = min(times) if first is None else min(first, min(times))
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        chunks = list(self.waiting.get()) if self.waiting.exists() else []
        kept = self.until.get() if self.until.exists() else ((), (), ())
        until = {(i, r): t for i, r, t in zip(*kept)}
        rows = [row for chunk in chunks for row in zip(*chunk)]
        later = [row for row in rows if row[2] >= now]
        changes = []
        for i, r, t in sorted((row for row in rows if row[2] < now), key=lambda row: row[2]):
            end = until.get((i, r))
            if end is not None and t > end:
                changes.append((i, end, -1))
                end = None
            if end is None:
                changes.append((i, t, 1))
            until[i, r] = max(end or 0, t + self.window)
        changes += [(i, t, -1) for (i, _), t in until.items() if t < now]
        left = [(i, r, t) for (i, r), t in until.items() if t >= now]
        for state, held in ((self.until, left), (self.waiting, later)):
            if not held:
                state.clear()
            elif state is self.until:
                state.update(tuple(list(c) for c in zip(*held)))
            elif len(later) < len(rows):
                state.put([tuple(list(c) for c in zip(*held))])
        if left or later:
            self.handle.registerTimer(min(t for _, _, t in left + later) // 1000 + 1)
        if changes:
            ind, at, change = zip(*changes, strict=True)
            yield pd.DataFrame({"ind": ind, "at": at, "change": change})

    def close(self) -> None:
        pass


#: Keys of the state. A micro-batch calls Python for each at most once or twice, however many reporters there are.
SLOTS = 2048


def reporter_changes(reports: DataFrame, days: int = V.REPORT_DAYS, late: str = "1 day", slots: int = SLOTS) -> DataFrame:
    """A stream of reports (ind, reporter, ts) to changes (ind, at, change): a reporter that counts from then on, or no longer
    after then. Out of date reporters are taken back by timers, so the state holds those of the last `days` alone.

    A key of the state is a slot of (ind, reporter) by hash, so an indicator that everybody reports is spread over all slots.
    """
    slot = F.pmod(F.xxhash64("ind", "reporter"), F.lit(slots)).cast("int")
    rows = reports.filter("ind IS NOT NULL AND reporter IS NOT NULL").withWatermark("ts", late).select(slot.alias("slot"), "ind", "reporter", "ts", F.unix_micros("ts").alias("at_"))
    changed = rows.groupBy("slot").transformWithStateInPandas(_Reporting(days * V.DAY_SECONDS * 1_000_000), "ind string, at long, change int", "append", "EventTime")
    return changed.select("ind", F.timestamp_micros("at").alias("at"), "change")


def counts_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """(ind, reporters) at a time that the stream has passed, from the changes it has written."""
    counts = F.when(F.col("change") > 0, F.col("at") <= as_of).otherwise(F.col("at") < as_of)
    return changes.filter(counts).groupBy("ind").agg(F.sum("change").cast("long").alias("reporters")).filter("reporters > 0")
