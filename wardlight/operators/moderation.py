"""Moderation decisions over events: what to do with a message, strikes, rate limits, newcomers, logs.

Decisions that depend on earlier decisions (a limit counts only admitted events, a mute clears the strikes)
are sequential per key. `in_bursts` cuts each key's time line wherever it was silent longer than the window:
no decision can reach over such a gap, so the pieces are independent. A task streams its sorted rows with a
state of at most `limit` times; no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight import values as V
from wardlight.functions.ranks import numbered_in_order
from wardlight.functions.text import content_fingerprint, defang_text, mask_for_dataset
from wardlight.operators.crowd import within_days


# ---------------------------------------------------------------- decisions
def decide(level: Column, signals: Column, mode: Column, strict: Column, can_delete: Column) -> Column:
    """none, warn or delete for a message from an ordinary member."""
    asks = F.array_contains(signals, "needs_context")
    harmful = (level == "dangerous") | (strict & (level == "suspicious") & ~asks)
    return (F.when((mode == "off") | ~harmful, "none").when((mode == "delete") & can_delete, "delete")
            .when(level == "dangerous", "warn").otherwise("none"))


def with_settings(messages: DataFrame, settings: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Adds the group's settings; groups that never chose get the defaults."""
    joined = messages.join(settings, chat, "left")
    for name, default in V.GROUP_DEFAULTS.items():
        if name in settings.columns:
            joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
        elif name not in messages.columns:
            joined = joined.withColumn(name, F.lit(default))
    return joined


def breaks_newcomer_rule(level: Column, signals: Column, has_link: Column, from_chat: Column) -> Column:
    return has_link | from_chat | ((level == "suspicious") & ~F.array_contains(signals, "needs_context"))


def _first_day(joins: DataFrame, chat: str, sender: str, ts: str) -> DataFrame:
    """(chat, sender, day): first join that day and last join the day before."""
    at = F.col(ts).cast("timestamp")
    daily = joins.groupBy(chat, sender, F.to_date(at).alias("_day")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    none = F.lit(None).cast("timestamp")
    placed = daily.select(chat, sender, F.explode(F.array(
        F.struct(F.col("_day").alias("day"), F.col("_first").alias("today"), none.alias("before")),
        F.struct(F.date_add("_day", 1).alias("day"), none.alias("today"), F.col("_last").alias("before")),
    )).alias("p"))
    return placed.groupBy(chat, sender, F.col("p.day").alias("_day")).agg(
        F.max("p.today").alias("_joined_today"), F.max("p.before").alias("_joined_before"))


def flag_newcomers(messages: DataFrame, joins: DataFrame, chat: str = "chat_id", sender: str = "sender_id",
                   ts: str = "ts") -> DataFrame:
    """Adds is_newcomer: the sender joined this group less than 24 hours before the message.

    A join on day d can only matter on days d and d+1, so joins shrink to one row per (group, person, day)
    and each message meets at most one of them: no range join, no pairs, and even one group holding a third
    of all messages is spread over people and days.
    """
    at = F.col(ts).cast("timestamp")
    known = _first_day(joins, chat, sender, ts)
    day_ago = at - F.expr(f"INTERVAL {V.DAY_SECONDS} SECONDS")
    flagged = messages.withColumn("_day", F.to_date(at)).join(known, [chat, sender, "_day"], "left")
    newcomer = (F.col("_joined_today") <= at) | (F.col("_joined_before") > day_ago)
    return flagged.withColumn("is_newcomer", F.coalesce(newcomer, F.lit(False))).drop("_day", "_joined_today", "_joined_before")


def newcomer_violations(messages: DataFrame, joins: DataFrame, chat: str = "chat_id", sender: str = "sender_id",
                        ts: str = "ts") -> DataFrame:
    """Messages (level, signals, has_link, from_chat) that break the first-day rule."""
    broken = messages.filter(breaks_newcomer_rule(F.col("level"), F.col("signals"), F.col("has_link"), F.col("from_chat")))
    return flag_newcomers(broken, joins, chat, sender, ts).filter("is_newcomer").drop("is_newcomer")


def drop_exempt(messages: DataFrame, admins: DataFrame) -> DataFrame:
    """Without admins, bots, channel copies and the group's own channel; test mode keeps admins and the channel.

    Needs chat_id, sender_id, is_bot, auto_forward, is_channel, linked_chat and test; admins is (chat_id, sender_id).
    """
    own_channel = F.col("is_channel") & ((F.col("sender_id") == F.col("chat_id"))
                                         | F.coalesce(F.col("sender_id") == F.col("linked_chat"), F.lit(False)))
    kept = messages.filter(~F.col("auto_forward") & F.when(F.col("is_channel"), F.col("test") | ~own_channel)
                           .otherwise(F.col("sender_id").isNotNull() & ~F.col("is_bot")))
    ordinary = (F.col("m.chat_id") == F.col("a.chat_id")) & (F.col("m.sender_id") == F.col("a.sender_id")) & ~F.col(
        "m.test") & ~F.col("m.is_channel")
    return kept.alias("m").join(admins.select("chat_id", "sender_id").distinct().alias("a"), ordinary, "left_anti")


# ---------------------------------------------------------------- strikes, limits, notices
def strikes(removals: DataFrame, chat: str = "chat_id", sender: str = "sender_id", ts: str = "ts") -> DataFrame:
    """Adds strikes: removals of this sender in this group in the trailing 24 hours (bound inclusive), no resets.

    The time line is cut into days; every removal also stands in the next day as history, so a window
    never sorts more than two days of one sender.
    """
    at = F.col(ts).cast("timestamp").cast("double")
    day = F.floor(at / V.DAY_SECONDS)
    placed = removals.withColumn("_t", at).withColumn("_slot", F.explode(F.array(
        F.struct(day.alias("day"), F.lit(True).alias("own")), F.struct((day + 1).alias("day"), F.lit(False).alias("own")))))
    w = Window.partitionBy(chat, sender, "_slot.day").orderBy("_t").rangeBetween(-V.DAY_SECONDS, 0)
    counted = placed.withColumn("strikes", F.count("*").over(w)).filter("_slot.own")
    return counted.drop("_t", "_slot")


def in_bursts(events: DataFrame, keys: list[str], ts: str, gap: float) -> DataFrame:
    """Adds _t (seconds) and _burst: the start of the run of events no more than `gap` seconds apart."""
    slot_len = max(float(gap), 3600.0)
    line = events.withColumn("_t", F.col(ts).cast("timestamp").cast("double")).withColumn(
        "_slot", F.floor(F.col("_t") / slot_len))
    # The last event of a slot is carried into the next one, so gaps are seen across slot borders too.
    carried = line.groupBy(*keys, "_slot").agg(F.max("_t").alias("_t")).withColumn("_slot", F.col("_slot") + 1).withColumn(
        "_carried", F.lit(True))
    w = Window.partitionBy(*keys, "_slot").orderBy("_t")
    gaps = line.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True).withColumn(
        "_before", F.lag("_t").over(w))
    opens = ~F.col("_carried") & (F.col("_before").isNull() | (F.col("_t") - F.col("_before") > gap))
    marked = gaps.withColumn("_open", F.when(opens, F.col("_t"))).withColumn(
        "_start", F.last("_open", ignorenulls=True).over(w)).filter("NOT _carried")
    # Runs that began in an earlier slot: one row per key and slot, so this line is short.
    per_slot = marked.groupBy(*keys, "_slot").agg(F.max("_open").alias("_last_open"))
    earlier = per_slot.withColumn("_inherited", F.last("_last_open", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).drop("_last_open")
    joined = marked.join(earlier, [*keys, "_slot"], "left")
    return joined.withColumn("_burst", F.coalesce("_start", "_inherited")).drop(
        "_slot", "_carried", "_before", "_open", "_start", "_inherited")


def _sequential(events: DataFrame, keys: list[str], ts: str, gap: float, tie: str, extra: str | None,
                added: list[T.StructField], step) -> DataFrame:
    """Runs `step` over each burst in time order, streaming over sorted rows."""
    schema = T.StructType([*events.schema.fields, *added])
    # A key may be null, which pandas turns into a value that differs from itself: rows are grouped by a text of their keys.
    events = events.withColumn("_key", F.to_json(F.struct(*keys)))
    keys = ["_key"]
    names, wanted = [f.name for f in added], [c for c in events.columns if c != "_key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for batch in batches:
            out = []
            groups = zip(*[batch[k] for k in keys], batch["_burst"])
            for group, now, more in zip(groups, batch["_t"], batch[extra] if extra else [None] * len(batch)):
                if group != current:
                    current, state = group, []
                values, state = step(now, more, state)
                out.append(values)
            yield pd.concat([batch[wanted], pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    bursts = in_bursts(events, keys, ts, gap)
    return bursts.repartition(*keys, "_burst").sortWithinPartitions(*keys, "_burst", "_t", tie).mapInPandas(run, schema)


# Steps: (time, extra, state) -> (output values, state). A state is a short list of times, so the same steps run
# over sorted batches here and inside a state store in `wardlight.streaming`.
def limit_step(limit: int, window: float):
    def step(now: float, _, hits: list[float]):
        hits = [h for h in hits if now - h <= window]
        if len(hits) >= limit:
            return (False, max(1, int(window - (now - hits[0])) + 1)), hits
        return (True, 0), [*hits, now]
    return step


def strike_step(to_mute: int = V.STRIKES_TO_MUTE, window: float = V.DAY_SECONDS):
    def step(now: float, undone: bool, hits: list[float]):
        if undone:
            return (0, False), []
        hits = [h for h in hits if now - h <= window] + [now]
        return ((len(hits), True), []) if len(hits) >= to_mute else ((len(hits), False), hits)
    return step


def notice_step(gap: float, strict: bool = False):
    def step(now: float, _, last: list[float]):
        ready = not last or (now - last[0] > gap if strict else now - last[0] >= gap)
        return (ready,), ([now] if ready else last)
    return step


LIMIT_FIELDS = [T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType())]
STRIKE_FIELDS = [T.StructField("strikes", T.LongType()), T.StructField("mute", T.BooleanType())]
NOTICE_FIELDS = [T.StructField("notify", T.BooleanType())]


def rate_limited(events: DataFrame, limit: int, window: float, keys: list[str], ts: str = "ts",
                 tie: str = "event_id") -> DataFrame:
    """Adds admitted and retry_after. Only admitted events count towards the limit."""
    return _sequential(events, keys, ts, window, tie, None, LIMIT_FIELDS, limit_step(limit, window))


def strikes_with_reset(removals: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id",
                       undone: str | None = None) -> DataFrame:
    """Adds strikes and mute: the third strike in 24 hours mutes and clears; an undo clears too.

    `undone` names a boolean column that marks undo events among the removals.
    """
    return _sequential(removals, keys, ts, V.DAY_SECONDS, tie, undone, STRIKE_FIELDS, strike_step())


def notice_throttle(events: DataFrame, keys: list[str], gap: float = V.NOTICE_GAP_SECONDS, ts: str = "ts",
                    tie: str = "event_id", strict: bool = False) -> DataFrame:
    """Adds notify: true when at least `gap` seconds passed since the last notice (more than, if strict)."""
    return _sequential(events, keys, ts, gap, tie, None, NOTICE_FIELDS, notice_step(gap, strict))


# ---------------------------------------------------------------- group reports
def group_removal_counts(removals: DataFrame, chat: str = "chat_id") -> DataFrame:
    return removals.groupBy(chat).agg(F.count("*").alias("deleted"))


def managed_groups(managers: DataFrame, groups: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Every managed group with its title and removals so far; groups without settings show zeros."""
    joined = managers.join(groups, chat, "left")
    return joined.withColumn("title", F.coalesce("title", F.lit(""))).withColumn(
        "deleted", F.coalesce("deleted", F.lit(0)))


def removal_log(removals: DataFrame, as_of: Column, chat: str = "chat_id", order: str = "event_id",
                rows: int | None = None, reason_chars: int | None = None) -> DataFrame:
    """The removals of each group within 30 days, newest first: all, numbered over ranges, or the newest `rows`."""
    recent = within_days(removals, as_of, V.LOG_DAYS)
    newest = [F.desc("ts"), F.desc(order)]
    if rows is None:
        ranked = numbered_in_order(recent, [chat], newest)
    else:   # cut before the shuffle
        ranked = recent.withColumn("rank", F.row_number().over(Window.partitionBy(chat).orderBy(*newest))).filter(F.col("rank") <= rows)
    reason = defang_text(F.col("reason"))
    return ranked.withColumn("reason", reason if reason_chars is None else F.left(reason, F.lit(reason_chars)))


def training_candidates(removals: DataFrame) -> DataFrame:
    """Masked copies of removed messages from groups that opted in, one per content key, with repeats counted."""
    masked = removals.filter(F.col("train") & (F.col("level") != "safe")).select(
        mask_for_dataset(F.col("text")).alias("text"), F.col("level").alias("verdict"), "ts").filter(F.length("text") >= V.MIN_CONTENT_CHARS)
    keyed = masked.withColumn("fp", content_fingerprint(F.col("text")))
    first = F.struct("ts", "text", "verdict")
    folded = keyed.groupBy("fp").agg(F.min(first).alias("first"), F.max("ts").alias("last"), F.count("*").alias("hits"))
    return folded.select(
        "fp", "first.text", "first.verdict", F.lit("group").alias("source"),
        F.to_date("first.ts").alias("first_seen"), F.to_date("last").alias("last_seen"), "hits")


def undo_feedback(undone: DataFrame) -> DataFrame:
    """A removal an admin undid is a false alarm worth learning from."""
    return undone.select(mask_for_dataset(F.col("text")).alias("text"), F.lit(0).alias("label"),
                         F.col("level").alias("predicted"), F.lit(False).alias("user_agreed"), "ts")


def counted_once(messages: DataFrame) -> DataFrame:
    """The branch that feeds counters: edits are moderated again but not counted again."""
    return messages.filter(~F.col("edited"))


def moderate(verdicts: DataFrame, settings: DataFrame, joins: DataFrame, admins: DataFrame,
             can_delete: Column) -> DataFrame:
    """Scored messages to actions. Harmless messages leave before anything is looked up about joins or admins."""
    rows = with_settings(verdicts, settings)
    may_break = F.col("newcomers") & ~F.col("is_channel") & breaks_newcomer_rule(
        F.col("level"), F.col("signals"), F.col("has_link"), F.col("from_chat"))
    wanted = decide(F.col("level"), F.col("signals"), F.col("mode"), F.col("strict"), F.lit(True)) != "none"
    suspects = rows.withColumn("_may_break", F.coalesce(may_break, F.lit(False))).withColumn("_wanted", wanted).filter("_wanted OR _may_break")
    flagged = flag_newcomers(suspects, joins).withColumn("newcomer_hit", F.col("_may_break") & F.col("is_newcomer"))
    todo = drop_exempt(flagged.filter("_wanted OR newcomer_hit").drop("_may_break", "_wanted"), admins)
    action = decide(F.col("level"), F.col("signals"), F.col("mode"), F.col("strict"), can_delete)
    for_newcomer = (action == "none") & F.col("newcomer_hit") & (F.col("mode") == "delete") & can_delete
    return todo.withColumn("action", F.when(for_newcomer, "delete").otherwise(action)).withColumn(
        "reason", F.when(for_newcomer, "newcomer").otherwise("harmful"))
