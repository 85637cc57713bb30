"""From a text to an action in one pass: score, file, crowd, decision, strikes, notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.operators import crowd, moderation
from wardlight.operators.verdict import apply_attachments, apply_crowd, score_messages
from wardlight.session import staged


def crowd_evidence(hits: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """(key, crowd_weight) of reported indicators and of reports of nearly the same message together.

    `hits` is (key, weight) per reported indicator, `similar` is (key, reporters) per message like reported ones.
    """
    alike = crowd.similar_hits(similar, key)
    return crowd.crowd_weights(hits.select(key, "weight").unionByName(alike.select(key, "weight")), key)


def actions(messages: DataFrame, files: DataFrame, hits: DataFrame, similar: DataFrame, settings: DataFrame, joins: DataFrame,
            admins: DataFrame, can_delete: Column, key: str = "msg_id") -> DataFrame:
    """Messages that call for an action, with the verdict's columns, action, reason and may_mute (the group's setting).

    `messages` may be a stream.
    """
    judged = apply_attachments(score_messages(messages), files, key)
    judged = apply_crowd(judged, crowd_evidence(hits, similar, key), key).withColumn("has_link", F.size("links") > 0)
    return moderation.moderate(judged, settings, joins, admins, can_delete).withColumnRenamed("mute", "may_mute")


def moderate_messages(messages: DataFrame, files: DataFrame, hits: DataFrame, similar: DataFrame, settings: DataFrame, joins: DataFrame,
                      admins: DataFrame, can_delete: Column, key: str = "msg_id", resets: bool = True,
                      gap: float = V.NOTICE_GAP_SECONDS) -> DataFrame:
    """Messages that call for an action: action, reason, strikes, mute and notify, with the verdict's columns.

    Messages are scored once; evidence from files (key, file_level, app_signals) and from the crowd can only raise the
    verdict. Harmless messages leave before joins, admins and earlier removals are looked at. Strikes count a sender's
    removals in a group over 24 hours; with `resets` the third one mutes, where the group wants it, and clears. A group is told about a removal
    if `gap` seconds passed since it was told last.
    """
    # The few rows that call for an action are read several times below, the texts behind them are scored once.
    acted = staged(actions(messages, files, hits, similar, settings, joins, admins, can_delete, key).drop("links", "counted", "intent"))
    removed, warned = acted.filter("action = 'delete'"), acted.filter("action <> 'delete'")
    if resets:
        removed = moderation.strikes_with_reset(removed, ["chat_id", "sender_id"], tie=key)
    else:
        removed = moderation.strikes(removed).withColumn("mute", F.col("strikes") >= V.STRIKES_TO_MUTE)
    counted = removed.unionByName(warned.withColumn("strikes", F.lit(0).cast("long")).withColumn("mute", F.lit(False)))
    counted = counted.withColumn("mute", F.col("mute") & F.col("may_mute")).drop("may_mute")
    return moderation.notice_throttle(counted, ["chat_id"], gap, tie=key)
