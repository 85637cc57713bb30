"""Text to action, and evaluation of real verdicts, over the documents as messages of groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.operators import crowd, evaluation, guard, verdict
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.aggregate_queries import _SETTINGS, _settings
from wardlight.plans.catalog import ORACLES, query
from wardlight.plans.message_queries import END, SALT, _INDICATORS
from wardlight.plans.stream_queries import FILES
from wardlight.session import shared_folder, staged
from wardlight.streaming import moderate, state

_EVIDENCE = [
    "c AS (SELECT kind, value, count(DISTINCT sender_id) AS n FROM indicators JOIN messages USING (msg_id) GROUP BY ALL HAVING n >= 2)",
    "ev AS (SELECT i.msg_id, CASE WHEN n >= 5 THEN 0.8 ELSE 0.5 END AS x FROM indicators i JOIN c ON i.kind = c.kind AND i.value = c.value "
    f"UNION ALL SELECT msg_id, {V.SIMILAR_WEIGHT} FROM messages WHERE msg_id % 11 = 0 AND msg_id % 5 >= {V.REPORT_THRESHOLD})",
    "w AS (SELECT msg_id, 1 - product(1 - x) AS w FROM ev GROUP BY msg_id)",
    "f AS (SELECT msg_id, ['dangerous', 'suspicious', 'safe'][msg_id % 3 + 1] AS file_level FROM messages WHERE msg_id % 7 = 0)",
    """j1 AS (SELECT v.msg_id, greatest(score, CASE file_level WHEN 'dangerous' THEN 0.95 WHEN 'suspicious' THEN 0.5 ELSE 0 END) AS score,
 CASE WHEN level = 'dangerous' OR file_level = 'dangerous' THEN 'dangerous' WHEN level = 'suspicious' OR file_level = 'suspicious' THEN 'suspicious' ELSE 'safe' END AS level,
 signals FROM verdicts v LEFT JOIN f USING (msg_id))""",
    "j2 AS (SELECT j1.*, coalesce(w, 0) AS w, 1 - (1 - score) * (1 - coalesce(w, 0)) AS s FROM j1 LEFT JOIN w USING (msg_id))",
    """j3 AS (SELECT msg_id, list_contains(signals, 'needs_context') AS asks, CASE WHEN w = 0 THEN level WHEN level = 'dangerous' OR s >= 0.65 THEN 'dangerous'
 WHEN level = 'suspicious' OR s >= 0.35 THEN 'suspicious' ELSE 'safe' END AS level FROM j2)""",
]
_ACTIONS = [
    "admins AS (SELECT s_nationkey AS chat_id, s_suppkey AS sender_id FROM supplier)",
    "jn AS (SELECT chat_id, sender_id, ts - INTERVAL 2 HOURS AS jt FROM messages WHERE msg_id % 6 = 0)",
    """r AS (SELECT m.msg_id, m.chat_id, m.sender_id, m.ts, level, asks, m.msg_id % 19 = 0 AS is_bot, m.msg_id % 23 = 0 AS auto_forward, m.msg_id % 17 = 0 AS is_channel,
 m.chat_id % 5 = 0 AS test, m.msg_id % 29 = 0 OR m.msg_id IN (SELECT msg_id FROM urls) AS carries, m.msg_id % 4 <> 0 AS can_delete,
 EXISTS (SELECT 1 FROM jn WHERE jn.chat_id = m.chat_id AND jn.sender_id = m.sender_id AND jt <= m.ts AND jt > m.ts - INTERVAL 24 HOURS) AS is_new,
 coalesce(s.mode, 'delete') AS mode, coalesce(s.strict, false) AS strict, coalesce(s.newcomers, true) AS newcomers
 FROM messages m JOIN j3 USING (msg_id) LEFT JOIN settings s ON s.chat_id = m.chat_id)""",
    "h AS (SELECT *, level = 'dangerous' OR (strict AND level = 'suspicious' AND NOT asks) AS harmful, newcomers AND NOT is_channel AND is_new AND (carries OR (level = 'suspicious' AND NOT asks)) AS hit FROM r)",
    """t AS (SELECT * FROM h WHERE ((mode <> 'off' AND harmful AND (mode = 'delete' OR level = 'dangerous')) OR hit) AND NOT auto_forward AND CASE WHEN is_channel THEN test OR NOT (sender_id = chat_id OR sender_id = 7)
 ELSE NOT is_bot AND (test OR (chat_id, sender_id) NOT IN (SELECT (chat_id, sender_id) FROM admins)) END)""",
    "a AS (SELECT *, CASE WHEN mode = 'off' OR NOT harmful THEN 'none' WHEN mode = 'delete' AND can_delete THEN 'delete' WHEN level = 'dangerous' THEN 'warn' ELSE 'none' END AS act FROM t)",
    "b AS (SELECT *, act = 'none' AND hit AND mode = 'delete' AND can_delete AS fresh FROM a)",
    "k AS (SELECT msg_id, chat_id, sender_id, ts, CASE WHEN fresh THEN 'delete' ELSE act END AS action, CASE WHEN fresh THEN 'newcomer' ELSE 'harmful' END AS reason FROM b)",
]


@query("moderate_messages", S.select([S.MESSAGES, S.verdict_ctes(), *[c for c in _INDICATORS if c not in (S.MESSAGES, S.urls_cte("messages"))], *_EVIDENCE, _SETTINGS, *_ACTIONS],
       """SELECT msg_id, action, reason, CASE WHEN action = 'delete' THEN count(*) FILTER (action = 'delete') OVER
 (PARTITION BY chat_id, sender_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) ELSE 0 END AS strikes FROM k"""))
def moderate_messages(spark, d):
    m, *tables = _moderation(spark, d)
    acted = guard.moderate_messages(_flags(m), *tables, F.col("msg_id") % 4 != 0, resets=False)
    return acted.select("msg_id", "action", "reason", "strikes")


def _flags(m):
    key = F.col("msg_id")
    return m.select("*", (key % 19 == 0).alias("is_bot"), (key % 23 == 0).alias("auto_forward"), (key % 17 == 0).alias("is_channel"),
                    F.lit(7).alias("linked_chat"), (F.col("chat_id") % 5 == 0).alias("test"), (key % 29 == 0).alias("from_chat"))


def _moderation(spark, d):
    """Messages, files, crowd hits, similar reports, settings, joins and admins."""
    m, key = D.messages(spark, d), F.col("msg_id")
    found = crowd.extract_indicators(m, "msg_id", "sender_id", "ts")
    counts = crowd.reporter_counts(crowd.report_rows(found, "sender_id", "ts", SALT), F.expr(f"TIMESTAMP '{END}'"))
    hits = crowd.crowd_hits(found, counts, SALT, "msg_id")
    similar = m.filter(key % 11 == 0).select("msg_id", (key % 5).alias("reporters"))
    files = m.filter(key % 7 == 0).select("msg_id", D.pick(["dangerous", "suspicious", "safe"], key).alias("file_level"),
                                          F.array().cast("array<string>").alias("app_signals"))
    joins = m.filter(key % 6 == 0).select("chat_id", "sender_id", (F.col("ts") - F.expr("INTERVAL 2 HOURS")).alias("ts"))
    admins = D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("chat_id"), F.col("s_suppkey").alias("sender_id"))
    return m, files, hits, similar, _settings(spark, d).drop("test"), joins, admins


def _dealt(m, path):
    """The messages in three parts of as many files each as a micro-batch takes, whatever the table's files, and the last row."""
    for part in range(3):
        m.filter(F.col("msg_id") % 3 == part).repartition(FILES).write.parquet(f"{path}/in/{part}")
    end = m.agg((F.max("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts")).select(
        F.lit(-1).cast("long").alias("msg_id"), F.lit(0).cast("long").alias("sender_id"), F.lit(0).cast("long").alias("chat_id"), "ts", F.lit("").alias("text"))
    end.write.parquet(f"{path}/in/end")
    return m.sparkSession.readStream.schema(m.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in/*")


@query("stream_moderate", ORACLES["moderate_messages"])
def stream_moderate(spark, d):
    """The messages as a stream of three micro-batches, none of them in order of time, and a last row that moves time on."""
    state.use_state_store(spark)
    m, *tables = _moderation(spark, d)
    path = f"{shared_folder(spark)}/moderate-{uuid.uuid4().hex}"
    tables[1:3] = [staged(tables[1]), staged(tables[2])]
    source = _dealt(m, path)
    out = moderate.moderate_stream(_flags(source), *tables, F.col("msg_id") % 4 != 0, resets=False, late="31 days")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("msg_id", "action", "reason", "strikes")


_JUDGED = ("oc AS (SELECT m.msg_id, ['scam', 'safe', 'needs_context'][m.msg_id % 3 + 1] AS label, v.kind AS intent, v.level, CASE m.msg_id % 3 WHEN 0 THEN CASE WHEN v.level <> 'safe' THEN 'ok' ELSE 'MISSED' END "
           "WHEN 1 THEN CASE WHEN v.level = 'safe' THEN 'ok' ELSE 'FALSE ALARM' END ELSE CASE WHEN v.level = 'suspicious' THEN 'ok' ELSE upper(v.level) || ' (want suspicious)' END END AS outcome, "
           "CASE WHEN m.msg_id % 3 = 0 THEN 'flag' ELSE 'safe' END AS expect FROM messages m JOIN verdicts v USING (msg_id))")


def _evaluated(spark, d):
    """Every message as a row of an evaluation set, with the level and intent that scoring gives it."""
    scored = verdict.score_messages(D.messages(spark, d))
    rows = scored.select("msg_id", D.pick(["scam", "safe", "needs_context"], F.col("msg_id")).alias("label"), F.col("intent.kind").alias("intent"), "level",
                         F.when(F.col("msg_id") % 3 == 0, "flag").otherwise("safe").alias("expect"), F.array().cast("array<string>").alias("reasons"))
    return rows.withColumn("outcome", evaluation.outcome(F.col("label"), F.col("level")))


@query("evaluate_verdicts", S.select([S.MESSAGES, S.verdict_ctes(), _JUDGED], """SELECT count(*) FILTER (label = 'scam' AND outcome = 'ok') AS scams_caught, count(*) FILTER (label = 'scam') AS scams,
 count(*) FILTER (label = 'safe' AND outcome <> 'ok') AS false_alarms, count(*) FILTER (label = 'safe') AS safe, count(*) FILTER (label = 'needs_context' AND outcome = 'ok') AS context_ok,
 count(*) FILTER (label = 'needs_context') AS context FROM oc"""))
def evaluate_verdicts(spark, d):
    return evaluation.headline_metrics(_evaluated(spark, d))


@query("evaluate_by_intent", S.select([S.MESSAGES, S.verdict_ctes(), _JUDGED], "SELECT intent, count(*) FILTER (outcome = 'ok') AS ok, count(*) AS n FROM oc GROUP BY intent"))
def evaluate_by_intent(spark, d):
    return evaluation.by_intent(_evaluated(spark, d))


@query("golden_verdicts", S.select([S.MESSAGES, S.verdict_ctes(), _JUDGED], "SELECT msg_id, level FROM oc WHERE (expect = 'safe') = (level <> 'safe')"))
def golden_verdicts(spark, d):
    return evaluation.golden_violations(_evaluated(spark, d)).select("msg_id", "level")
