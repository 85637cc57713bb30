"""Queries over facts: public numbers, feeds, moderation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.text import mask_for_dataset
from wardlight.operators import admission, crowd, moderation, radar
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.catalog import ORACLES, query
from wardlight.plans.message_queries import COMMUNITY, END
from wardlight.sources import sinks

TODAY = "2024-01-30"
_LV = "CASE WHEN list_contains(signals, 'needs_context') THEN 'safe' ELSE level END"
_DAILY = (f"daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS checks, count(*) FILTER (lv = 'safe') AS safe, count(*) FILTER (lv = 'suspicious') AS suspicious, "
          f"count(*) FILTER (lv = 'dangerous') AS dangerous FROM (SELECT *, {_LV} AS lv FROM checks) GROUP BY 1)")
_CASE = "CASE " + " ".join(f"WHEN list_has_any(signals, {S.array(names)}) THEN '{c}'" for c, names in V.CATEGORIES) + " ELSE 'other' END"
_CATS = f"cats AS (SELECT CAST(ts AS DATE) AS day, {_CASE} AS category, count(*) AS n FROM checks WHERE level <> 'safe' AND NOT list_contains(signals, 'needs_context') GROUP BY ALL)"
_FLAGGED = ("seen AS (SELECT domain, CAST(ts AS DATE) AS day, person, confirmed FROM checks WHERE level <> 'safe' AND NOT list_contains(signals, 'needs_context') AND channel <> 'web'), "
            "flagged AS (SELECT domain, min(day) AS first_seen, max(day) AS last_seen, count(*) AS hits, bool_or(confirmed) AS confirmed, count(DISTINCT person) AS people FROM seen GROUP BY domain)")


def _today():
    return F.to_date(F.lit(TODAY))


def _end():
    return F.expr(f"TIMESTAMP '{END}'")


def _seen(spark, d):
    return radar.domain_sightings(D.checks(spark, d))


@query("daily_counts", S.select([S.CHECKS, _DAILY], "SELECT * FROM daily"))
def daily_counts(spark, d):
    return radar.daily_counts(D.checks(spark, d))


@query("daily_categories", S.select([S.CHECKS, _CATS], "SELECT * FROM cats"))
def daily_categories(spark, d):
    return radar.daily_categories(D.checks(spark, d))


@query("primary_category", S.select(S.CHECKS, f"SELECT event_id, {_CASE} AS category FROM checks"))
def primary_category(spark, d):
    return D.checks(spark, d).select("event_id", radar.primary_category(F.col("signals")).alias("category"))


@query("flagged_domains", S.select([S.CHECKS, _FLAGGED], "SELECT domain, first_seen, last_seen, hits, confirmed FROM flagged"))
def flagged_domains(spark, d):
    return radar.flagged_domains(_seen(spark, d))


@query("domain_people", S.select([S.CHECKS, _FLAGGED], "SELECT domain, people FROM flagged"))
def domain_people(spark, d):
    return radar.domain_people(_seen(spark, d))


_FEED = f"feed AS (SELECT domain, first_seen, last_seen, hits FROM flagged d WHERE confirmed OR (SELECT count(DISTINCT person) FROM seen s WHERE s.domain = d.domain) >= 3)"


@query("feed_domains", S.select([S.CHECKS, _FLAGGED, _FEED], "SELECT * FROM feed"))
def feed_domains(spark, d):
    return radar.feed_domains(_seen(spark, d))


@query("recent_domains", S.select([S.CHECKS, _FLAGGED], "SELECT domain, first_seen, last_seen, hits FROM flagged"))
def recent_domains(spark, d):
    return radar.recent_domains(radar.flagged_domains(_seen(spark, d)))


@query("daily_series", S.select([S.CHECKS, _DAILY, "cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-06', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day)"],
       "SELECT day, coalesce(checks, 0) AS checks, coalesce(suspicious + dangerous, 0) AS scams FROM cal LEFT JOIN daily USING (day)"))
def daily_series(spark, d):
    return radar.daily_series(radar.daily_counts(D.checks(spark, d)), F.to_date(F.lit("2024-02-04")))


@query("category_counts", S.select([S.CHECKS, _CATS], "SELECT category, sum(n)::BIGINT AS n FROM cats WHERE day >= DATE '2024-01-10' GROUP BY category"))
def category_counts(spark, d):
    return radar.category_counts(radar.daily_categories(D.checks(spark, d)), F.to_date(F.lit("2024-01-10")))


@query("radar_totals", S.select([S.CHECKS, _DAILY], f"SELECT min(day) AS first_day, sum(checks)::BIGINT AS checks, sum(suspicious)::BIGINT AS suspicious, sum(dangerous)::BIGINT AS dangerous, "
       f"sum(CASE WHEN day = DATE '{TODAY}' THEN checks ELSE 0 END)::BIGINT AS today, (SELECT count(DISTINCT person) FROM checks) AS users FROM daily"))
def radar_totals(spark, d):
    checks = D.checks(spark, d)
    return radar.totals(radar.daily_counts(checks), checks, _today())


def _gated(spark, d, minimum):
    blocked = crowd.blocked_count(crowd.reporter_counts(D.reports(spark, d), _end()))
    return radar.gate_totals(radar_totals(spark, d), blocked, minimum)


@query("gate_totals", S.select([S.CHECKS, _DAILY, S.REPORTS.replace(S.EVENTS + ", ", ""), "b AS (SELECT count(*) AS n FROM (SELECT ind FROM reports GROUP BY ind HAVING count(DISTINCT reporter) >= 2))"],
       "SELECT min(day) AS first_day, CASE WHEN sum(checks) >= 100 THEN sum(checks) END::BIGINT AS checks, CASE WHEN sum(checks) >= 100 THEN sum(suspicious + dangerous) END::BIGINT AS scams, "
       "CASE WHEN sum(checks) >= 100 THEN any_value(b.n) END AS blocked FROM daily, b"))
def gate_totals(spark, d):
    return _gated(spark, d, V.SHOW_TOTALS_FROM).select("first_day", "totals.checks", "totals.scams", "totals.blocked")


_MERGED = f"""auto AS (SELECT domain AS indicator, first_seen, last_seen, hits FROM feed WHERE NOT {S.never_listed('domain')}),
com0 AS (SELECT {S.without_www('lower(preview)')} AS indicator, first_day, reporters, last_ts FROM community),
com AS (SELECT indicator, min(first_day) AS first_day, min_by(reporters, last_ts) AS reporters, max_by(first_day, last_ts) AS newest FROM com0
  WHERE NOT {S.never_listed("split_part(indicator, '/', 1)")} GROUP BY indicator)"""
_THREATS = [S.CHECKS, _FLAGGED, _FEED, S.REPORTS.replace(S.EVENTS + ", ", ""), COMMUNITY, _MERGED,
            f"""threats AS (SELECT coalesce(a.indicator, c.indicator) AS indicator, CASE WHEN contains(coalesce(a.indicator, c.indicator), '/') THEN 'url' ELSE 'domain' END AS type,
 least(coalesce(first_seen, first_day), coalesce(first_day, first_seen)) AS first_seen, coalesce(last_seen, newest) AS last_seen, coalesce(hits, 0) AS detections, coalesce(reporters, 0) AS reporters,
 CASE WHEN a.indicator IS NULL THEN 'community' WHEN c.indicator IS NULL THEN 'auto' ELSE 'both' END AS source FROM auto a FULL JOIN com c ON a.indicator = c.indicator
)"""]


@query("threat_feed", S.select(_THREATS, "SELECT * FROM threats"))
def threat_feed(spark, d):
    return radar.threat_feed(feed_domains(spark, d), crowd.community_sites(D.reports(spark, d), _end()))


@query("feed_lines", S.select(_THREATS, "SELECT 8 AS head, count(*) AS n, (SELECT string_agg(indicator, ' ' ORDER BY last_seen DESC, detections + reporters DESC, indicator) FROM threats WHERE type = 'domain') AS listed FROM threats WHERE type = 'domain'"))
def feed_lines(spark, d):
    lines = sinks.feed_lines(threat_feed(spark, d), "Site feed", F.lit(TODAY))
    body = F.col("line_no") >= 8
    return lines.agg(F.count_if(~body).alias("head"), F.count_if(body).alias("n"),
                     F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("listed"))


@query("feed_document", S.select(_THREATS, "SELECT count(*) AS count, string_agg(indicator || ':' || source || ':' || reporters, ' ' ORDER BY indicator) AS listed FROM threats"))
def feed_document(spark, d):
    doc = sinks.feed_document(threat_feed(spark, d), "Site feed", F.lit(TODAY))
    parsed = doc.select(F.from_json("document", "count bigint, indicators array<struct<indicator:string,source:string,reporters:bigint>>").alias("j"))
    return parsed.select("j.count", F.array_join(F.transform("j.indicators", lambda i: F.concat_ws(":", i["indicator"], i["source"], i["reporters"].cast("string"))), " ").alias("listed"))


@query("radar_sites", S.select([S.CHECKS, _FLAGGED, S.REPORTS.replace(S.EVENTS + ", ", ""), COMMUNITY,
       f"recent AS (SELECT * FROM (SELECT domain, first_seen, last_seen, hits FROM flagged) WHERE NOT {S.never_listed('domain')})",
       "com AS (SELECT preview, max_by(first_day, last_ts) AS first_day, min_by(reporters, last_ts) AS reporters FROM community GROUP BY preview)"],
       """SELECT replace(coalesce(domain, preview), '.', '[.]') AS site, coalesce(first_seen, first_day) AS first_seen, coalesce(last_seen, first_day) AS last_seen, coalesce(hits, 0) AS hits, reporters,
 CASE WHEN domain IS NULL THEN 'community' WHEN preview IS NULL THEN 'auto' ELSE 'both' END AS source FROM recent FULL JOIN com ON domain = preview"""))
def radar_sites(spark, d):
    return radar.radar_sites(recent_domains(spark, d), crowd.community_sites(D.reports(spark, d), _end()))


@query("radar_document", S.select([S.CHECKS, _DAILY, _CATS, f"places AS ({ORACLES['radar_sites']})"], f"""SELECT (SELECT sum(checks) FROM daily)::BIGINT AS checks, (SELECT count(DISTINCT category) FROM cats) AS categories,
 {V.TREND_DAYS} AS days, (SELECT count(*) FROM places) AS sites, (SELECT sum(hits) FROM places)::BIGINT AS hits,
 (SELECT site FROM places ORDER BY last_seen DESC, hits DESC, site DESC LIMIT 1) AS newest"""))
def radar_document(spark, d):
    doc = sinks.radar_document(_gated(spark, d, V.SHOW_TOTALS_FROM), radar.daily_series(daily_counts(spark, d), _today()),
                               radar.category_counts(daily_categories(spark, d), F.to_date(F.lit("2024-01-01"))), radar_sites(spark, d), F.lit(TODAY))
    parsed = doc.select(F.from_json("document", "totals struct<checks:bigint>, categories array<struct<id:string>>, daily array<struct<day:string>>, sites array<struct<site:string,hits:bigint>>").alias("j"))
    return parsed.select("j.totals.checks", F.size("j.categories").cast("long").alias("categories"), F.size("j.daily").alias("days"), F.size("j.sites").alias("sites"),
                         F.aggregate("j.sites.hits", F.lit(0).cast("long"), lambda s, h: s + h).alias("hits"), F.get("j.sites.site", F.lit(0)).alias("newest"))


@query("upsert_keyed", S.select(S.REPORTS, "SELECT ind, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS hits, max_by(preview, ts) AS preview FROM reports GROUP BY ind"))
def upsert_keyed(spark, d):
    rows = D.reports(spark, d).select("ind", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).alias("hits"), "preview", F.col("ts").alias("at"))
    middle = F.expr("TIMESTAMP '2024-01-15 00:00:00'")
    merge = {"first_ts": "min", "last_ts": "max", "hits": "sum", "preview": "last", "at": "max"}
    old = sinks.upsert_keyed(rows.filter(F.col("at") < middle), rows.limit(0), ["ind"], merge, "at")
    return sinks.upsert_keyed(old, rows.filter(F.col("at") >= middle), ["ind"], merge, "at").drop("at")


@query("purge_expired", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{END}' - INTERVAL 2 DAYS")
def purge_expired(spark, d):
    return sinks.purge_expired(D.events(spark, d), _end(), V.MEMBER_DAYS).select("event_id")


# ---------------------------------------------------------------- moderation: nations are groups, customers are people
_MODES = ["delete", "warn", "off"]
_SETTINGS = "settings AS (SELECT n_nationkey AS chat_id, ['delete', 'warn', 'off'][n_nationkey % 3 + 1] AS mode, n_nationkey % 2 = 0 AS strict, n_nationkey % 4 <> 3 AS newcomers, n_nationkey % 5 = 0 AS test FROM nation WHERE n_nationkey < 20)"
_CHAT = "user_id % 25"


def _settings(spark, d):
    n, key = D.table(spark, d, "nation"), F.col("n_nationkey")
    return n.filter(key < 20).select(key.alias("chat_id"), D.pick(_MODES, key).alias("mode"), (key % 2 == 0).alias("strict"),
                                     (key % 4 != 3).alias("newcomers"), (key % 5 == 0).alias("test"))


@query("decide", S.select([S.CHECKS, _SETTINGS, "j AS (SELECT event_id, level, signals, event_id % 3 <> 0 AS can_delete, coalesce(mode, 'delete') AS mode, coalesce(strict, false) AS strict FROM checks LEFT JOIN settings ON person % 25 = chat_id)",
       "h AS (SELECT *, level = 'dangerous' OR (strict AND level = 'suspicious' AND NOT list_contains(signals, 'needs_context')) AS harmful FROM j)"],
       "SELECT event_id, CASE WHEN mode = 'off' OR NOT harmful THEN 'none' WHEN mode = 'delete' AND can_delete THEN 'delete' WHEN level = 'dangerous' THEN 'warn' ELSE 'none' END AS action FROM h"))
def decide(spark, d):
    rows = moderation.with_settings(D.checks(spark, d).withColumn("chat_id", F.col("person") % 25), _settings(spark, d))
    action = moderation.decide(F.col("level"), F.col("signals"), F.col("mode"), F.col("strict"), F.col("event_id") % 3 != 0)
    return rows.select("event_id", action.alias("action"))


_NEW = ("joins AS (SELECT user_id, ts FROM e WHERE event_type = 'signup'), "
        "nc AS (SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM joins j WHERE j.user_id = e.user_id AND j.ts <= e.ts AND e.ts < j.ts + INTERVAL 24 HOURS))")


@query("newcomer_violations", S.select([S.EVENTS, _NEW], "SELECT event_id FROM nc JOIN e USING (event_id) WHERE event_type <> 'signup' AND (k % 2 = 0 OR event_type = 'purchase')"))
def newcomer_violations(spark, d):
    e = D.events(spark, d).withColumn("chat_id", F.col("user_id") % 25).withColumnRenamed("user_id", "sender_id")
    messages = e.filter("event_type <> 'signup'").select(
        "event_id", "chat_id", "sender_id", "ts", F.when(F.col("event_type") == "purchase", "suspicious").otherwise("safe").alias("level"),
        F.array().cast("array<string>").alias("signals"), (F.col("k") % 2 == 0).alias("has_link"), F.lit(False).alias("from_chat"))
    return moderation.newcomer_violations(messages, e.filter("event_type = 'signup'")).select("event_id")


@query("strikes_24h", S.select(S.EVENTS, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS strikes FROM e WHERE event_type = 'error'"))
def strikes_24h(spark, d):
    removals = D.events(spark, d).filter("event_type = 'error'").withColumn("chat_id", F.col("user_id") % 25)
    return moderation.strikes(removals, sender="user_id").select("event_id", "strikes")


_SECONDS = "epoch_us(ts) / 1000000.0"


@query("strikes_with_reset", f"""WITH RECURSIVE r AS (SELECT user_id, event_id, {_SECONDS} AS t, event_type = 'signup' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, event_id, rn, CASE WHEN undo THEN [] ELSE [t] END AS hits, CASE WHEN undo THEN 0 ELSE 1 END AS strikes FROM r WHERE rn = 1
 UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN undo OR len(list_filter(hits, lambda h: r.t - h <= 86400)) >= 2 THEN [] ELSE list_append(list_filter(hits, lambda h: r.t - h <= 86400), r.t) END,
  CASE WHEN undo THEN 0 ELSE len(list_filter(hits, lambda h: r.t - h <= 86400)) + 1 END FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
SELECT event_id, strikes, strikes >= 3 AS mute FROM s""")
def strikes_with_reset(spark, d):
    e = D.events(spark, d).filter("event_type IN ('error', 'signup')").withColumn("undone", F.col("event_type") == "signup")
    return moderation.strikes_with_reset(e, ["user_id"], undone="undone").select("event_id", "strikes", "mute")


@query("rate_limit", f"""WITH RECURSIVE r AS (SELECT user_id, event_id, {_SECONDS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT user_id, event_id, rn, [t] AS hits, true AS admitted FROM r WHERE rn = 1
 UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN len(list_filter(hits, lambda h: r.t - h <= 86400)) >= 2 THEN list_filter(hits, lambda h: r.t - h <= 86400) ELSE list_append(list_filter(hits, lambda h: r.t - h <= 86400), r.t) END,
  len(list_filter(hits, lambda h: r.t - h <= 86400)) < 2 FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
SELECT event_id, admitted FROM s""")
def rate_limit(spark, d):
    return moderation.rate_limited(D.events(spark, d), 2, V.DAY_SECONDS, ["user_id"]).select("event_id", "admitted")


@query("notice_throttle", f"""WITH RECURSIVE r AS (SELECT event_type, event_id, {_SECONDS} AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT event_type, event_id, rn, t AS last, true AS notify FROM r WHERE rn = 1
 UNION ALL SELECT r.event_type, r.event_id, r.rn, CASE WHEN r.t - last >= 3600 THEN r.t ELSE last END, r.t - last >= 3600 FROM s JOIN r ON r.event_type = s.event_type AND r.rn = s.rn + 1)
SELECT event_id, notify FROM s""")
def notice_throttle(spark, d):
    return moderation.notice_throttle(D.events(spark, d), ["event_type"], gap=3600).select("event_id", "notify")


def _admitted(source: str, by: str, limit: int, window: int) -> list[str]:
    """Tables acc (admitted times of each key), and the admitted rows of (by, event_id, t), those of one time in order."""
    acc = (f"{source}_acc AS (SELECT {by}, list_reduce(list([t] ORDER BY t, event_id), lambda a, x: CASE WHEN len(a) < {limit} OR x[1] - a[len(a) - {limit - 1}] > {window} "
           f"THEN list_append(a, x[1]) ELSE a END, []::DOUBLE[]) AS acc FROM {source} GROUP BY {by})")
    rows = (f"{source}_in AS (SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY {by}, t ORDER BY event_id) AS nth FROM {source}) r JOIN "
            f"(SELECT {by}, t, count(*) AS n FROM (SELECT {by}, unnest(acc) AS t FROM {source}_acc) GROUP BY ALL) USING ({by}, t) WHERE nth <= n)")
    return [acc, rows]


_ADMISSION = S.select([f"first AS (SELECT event_id, user_id, 0 AS everybody, {_SECONDS}::DOUBLE AS t FROM events)", *_admitted("first", "user_id", 2, 21600),
                       "second AS (SELECT event_id, everybody, t FROM first_in)", *_admitted("second", "everybody", 12, 3600)],
                      """SELECT event_id, second_in.event_id IS NOT NULL AS admitted, CASE WHEN first_in.event_id IS NULL THEN 'visitor' WHEN second_in.event_id IS NULL THEN 'overall' END AS refused_by
FROM first LEFT JOIN first_in USING (event_id) LEFT JOIN second_in USING (event_id)""")


@query("admission", _ADMISSION)
def admission_limits(spark, d):
    """A limit per visitor and, behind it, one over everybody."""
    decided = admission.admission(D.events(spark, d), ["user_id"], per_visitor=(2, 21600), overall=(12, 3600))
    return decided.select("event_id", "admitted", "refused_by")


@query("group_removal_counts", "SELECT user_id % 25 AS chat_id, count(*) AS deleted FROM events WHERE event_type = 'error' GROUP BY 1")
def group_removal_counts(spark, d):
    return moderation.group_removal_counts(D.events(spark, d).filter("event_type = 'error'").select((F.col("user_id") % 25).alias("chat_id")))


@query("managed_groups", "SELECT c_custkey AS manager, c_nationkey AS chat_id, coalesce(n_name, '') AS title, coalesce(deleted, 0) AS deleted FROM customer LEFT JOIN "
       "(SELECT n_nationkey, n_name, (SELECT count(*) FROM events WHERE event_type = 'error' AND user_id % 25 = n_nationkey) AS deleted FROM nation WHERE n_nationkey < 20) g ON c_nationkey = n_nationkey")
def managed_groups(spark, d):
    groups = D.table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("chat_id"), F.col("n_name").alias("title"))
    with_counts = groups.join(group_removal_counts(spark, d).withColumn("chat_id", F.col("chat_id").cast("int")), "chat_id", "left")
    managers = D.table(spark, d, "customer").select(F.col("c_custkey").alias("manager"), F.col("c_nationkey").alias("chat_id"))
    return moderation.managed_groups(managers, with_counts)


@query("removal_log", f"SELECT user_id % 25 AS chat_id, event_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts DESC, event_id DESC) AS rank, 'site' || event_id || '[.]xyz' AS reason FROM events "
       f"WHERE event_type = 'error' AND ts >= TIMESTAMP '{END}' - INTERVAL 30 DAYS")
def removal_log(spark, d):
    removals = D.events(spark, d).filter("event_type = 'error'").select(
        (F.col("user_id") % 25).alias("chat_id"), "event_id", "ts", F.concat(F.lit("site"), F.col("event_id").cast("string"), F.lit(".xyz")).alias("reason"))
    return moderation.removal_log(removals, _end()).select("chat_id", "event_id", "rank", "reason")


_RAW = ("raw AS (SELECT event_id, user_id AS sender_id, user_id % 25 AS chat_id, event_id % 19 = 0 AS is_bot, event_id % 23 = 0 AS auto_forward, event_id % 5 = 0 AS is_channel, 7 AS linked_chat, "
        "user_id % 25 % 5 = 0 AS test FROM events), admins AS (SELECT s_nationkey AS chat_id, s_suppkey AS sender_id FROM supplier)")


def _raw(spark, d):
    e = D.events(spark, d)
    rows = e.select("event_id", F.col("user_id").alias("sender_id"), (F.col("user_id") % 25).alias("chat_id"), (F.col("event_id") % 19 == 0).alias("is_bot"),
                    (F.col("event_id") % 23 == 0).alias("auto_forward"), (F.col("event_id") % 5 == 0).alias("is_channel"), F.lit(7).alias("linked_chat"),
                    (F.col("user_id") % 25 % 5 == 0).alias("test"))
    return rows, D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("chat_id"), F.col("s_suppkey").alias("sender_id"))


@query("exempt_senders", S.select(_RAW, """SELECT event_id FROM raw WHERE NOT auto_forward AND CASE WHEN is_channel THEN test OR NOT (sender_id = chat_id OR sender_id = linked_chat)
 ELSE NOT is_bot AND (test OR (chat_id, sender_id) NOT IN (SELECT (chat_id, sender_id) FROM admins)) END"""))
def exempt_senders(spark, d):
    rows, admins = _raw(spark, d)
    return moderation.drop_exempt(rows, admins).select("event_id")


@query("moderate", S.select([S.CHECKS, _RAW, _SETTINGS, _NEW,
       "j AS (SELECT r.*, c.level, c.signals, coalesce(s.mode, 'delete') AS mode, coalesce(s.strict, false) AS strict, coalesce(s.newcomers, true) AS newcomers, e.k % 2 = 0 AS has_link, "
       "r.event_id IN (SELECT event_id FROM nc) AS is_new, e.event_id % 3 <> 0 AS can_delete FROM raw r JOIN checks c USING (event_id) JOIN e USING (event_id) LEFT JOIN settings s ON s.chat_id = r.chat_id)",
       "h AS (SELECT *, level = 'dangerous' OR (strict AND level = 'suspicious' AND NOT list_contains(signals, 'needs_context')) AS harmful, "
       "newcomers AND NOT is_channel AND is_new AND (has_link OR (level = 'suspicious' AND NOT list_contains(signals, 'needs_context'))) AS hit FROM j)",
       """t AS (SELECT * FROM h WHERE ((mode <> 'off' AND harmful AND (mode = 'delete' OR level = 'dangerous')) OR hit) AND NOT auto_forward AND CASE WHEN is_channel THEN test OR NOT (sender_id = chat_id OR sender_id = linked_chat)
 ELSE NOT is_bot AND (test OR (chat_id, sender_id) NOT IN (SELECT (chat_id, sender_id) FROM admins)) END)""",
       "a AS (SELECT *, CASE WHEN mode = 'off' OR NOT harmful THEN 'none' WHEN mode = 'delete' AND can_delete THEN 'delete' WHEN level = 'dangerous' THEN 'warn' ELSE 'none' END AS act FROM t)"],
       "SELECT event_id, CASE WHEN act = 'none' AND hit AND mode = 'delete' AND can_delete THEN 'delete' ELSE act END AS action, CASE WHEN act = 'none' AND hit AND mode = 'delete' AND can_delete THEN 'newcomer' ELSE 'harmful' END AS reason FROM a"))
def moderate(spark, d):
    rows, admins = _raw(spark, d)
    e = D.events(spark, d)
    more = D.checks(spark, d).select("event_id", "ts", "level", "signals")
    facts = e.select("event_id", (F.col("k") % 2 == 0).alias("has_link"), F.lit(False).alias("from_chat"))
    verdicts = rows.join(more, "event_id").join(facts, "event_id")
    joins = e.filter("event_type = 'signup'").select((F.col("user_id") % 25).alias("chat_id"), F.col("user_id").alias("sender_id"), "ts")
    return moderation.moderate(verdicts, _settings(spark, d).drop("test"), joins, admins, F.col("event_id") % 3 != 0).select("event_id", "action", "reason")


@query("training_candidates", S.select([S.MESSAGES, f"m AS (SELECT msg_id, ts, {S.mask_dataset('text')} AS text FROM messages WHERE msg_id % 2 = 0)",
       f"f AS (SELECT *, {S.fingerprint('text')} AS fp FROM m WHERE length(text) >= 8)"],
       "SELECT fp, CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen, count(*) AS hits FROM f GROUP BY fp"))
def training_candidates(spark, d):
    removals = D.messages(spark, d).select("text", "ts", (F.col("msg_id") % 2 == 0).alias("train"), F.lit("dangerous").alias("level"))
    return moderation.training_candidates(removals).select("fp", "first_seen", "last_seen", "hits")


@query("undo_feedback", S.select(S.MESSAGES, f"SELECT {S.mask_dataset('text')} AS text, 0 AS label, 'dangerous' AS predicted, false AS user_agreed, ts FROM messages"))
def undo_feedback(spark, d):
    return moderation.undo_feedback(D.messages(spark, d).withColumn("level", F.lit("dangerous")))


@query("edits_not_counted", S.select([S.CHECKS], f"SELECT CAST(ts AS DATE) AS day, count(*) AS checks FROM checks WHERE event_id % 4 <> 0 GROUP BY 1"))
def edits_not_counted(spark, d):
    checks = D.checks(spark, d).withColumn("edited", F.col("event_id") % 4 == 0)
    return radar.daily_counts(moderation.counted_once(checks)).select("day", "checks")


@query("training_export", S.select([S.MESSAGES, f"m AS (SELECT msg_id, {S.mask_dataset('text')} AS text FROM messages)"],
       "SELECT 'feedback' AS source, count(*) AS n, count(DISTINCT text) AS texts FROM m UNION ALL SELECT 'group', count(*), count(DISTINCT text) FROM m WHERE msg_id % 5 = 0"))
def training_export(spark, d):
    m = D.messages(spark, d).withColumn("text", mask_for_dataset(F.col("text")))
    feedback = m.select("text", F.lit(1).alias("label"), F.lit("safe").alias("predicted"), F.lit(False).alias("user_agreed"), "ts")
    candidates = m.filter(F.col("msg_id") % 5 == 0).select("text", F.lit("dangerous").alias("verdict"), F.to_date("ts").alias("first_seen"), F.lit(2).alias("hits"))
    return sinks.training_rows(feedback, candidates).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
