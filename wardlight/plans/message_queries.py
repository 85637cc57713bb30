"""Queries over whole checks: verdicts, explanations, attachments, lookups, crowd evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.operators import attachments, crowd, enrichment, explain, links, models, similarity, verdict
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.catalog import query

SALT = "pepper"
END = "2024-01-31 00:00:00"
_FLAT = "msg_id, level, round(score, 6) AS score, array_to_string(signals, ',') AS signals"


def _flat(df):
    return df.select("msg_id", "level", F.round("score", 6).alias("score"), F.array_join("signals", ",").alias("signals"))


@query("score_messages", S.select([S.MESSAGES, S.verdict_ctes()], f"SELECT {_FLAT} FROM verdicts"))
def score_messages(spark, d):
    return _flat(verdict.score_messages(D.messages(spark, d)))


@query("score_messages_with_model", S.select([S.MESSAGES, S.verdict_ctes("(m.msg_id * 7 % 101) / 100.0")], f"SELECT {_FLAT} FROM verdicts"))
def score_messages_with_model(spark, d):
    scored = D.messages(spark, d).withColumn("p", F.col("msg_id") * 7 % 101 / 100.0)
    return _flat(verdict.score_messages(scored, proba="p"))


@query("verdict_document", S.select([S.MESSAGES, S.verdict_ctes()],
       "SELECT msg_id, level, CASE WHEN level <> 'safe' THEN CAST(round_even(score * 100, 0) AS INTEGER) END AS risk, "
       "array_to_string(list_sort(list_distinct(signals)), ',') AS signals FROM verdicts"))
def verdict_document(spark, d):
    docs = verdict.verdict_document(verdict.score_messages(D.messages(spark, d)), "msg_id")
    signals = F.from_json("document", "signals array<string>")["signals"]
    return docs.select("msg_id", "level", "risk", F.array_join(F.array_sort(signals), ",").alias("signals"))


@query("explain_reasons", S.select([S.MESSAGES, S.verdict_ctes(),
       "r AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(k)}, {S.q(t[1])})" for k, t in explain.REASONS.items() if k in {r[0] for r in V.RULES})
       + ") x(rule, text))", """u AS (SELECT msg_id, unnest(counted_rules) AS rule, generate_subscripts(counted_rules, 1) AS nth FROM verdicts
 WHERE level <> 'safe' AND NOT needs_context AND kind NOT IN ('warning', 'report'))"""],
       "SELECT msg_id, string_agg(text, ' | ' ORDER BY nth) AS rule_reasons FROM u JOIN r USING (rule) GROUP BY msg_id"))
def explain_reasons(spark, d):
    told = explain.explain(verdict.score_messages(D.messages(spark, d)), F.lit("en"))
    rule_texts = [explain.REASONS[name][1] for name, *_ in V.RULES]
    own = F.filter("reasons", lambda r: r.isin(rule_texts))
    return told.filter(F.size(own) > 0).select("msg_id", F.array_join(own, " | ").alias("rule_reasons"))


_OUTSIDE = [("community", "m.msg_id % 2 = 0"), ("apk_reads_sms", "m.msg_id % 3 = 0"), ("file_program", "m.msg_id % 5 = 0")]


@query("explain_evidence", S.select([S.MESSAGES, S.verdict_ctes()], "SELECT m.msg_id, concat_ws(' | ', " + ", ".join(
       f"CASE WHEN {where} THEN CASE m.msg_id % 4 WHEN 0 THEN {S.q(explain.EVIDENCE[key][2])} WHEN 1 THEN {S.q(explain.EVIDENCE[key][1])} ELSE {S.q(explain.EVIDENCE[key][0])} END END"
       for key, where in _OUTSIDE) + ", CASE WHEN m.msg_id % 7 = 0 THEN CASE m.msg_id % 4 WHEN 0 THEN " + S.q(explain.LOOKED_UP[2]) + " WHEN 1 THEN " + S.q(explain.LOOKED_UP[1])
       + " ELSE " + S.q(explain.LOOKED_UP[0]) + " END END) AS told FROM messages m JOIN verdicts v USING (msg_id) WHERE v.level <> 'safe'"))
def explain_evidence(spark, d):
    """Reasons for evidence from outside the text, added to the scored messages."""
    key, empty = F.col("msg_id"), F.array().cast("array<string>")
    add = F.array_compact(F.array(F.when(key % 2 == 0, "community"), F.when(key % 3 == 0, "apk_reads_sms"), F.when(key % 5 == 0, "file_program")))
    scored = verdict.score_messages(D.messages(spark, d)).withColumn("signals", F.concat("signals", add)).withColumn(
        "confirmed", F.when(key % 7 == 0, F.array(F.lit("evil.site"))).otherwise(empty)).filter("level <> 'safe'")
    told = explain.explain(scored, F.when(key % 4 == 0, "ru").when(key % 4 == 1, "en").otherwise("uz"))
    texts = [t for three in [*explain.EVIDENCE.values(), explain.LOOKED_UP] for t in three]
    return told.select("msg_id", F.array_join(F.filter("reasons", lambda r: r.isin(texts)), " | ").alias("told"))


def _brand_case(values: dict[str, str]) -> str:
    return "CASE coalesce(brand, 'click') " + " ".join(f"WHEN {S.q(b)} THEN {S.q(v)}" for b, v in values.items()) + " END"


_TOLD = [
    "tx AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(k)}, {S.q(t[0])}, {S.q(t[2])})" for k, t in explain.REASONS.items()) + ") x(key, uz, ru))",
    "v AS (SELECT *, msg_id % 2 = 0 AS russian, kind IN ('warning', 'report') AS mention FROM verdicts)",
    """ls AS (SELECT msg_id, pos, host, brand, unnest(link_signals) AS key, generate_subscripts(link_signals, 1) AS nth FROM scored)""",
    f"""told AS (
 SELECT msg_id, 1 AS part, 0 AS a, 0 AS b, replace(CASE WHEN russian THEN ru ELSE uz END, '{{evidence}}', evidence) AS line FROM v, tx
 WHERE key = 'asked' AND kind = 'request' AND level <> 'safe' AND NOT needs_context
 UNION ALL SELECT msg_id, 2, nth, 0, CASE WHEN russian THEN ru ELSE uz END FROM (SELECT msg_id, russian, unnest(counted_rules) AS key, generate_subscripts(counted_rules, 1) AS nth
  FROM v WHERE level <> 'safe' AND NOT needs_context AND NOT mention) JOIN tx USING (key)
 UNION ALL SELECT msg_id, 3, pos, nth, replace(replace(replace(replace(CASE WHEN russian THEN ru ELSE uz END, '{{host}}', host), '{{tld}}', string_split(host, '.')[-1]),
  '{{brand}}', {_brand_case({b: V.BRAND_LABELS.get(b, b.capitalize()) for b in V.OFFICIAL_DOMAINS})}), '{{real}}', {_brand_case({b: ", ".join(sorted(d)) for b, d in V.OFFICIAL_DOMAINS.items()})})
  FROM ls JOIN tx USING (key) JOIN v USING (msg_id) WHERE level <> 'safe' AND NOT needs_context
 UNION ALL SELECT msg_id, 4, 0, 0, CASE WHEN russian THEN ru ELSE uz END FROM v, tx WHERE key = 'needs_context' AND needs_context)""",
    f"""risky AS (SELECT msg_id, array_to_string(list(line ORDER BY part, a, b)[1:{V.REASONS_SHOWN}], ' | ') AS reasons FROM told GROUP BY msg_id)""",
    """sites AS (SELECT msg_id, array_to_string(list_sort(list(DISTINCT regexp_replace(host, '^www\.', '')))[1:3], ', ') AS sites FROM scored WHERE official GROUP BY msg_id)""",
    """trusted AS (SELECT msg_id, string_agg(replace(replace(CASE WHEN russian THEN ru ELSE uz END, '{sites}', coalesce(sites, '')), '{evidence}', coalesce(evidence, '')), ' | ' ORDER BY key <> 'official_sites') AS trust
 FROM v LEFT JOIN sites USING (msg_id), tx WHERE level = 'safe' AND (key = 'official_sites' AND sites IS NOT NULL
 OR len(counted_rules) > 0 AND (key = 'is_warning' AND kind = 'warning' OR key = 'is_story' AND kind = 'report')) GROUP BY msg_id)""",
]


@query("explain_trust", S.select([S.MESSAGES, S.verdict_ctes(), *_TOLD],
       "SELECT v.msg_id, level, coalesce(reasons, '') AS reasons, coalesce(trust, '') AS trust FROM v LEFT JOIN risky USING (msg_id) LEFT JOIN trusted USING (msg_id)"))
def explain_trust(spark, d):
    told = explain.explain(verdict.score_messages(D.messages(spark, d)), F.when(F.col("msg_id") % 2 == 0, "ru").otherwise("uz"))
    return told.select("msg_id", "level", F.array_join(F.slice("reasons", 1, V.REASONS_SHOWN), " | ").alias("reasons"),
                       F.array_join("trust", " | ").alias("trust"))


# ---------------------------------------------------------------- attachments: one file per part
_EXT = ["apk", "jpg.apk", "pdf.exe", "xlsm", "zip", "pdf", "dat", "docx", "7z", "js", "HEIC", "PDF.SCR"]
_FILES = (f"files AS (SELECT p_partkey AS file_id, CASE WHEN p_partkey % 17 = 0 THEN p_name ELSE p_name || '.' || {S.array(_EXT)}[p_partkey % {len(_EXT)} + 1] END AS file_name, "
          f"CASE WHEN p_partkey % 29 = 0 THEN '{V.APP_MIME}' END AS mime, p_size * 1000000 AS size FROM part)")
_PARTS = "string_split(lower(trim(file_name)), '.')"
_E, _P = f"CASE WHEN len({_PARTS}) > 1 THEN {_PARTS}[-1] ELSE '' END", f"CASE WHEN len({_PARTS}) > 2 THEN {_PARTS}[-2] ELSE '' END"


def _files(spark, d):
    part = D.table(spark, d, "part")
    named = F.concat("p_name", F.lit("."), D.pick(_EXT, F.col("p_partkey")))
    return part.select(
        F.col("p_partkey").alias("file_id"), F.when(F.col("p_partkey") % 17 == 0, F.col("p_name")).otherwise(named).alias("file_name"),
        F.when(F.col("p_partkey") % 29 == 0, V.APP_MIME).alias("mime"), (F.col("p_size") * 1000000).alias("size"))


@query("file_classes", S.select([_FILES, f"f AS (SELECT *, {_E} AS ext, {_P} AS prev FROM files)",
       f"k AS (SELECT *, CASE WHEN ext IN {S.strings(V.EXECUTABLE)} OR coalesce(mime, '') = '{V.APP_MIME}' THEN 'program' WHEN ext IN {S.strings(V.MACRO)} THEN 'macro' WHEN ext IN {S.strings(V.ARCHIVE)} THEN 'archive' ELSE 'document' END AS kind FROM f)"],
       f"SELECT file_id, kind, CASE kind WHEN 'program' THEN 'dangerous' WHEN 'document' THEN 'safe' ELSE 'suspicious' END AS level, kind = 'program' AND prev IN {S.strings(V.DECOY)} AS double_extension FROM k"))
def file_classes(spark, d):
    return attachments.classify_files(_files(spark, d)).select("file_id", "kind", "level", "double_extension")


@query("needs_look_inside", S.select([_FILES, f"f AS (SELECT *, {_E} AS ext FROM files)"],
       f"SELECT file_id FROM f WHERE (ext IN {S.strings(V.ARCHIVE)} OR ext NOT IN {S.strings(V.DECOY + V.OTHER_KNOWN_TYPES + V.EXECUTABLE + V.MACRO)}) AND size <= {V.MAX_LOOK_BYTES}"))
def needs_look_inside(spark, d):
    return _files(spark, d).filter(attachments.needs_look_inside(F.col("file_name"), F.col("size"))).select("file_id")


# archives: an order is an archive, its lines are entries
_NAMES = ["photo.jpg", "AndroidManifest.xml", "lib/classes.dex", "a/run.exe", "readme.txt", "b/setup.BAT", "res/icon.png", "x.apk", "notes", "z.sh"]
_ENTRIES = (f"entries AS (SELECT l_orderkey AS file_id, 'pack' || l_orderkey || ['.zip', '.apk', '.dat'][l_orderkey % 3 + 1] AS file_name, "
            f"{S.array(_NAMES)}[(l_linenumber * 7 + l_orderkey) % {len(_NAMES)} + 1] AS entry_name FROM lineitem)")


def _entries(spark, d):
    li = D.table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        F.concat(F.lit("pack"), F.col("l_orderkey").cast("string"), D.pick([".zip", ".apk", ".dat"], F.col("l_orderkey"))).alias("file_name"),
        D.pick(_NAMES, F.col("l_linenumber") * 7 + F.col("l_orderkey")).alias("entry_name"))


@query("archive_scan", S.select([_ENTRIES, f"b AS (SELECT file_id, file_name, string_split(entry_name, '/')[-1] AS base FROM entries)",
       f"g AS (SELECT file_id, file_name, bool_or(lower(base) = 'androidmanifest.xml') AND bool_or(lower(base) IN ('classes.dex', 'resources.arsc')) AS app, "
       f"list_sort(list_distinct(list(base) FILTER (contains(base, '.') AND lower(string_split(base, '.')[-1]) IN {S.strings(V.EXECUTABLE)}))) AS hidden FROM b GROUP BY ALL)",
       "v AS (SELECT *, coalesce(len(hidden), 0) AS n, app AND NOT regexp_matches(lower(file_name), '\\.(apk|xapk|apks)$') AS renamed FROM g)"],
       "SELECT file_id, CASE WHEN renamed THEN 'renamed_app' ELSE 'hidden_program' END AS finding, CASE WHEN app THEN 0 ELSE n END AS hidden_count, "
       "CASE WHEN app THEN '' ELSE array_to_string(hidden[1:3], ', ') || CASE WHEN n > 3 THEN '…' ELSE '' END END AS listed FROM v WHERE renamed OR (NOT app AND n > 0)"))
def archive_scan(spark, d):
    return attachments.hidden_in_archive(_entries(spark, d))


# app manifests: a customer is an app
_PERMS = sorted({p for _, needs in V.CAPABILITIES for p in needs.get("permissions", [])})
_SERVS = sorted({p for _, needs in V.CAPABILITIES for p in needs.get("services", [])})
_MANIFESTS = (f"apps AS (SELECT c_custkey AS app_id, [{S.array(_PERMS)}[c_custkey % {len(_PERMS)} + 1], {S.array(_PERMS)}[c_custkey * 5 % {len(_PERMS)} + 1]] AS permissions, "
              f"CASE WHEN c_custkey % 4 = 0 THEN [{S.array(_SERVS)}[c_custkey // 4 % {len(_SERVS)} + 1]] ELSE [] END AS services, "
              "CASE WHEN c_custkey % 6 = 0 THEN ['android.provider.Telephony.SMS_RECEIVED'] ELSE [] END AS actions, "
              f"CASE WHEN c_nationkey % 2 = 0 THEN ['{V.LAUNCHER_CATEGORY}'] ELSE [] END AS categories, CASE WHEN c_custkey % 10 = 0 THEN ['fake entry'] ELSE [] END AS tolerated FROM customer)")
_TESTS = {sig: " OR ".join(f"list_has_any({f}, {S.array(v)})" for f, v in needs.items()) for sig, needs in V.CAPABILITIES}


def _manifests(spark, d):
    c, key = D.table(spark, d, "customer"), F.col("c_custkey")
    none = F.array().cast("array<string>")
    return c.select(
        key.alias("app_id"), F.array(D.pick(_PERMS, key), D.pick(_PERMS, key * 5)).alias("permissions"),
        F.when(key % 4 == 0, F.array(D.pick(_SERVS, F.floor(key / 4)))).otherwise(none).alias("services"),
        F.when(key % 6 == 0, F.array(F.lit("android.provider.Telephony.SMS_RECEIVED"))).otherwise(none).alias("actions"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit(V.LAUNCHER_CATEGORY))).otherwise(none).alias("categories"),
        F.when(key % 10 == 0, F.array(F.lit("fake entry"))).otherwise(none).alias("tolerated"))


@query("app_capabilities", S.select([_MANIFESTS, "t AS (SELECT *, " + ", ".join(f"({t}) AS {s}" for s, t in _TESTS.items()) + " FROM apps)"],
       "SELECT app_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in _TESTS)
       + f", CASE WHEN (apk_reads_sms OR apk_accessibility OR apk_notifications) AND NOT list_contains(categories, '{V.LAUNCHER_CATEGORY}') THEN 'apk_hidden_icon' END, "
       "CASE WHEN len(tolerated) > 0 THEN 'apk_evasion' END], lambda s: s IS NOT NULL), ',') AS signals FROM t"))
def app_capabilities(spark, d):
    return attachments.app_capabilities(_manifests(spark, d)).select("app_id", F.array_join("app_signals", ",").alias("signals"))


@query("apply_attachments", S.select([S.MESSAGES, S.verdict_ctes(), "f AS (SELECT msg_id, ['dangerous', 'suspicious', 'safe'][msg_id % 3 + 1] AS file_level FROM messages WHERE msg_id % 2 = 0)"],
       """SELECT v.msg_id, round(greatest(score, CASE file_level WHEN 'dangerous' THEN 0.95 WHEN 'suspicious' THEN 0.5 ELSE 0 END), 6) AS score,
 CASE WHEN level = 'dangerous' OR file_level = 'dangerous' THEN 'dangerous' WHEN level = 'suspicious' OR file_level = 'suspicious' THEN 'suspicious' ELSE 'safe' END AS level,
 CASE WHEN file_level = 'dangerous' THEN 'file_program' || CASE WHEN len(signals) > 0 THEN ',' ELSE '' END ELSE '' END || array_to_string(signals, ',') AS signals FROM verdicts v LEFT JOIN f USING (msg_id)"""))
def apply_attachments(spark, d):
    m = D.messages(spark, d)
    files = m.filter(F.col("msg_id") % 2 == 0).select("msg_id", D.pick(["dangerous", "suspicious", "safe"], F.col("msg_id")).alias("file_level"),
                                                      F.array().cast("array<string>").alias("app_signals"))
    return _flat(verdict.apply_attachments(verdict.score_messages(m), files, "msg_id"))


# ---------------------------------------------------------------- enrichment: answers derived from pages
_ANSWERS = S.LINKS + ", " + f"""ans AS (SELECT page_id, {S.lookup_domain(S.host('url'))} AS domain,
 '{{"events":[{{"eventAction":"last changed","eventDate":"2024-01-30T00:00:00Z"}},{{"eventAction":"registration","eventDate":"' || strftime(TIMESTAMP '2024-01-31' - to_hours(CAST(page_id * 13 % 2000 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') || '"}}]}}' AS rdap,
 page_id * 13 % 2000 AS hours, '{{"data":{{"attributes":{{"last_analysis_stats":{{"malicious":' || (page_id % 4) || ',"harmless":' || (page_id % 60) || '}}}}}}}}' AS votes,
 CASE WHEN page_id % 3 = 0 THEN '{{"matches":[{{"threatType":"MALWARE","threat":{{"url":"' || url || '"}}}}]}}' ELSE '{{}}' END AS listed FROM links)"""


def _answers(spark, d):
    from wardlight.functions.hosts import host_of, lookup_domain
    base = D.links(spark, d)
    when = F.date_format(F.expr(f"TIMESTAMP '{END}'") - F.make_dt_interval(F.lit(0), (F.col("page_id") * 13 % 2000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return base.select(
        "page_id", "url", lookup_domain(host_of(F.col("url"))).alias("domain"),
        F.concat(F.lit('{"events":[{"eventAction":"last changed","eventDate":"2024-01-30T00:00:00Z"},{"eventAction":"registration","eventDate":"'),
                 when, F.lit('"}]}')).alias("rdap"),
        F.concat(F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), (F.col("page_id") % 4).cast("string"), F.lit(',"harmless":'),
                 (F.col("page_id") % 60).cast("string"), F.lit("}}}}")).alias("votes"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"matches":[{"threatType":"MALWARE","threat":{"url":"'), "url", F.lit('"}}]}'))).otherwise("{}").alias("listed"))


_AGE = "CASE WHEN hours // 24 < 7 THEN 0.6 WHEN hours // 24 < 30 THEN 0.4 ELSE 0 END"


@query("domain_age", S.select(_ANSWERS, f"SELECT page_id, CAST(hours // 24 AS INTEGER) AS age_days, CAST({_AGE} AS DOUBLE) AS evidence, CASE WHEN hours // 24 < 7 THEN 'domain_very_new' WHEN hours // 24 < 30 THEN 'domain_new' ELSE '' END AS signals FROM ans"))
def domain_age(spark, d):
    found = enrichment.domain_age_findings(_answers(spark, d), F.expr(f"TIMESTAMP '{END}'"))
    return found.select("page_id", "age_days", "evidence", F.array_join("signals", ",").alias("signals"))


@query("engine_votes", S.select(_ANSWERS, "SELECT page_id, page_id % 4 AS bad, page_id % 4 + page_id % 60 AS total, CAST(CASE WHEN page_id % 4 >= 2 THEN 0.95 WHEN page_id % 4 = 1 THEN 0.4 ELSE 0 END AS DOUBLE) AS evidence, CASE WHEN page_id % 4 >= 2 THEN domain ELSE '' END AS confirmed FROM ans"))
def engine_votes(spark, d):
    found = enrichment.engine_vote_findings(_answers(spark, d))
    return found.select("page_id", "bad", "total", "evidence", F.array_join("confirmed", ",").alias("confirmed"))


@query("listed_sites", S.select(_ANSWERS, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0.95 ELSE 0 END::DOUBLE AS evidence, CASE WHEN page_id % 3 = 0 THEN domain ELSE '' END AS confirmed FROM ans"))
def listed_sites(spark, d):
    found = enrichment.blocklist_service_findings(_answers(spark, d))
    return found.select("page_id", "evidence", F.array_join("confirmed", ",").alias("confirmed"))


def _findings(spark, d):
    a = _answers(spark, d)
    keep = ["domain", "evidence", "signals", "confirmed"]
    age = enrichment.domain_age_findings(a, F.expr(f"TIMESTAMP '{END}'")).select(*keep).withColumn("check", F.lit("1_age"))
    votes = enrichment.engine_vote_findings(a).select(*keep).withColumn("check", F.lit("2_votes"))
    listed = enrichment.blocklist_service_findings(a).select(*keep).withColumn("check", F.lit("0_list"))
    return age.unionByName(votes).unionByName(listed)


@query("merge_findings", S.select([_ANSWERS, f"""f AS (SELECT DISTINCT domain, check_, evidence, signals FROM (
 SELECT domain, 'age' AS check_, CAST({_AGE} AS DOUBLE) AS evidence, CASE WHEN hours // 24 < 7 THEN 'a' WHEN hours // 24 < 30 THEN 'b' ELSE '' END AS signals FROM ans
 UNION ALL SELECT domain, 'votes', CASE WHEN page_id % 4 >= 2 THEN 0.95 WHEN page_id % 4 = 1 THEN 0.4 ELSE 0 END, CASE WHEN page_id % 4 >= 2 THEN 'cc' WHEN page_id % 4 = 1 THEN 'c' ELSE '' END FROM ans
 UNION ALL SELECT domain, 'list', CASE WHEN page_id % 3 = 0 THEN 0.95 ELSE 0 END, CASE WHEN page_id % 3 = 0 THEN 'd' ELSE '' END FROM ans))"""],
       "SELECT domain, round(1 - product(1 - evidence), 6) AS evidence, count(*) FILTER (signals <> '') AS n_signals FROM f GROUP BY domain"))
def merge_findings(spark, d):
    merged = enrichment.merge_findings(_findings(spark, d), "domain")
    return merged.select("domain", F.round("evidence", 6).alias("evidence"), F.size("signals").cast("long").alias("n_signals"))


@query("lookup_candidates", S.select([S.MESSAGES, S.message_links_ctes(),
       f"a AS (SELECT msg_id, pos, {S.lookup_domain('host')} AS domain, row_number() OVER (PARTITION BY msg_id ORDER BY pos) AS rn FROM scored WHERE NOT official AND NOT {S.is_ip('host')})",
       "n AS (SELECT *, row_number() OVER (PARTITION BY msg_id, domain ORDER BY pos) = 1 AS fresh FROM a)",
       "r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id ORDER BY pos) AS dr FROM n)"],
       "SELECT msg_id, pos - 1 AS pos, domain, rn <= 5 AS ask_url, fresh AND dr <= 3 AS ask_domain FROM r WHERE rn <= 5 OR (fresh AND dr <= 3)"))
def lookup_candidates(spark, d):
    rows = links.explode_links(D.messages(spark, d), "text", "msg_id")
    return enrichment.lookup_candidates(rows).select("msg_id", F.col("pos").cast("long").alias("pos"), "domain", "ask_url", "ask_domain")


@query("latest_lookup", S.select([S.EVENTS, "l AS (SELECT k, ts, max(event_id) AS answer FROM e WHERE event_type = 'view' AND event_id % 3 <> 0 GROUP BY k, ts)"],
       """SELECT e.event_id, CASE WHEN e.ts - l.ts < INTERVAL 6 HOURS THEN CAST(l.answer AS VARCHAR) END AS answer FROM (SELECT * FROM e WHERE event_type <> 'view') e
 ASOF LEFT JOIN l ON e.k = l.k AND e.ts >= l.ts"""))
def latest_lookup(spark, d):
    e = D.events(spark, d)
    lookups = e.filter("event_type = 'view'").select("k", "ts", F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("answer"))
    asked = e.filter("event_type <> 'view'").select("event_id", "k", "ts")
    return enrichment.latest_valid_lookup(asked, lookups, key="k").select("event_id", "answer")


@query("apply_enrichment", S.select([S.MESSAGES, S.verdict_ctes(), "f AS (SELECT msg_id, msg_id % 7 / 8.0 AS e FROM messages WHERE msg_id % 3 = 0)",
       "j AS (SELECT msg_id, level, signals, 1 - (1 - score) * (1 - coalesce(e, 0)) AS s, coalesce(e, 0) AS e FROM verdicts LEFT JOIN f USING (msg_id))"],
       """SELECT msg_id, round(s, 6) AS score, CASE WHEN e = 0 THEN level WHEN level = 'dangerous' OR s >= 0.65 THEN 'dangerous' WHEN level = 'suspicious' OR s >= 0.35 THEN 'suspicious' ELSE 'safe' END AS level,
 array_to_string(CASE WHEN e > 0 THEN list_append(signals, 'engine_votes') ELSE signals END, ',') AS signals FROM j"""))
def apply_enrichment(spark, d):
    m = D.messages(spark, d)
    found = m.filter(F.col("msg_id") % 3 == 0).select("msg_id", (F.col("msg_id") % 7 / 8.0).alias("evidence"),
                                                      F.array(F.lit("engine_votes")).alias("signals"), F.array(F.lit("evil.site")).alias("confirmed"))
    return _flat(verdict.apply_enrichment(verdict.score_messages(m), found, "msg_id"))


# ---------------------------------------------------------------- crowd
_IND = rf"""ind_links AS (SELECT msg_id, url, host, {S.domain('host')} AS dom, {S.without_www('host')} AS short FROM urls),
ind_sites AS (SELECT msg_id, host, dom, short, (host IN {S.strings(V.SHORTENERS)} OR host IN {S.strings(V.PLATFORMS)} OR dom IN {S.strings(V.PLATFORMS)} OR short IN {S.strings(V.PLATFORMS)}) AS platform,
 rtrim(split_part(CASE WHEN contains(url, host) THEN substr(url, instr(url, host) + length(host)) ELSE url END, '?', 1), '/') AS path FROM ind_links),
inds AS (SELECT DISTINCT msg_id, 'site' AS kind, CASE WHEN platform THEN lower(short || path) ELSE dom END AS value FROM ind_sites
  WHERE (platform AND length(path) > 1 AND NOT regexp_matches(host, '(t\.me|telegram\.me)$')) OR (NOT platform AND NOT {S.official('host')})
 UNION SELECT msg_id, 'tg', '@' || h FROM (SELECT msg_id, lower(unnest(regexp_extract_all(text, '(?:(?:^|[^{S.WORD}.])@|(?:https?://)?(?:t|telegram)\.me/)([A-Za-z][A-Za-z0-9_]{{3,31}})\b', 1))) AS h FROM messages) WHERE h NOT IN {S.strings(V.RESERVED_HANDLES)})"""
_TEXT_PHONE = rf"""ph0 AS (SELECT msg_id, unnest(regexp_extract_all(text, '(?:^|\P{{Nd}})((?:\+?\s?998[\s-]?)?\(?[2-9]\p{{Nd}}\)?[\s-]?\p{{Nd}}{{3}}[\s-]?\p{{Nd}}{{2}}[\s-]?\p{{Nd}}{{2}})(?:\P{{Nd}}|$)', 1)) AS m FROM messages),
phones AS (SELECT DISTINCT msg_id, 'phone' AS kind, '+998' || right(regexp_replace(m, '\P{{Nd}}', '', 'g'), 9) AS value FROM ph0)"""
_INDICATORS = [S.MESSAGES, S.urls_cte("messages"), _IND, _TEXT_PHONE,
               f"indicators AS (SELECT * FROM inds UNION SELECT * FROM phones WHERE substr(value, 5, 2) IN {S.strings(V.MOBILE_CODES)})"]


@query("indicators", S.select(_INDICATORS, "SELECT msg_id, kind, value FROM indicators"))
def indicators(spark, d):
    return crowd.extract_indicators(D.messages(spark, d), "msg_id").select("msg_id", "kind", "value")


@query("crowd_hits", S.select([*_INDICATORS, "c AS (SELECT kind, value, count(DISTINCT sender_id) AS n FROM indicators JOIN messages USING (msg_id) GROUP BY ALL HAVING n >= 2)"],
       "SELECT i.msg_id, i.kind, n AS reporters, CASE WHEN n >= 5 THEN 0.8 ELSE 0.5 END::DOUBLE AS weight FROM indicators i JOIN c ON i.kind = c.kind AND i.value = c.value"))
def crowd_hits(spark, d):
    m = D.messages(spark, d)
    found = crowd.extract_indicators(m, "msg_id", "sender_id", "ts")
    reports = crowd.report_rows(found, "sender_id", "ts", SALT)
    counts = crowd.reporter_counts(reports, F.expr(f"TIMESTAMP '{END}'"))
    return crowd.crowd_hits(found, counts, SALT, "msg_id").select("msg_id", "kind", "reporters", "weight")


@query("apply_crowd", S.select([S.MESSAGES, S.verdict_ctes(), *[c for c in _INDICATORS if c not in (S.MESSAGES, S.urls_cte("messages"))],
       "c AS (SELECT kind, value, count(DISTINCT sender_id) AS n FROM indicators JOIN messages USING (msg_id) GROUP BY ALL HAVING n >= 2)",
       "w AS (SELECT i.msg_id, 1 - product(1 - CASE WHEN n >= 5 THEN 0.8 ELSE 0.5 END) AS w FROM indicators i JOIN c ON i.kind = c.kind AND i.value = c.value GROUP BY i.msg_id)",
       "j AS (SELECT v.*, coalesce(w, 0) AS w, 1 - (1 - score) * (1 - coalesce(w, 0)) AS s FROM verdicts v LEFT JOIN w USING (msg_id))"],
       """SELECT msg_id, round(s, 6) AS score, CASE WHEN w = 0 THEN level WHEN level = 'dangerous' OR s >= 0.65 THEN 'dangerous' WHEN level = 'suspicious' OR s >= 0.35 THEN 'suspicious' ELSE 'safe' END AS level,
 array_to_string(CASE WHEN w > 0 THEN list_append(signals, 'community') ELSE signals END, ',') AS signals FROM j"""))
def apply_crowd(spark, d):
    m = D.messages(spark, d)
    found = crowd.extract_indicators(m, "msg_id", "sender_id", "ts")
    counts = crowd.reporter_counts(crowd.report_rows(found, "sender_id", "ts", SALT), F.expr(f"TIMESTAMP '{END}'"))
    weights = crowd.crowd_weights(crowd.crowd_hits(found, counts, SALT, "msg_id"), "msg_id")
    return _flat(verdict.apply_crowd(verdict.score_messages(m), weights, "msg_id"))


@query("current_reports", S.select(S.REPORTS, "SELECT ind, reporter, max(ts) AS ts FROM reports GROUP BY ind, reporter"))
def current_reports(spark, d):
    return crowd.current_reports(D.reports(spark, d)).select("ind", "reporter", "ts")


@query("report_counts", S.select(S.REPORTS, f"SELECT ind, count(DISTINCT reporter) AS reporters FROM reports WHERE ts >= TIMESTAMP '{END}' - INTERVAL 20 DAYS GROUP BY ind"))
def report_counts(spark, d):
    return crowd.reporter_counts(D.reports(spark, d), F.expr(f"TIMESTAMP '{END}'"), days=20)


@query("new_report_counts", S.select(S.REPORTS, "SELECT reporter, count(DISTINCT ind) AS new_reports FROM reports GROUP BY reporter"))
def new_report_counts(spark, d):
    return crowd.new_report_counts(D.reports(spark, d))


@query("report_weight", S.select(S.REPORTS, f"SELECT ind, CASE WHEN n >= 5 THEN 0.8 WHEN n >= 2 THEN 0.5 ELSE 0 END::DOUBLE AS weight FROM (SELECT ind, count(DISTINCT reporter) AS n FROM reports WHERE ts >= TIMESTAMP '{END}' - INTERVAL 2 DAYS GROUP BY ind)"))
def report_weight(spark, d):
    counts = crowd.reporter_counts(D.reports(spark, d), F.expr(f"TIMESTAMP '{END}'"), days=2)
    return counts.select("ind", crowd.report_weight(F.col("reporters")).alias("weight"))


@query("blocked_count", S.select(S.REPORTS, f"SELECT count(*) AS blocked FROM (SELECT ind FROM reports WHERE ts >= TIMESTAMP '{END}' - INTERVAL 2 DAYS GROUP BY ind HAVING count(DISTINCT reporter) >= 5)"))
def blocked_count(spark, d):
    return crowd.blocked_count(crowd.reporter_counts(D.reports(spark, d), F.expr(f"TIMESTAMP '{END}'"), days=2), 5)


COMMUNITY = f"""site_rows AS (SELECT ind, reporter, min(preview) AS preview, max(ts) AS ts FROM reports WHERE kind = 'site' AND ts >= TIMESTAMP '{END}' - INTERVAL 90 DAYS GROUP BY ind, reporter),
community AS (SELECT min(preview) AS preview, CAST(min(ts) AS DATE) AS first_day, count(*) AS reporters, max(ts) AS last_ts FROM site_rows GROUP BY ind HAVING count(*) >= 2)"""


@query("community_sites", S.select([S.REPORTS, COMMUNITY], "SELECT preview, first_day, reporters FROM community"))
def community_sites(spark, d):
    return crowd.community_sites(D.reports(spark, d), F.expr(f"TIMESTAMP '{END}'")).select("preview", "first_day", "reporters")


@query("report_to_feedback", S.select([S.MESSAGES, "a AS (SELECT *, ['report', 'agree', 'disagree'][msg_id % 3 + 1] AS action, ['safe', 'suspicious', 'dangerous'][msg_id % 7 % 3 + 1] AS level FROM messages)"],
       """SELECT msg_id, CASE action WHEN 'report' THEN 1 WHEN 'agree' THEN CAST(level <> 'safe' AS INTEGER) ELSE CAST(level = 'safe' AS INTEGER) END AS label, level AS predicted,
 CASE action WHEN 'report' THEN level <> 'safe' ELSE action = 'agree' END AS user_agreed, action = 'report' OR (action = 'disagree' AND level = 'safe') AS remembered FROM a"""))
def report_to_feedback(spark, d):
    m = D.messages(spark, d)
    actions = m.select("msg_id", F.col("sender_id").alias("user_id"), "ts", "text", D.pick(["report", "agree", "disagree"], F.col("msg_id")).alias("action"),
                       D.pick(["safe", "suspicious", "dangerous"], F.col("msg_id") % 7).alias("level"))
    out = crowd.report_to_feedback(actions, SALT)
    remembered = out["vectors"].select("msg_id", F.lit(True).alias("remembered"))
    return out["feedback"].join(remembered, "msg_id", "left").select(
        "msg_id", "label", "predicted", "user_agreed", F.coalesce("remembered", F.lit(False)).alias("remembered"))


# near-copies of every vector: the first number of the vector is stretched, more for some copies than for others
_COPIES = """base AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
copies AS (SELECT vec_id, c.c, list_transform(v, lambda x, i: CASE WHEN i <= c.c * 3 THEN x * (1 + c.c) ELSE x END) AS w FROM base, (VALUES (0), (1), (2), (5)) c(c)),
reports AS (SELECT vec_id % 50 * 10 + c AS reporter, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM copies)"""


@query("similar_reporters", S.select(_COPIES, f"""SELECT b.vec_id, count(DISTINCT reporter) AS reporters FROM base b LEFT JOIN reports r ON list_dot_product(b.v, r.w) >= {V.SAME_SCAM_AT} GROUP BY b.vec_id"""))
def similar_reporters(spark, d):
    e = D.table(spark, d, "embeddings")
    stretched = e.withColumn("c", F.explode(F.array(*[F.lit(c) for c in (0, 1, 2, 5)]))).select(
        (F.col("vec_id") % 50 * 10 + F.col("c")).alias("reporter"),
        F.transform("embedding", lambda x, i: F.when(i < F.col("c") * 3, x.cast("double") * (1 + F.col("c"))).otherwise(x.cast("double"))).alias("w"))
    reports = stretched.select("reporter", similarity.unit(F.col("w")).alias("embedding"))
    return similarity.similar_reporters(e.select("vec_id", "embedding"), reports, key="vec_id")


@query("similar_pairs", """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS report_id, round(list_dot_product(a.v, b.v), 5) AS cosine FROM b a JOIN b ON list_dot_product(a.v, b.v) >= 0.3""")
def similar_pairs(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    pairs = similarity.similar_pairs(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "report_id"), 0.3)
    return pairs.select(F.col("query_id").cast("long"), F.col("report_id").cast("long"), F.round("cosine", 5).alias("cosine"))


@query("similar_hits", S.select(_COPIES, f"SELECT vec_id, 0.5::DOUBLE AS weight FROM (SELECT b.vec_id, count(DISTINCT reporter) AS n FROM base b JOIN reports r ON list_dot_product(b.v, r.w) >= {V.SAME_SCAM_AT} GROUP BY b.vec_id) WHERE n >= 2"))
def similar_hits(spark, d):
    return crowd.similar_hits(similar_reporters(spark, d), "vec_id").select("vec_id", "weight")


@query("ensemble_proba", "SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN quality / 2.0 ELSE (quality / 2.0 + toxic / 4.0) / 2 END::DOUBLE AS p FROM labels")
def ensemble_proba(spark, d):
    other = F.when(F.col("doc_id") % 3 != 0, F.col("toxic") / 4.0)
    return D.table(spark, d, "labels").select("doc_id", models.ensemble_proba(F.col("quality") / 2.0, other).alias("p"))
