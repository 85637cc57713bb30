"""SQL (DuckDB dialect) building blocks: the same meanings as the column functions, written independently.

DuckDB's regular expressions have no look-around and ASCII word boundaries, so patterns are rewritten: a boundary
becomes "edge of text or a non-word character", which is enough to decide whether a pattern occurs.
"""

from __future__ import annotations

import re

from wardlight import values as V
from wardlight.plans.datasets import HOSTS, PHRASES, SIGNAL_SETS

WORD = r"\pL\pN_"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
MARK = "﷐"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def array(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def occurs(alternatives: list[str]) -> str:
    """A pattern for normalised text that occurs exactly when one of the alternatives does."""
    return "|".join(f"(?:{_rewrite(a)})" for a in alternatives)


def _rewrite(p: str) -> str:
    p = p.replace("(?!ma)", "(?:$|[^m]|m$|m[^a])")
    p = re.sub(r"^(?:\(\?<![^)]*\))+", "", p)              # look-behinds are applied to the text instead
    p = p.replace(r"[^.\n]", "[^.]").replace(r"[\w-]", f"[{WORD}-]").replace(r"[\d\s.,]", r"[\p{Nd} .,]")
    p = p.replace(r"[\d\s]", r"[\p{Nd} ]").replace(r"\S", "[^ ]").replace(r"\s", " ").replace(r"\d", r"\p{Nd}")
    out, i = "", 0
    while i < len(p):
        if p.startswith(r"\b", i):
            rest = p[i + 2:]
            leading = bool(rest) and (rest[0].isalnum() or rest.startswith(("(?:", r"\w", f"[{WORD}")))
            leading = leading and not (out and (out[-1].isalnum()))
            if out.endswith(")") and not rest.startswith(("(?:", r"\w")):
                leading = False
            out += f"(?:^|[^{WORD}])" if leading else f"(?:$|[^{WORD}])"
            i += 2
        elif p.startswith(r"\w", i):
            out += f"[{WORD}]"
            i += 2
        else:
            out += p[i]
            i += 1
    return out


def has(text: str, alternatives: list[str]) -> str:
    return f"regexp_matches({text}, {q(occurs(alternatives))})"


def either(norm: str, latin: str, alternatives: list[str]) -> str:
    return f"({has(norm, alternatives)} OR {has(latin, alternatives)})"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(SPACE + '+')}, ' ', 'g'))"


def norm(e: str) -> str:
    return squeeze(f"lower(regexp_replace({e}, {q('[' + V.APOSTROPHES + ']')}, '''', 'g'))")


def latin(e: str) -> str:
    for cyr, lat in V.CYRILLIC_TO_LATIN.items():
        if len(lat) > 1:
            e = f"replace({e}, {q(cyr)}, {q(lat)})"
    single = {k: v for k, v in V.CYRILLIC_TO_LATIN.items() if len(v) == 1}
    dropped = "".join(k for k, v in V.CYRILLIC_TO_LATIN.items() if not v)
    return f"translate({e}, {q(''.join(single) + dropped)}, {q(''.join(single.values()))})"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def mask(e: str) -> str:
    card = r"\b(?:\p{Nd}[ -]?){15,18}\p{Nd}\b"
    email = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.]+"
    phone = r"(?:\+?998[ -]?)?\(?\p{Nd}{2}\)?[ -]?\p{Nd}{3}[ -]?\p{Nd}{2}[ -]?\p{Nd}{2}\b"
    for pattern, name in ((card, "<CARD>"), (email, "<EMAIL>"), (phone, "<PHONE>")):
        e = f"regexp_replace({e}, {q(pattern)}, {q(name)}, 'g')"
    return e


def mask_dataset(e: str) -> str:
    user = rf"(^|[^{WORD}.])@[A-Za-z][A-Za-z0-9_]{{3,31}}\b"
    return strip(rf"regexp_replace({mask(e)}, {q(user)}, '\1<USER>', 'g')")


def content_key(e: str) -> str:
    return f"regexp_replace({latin(norm(e))}, {q(f'[^{WORD}<>]')}, '', 'g')"


def fingerprint(e: str) -> str:
    return f"sha256({content_key(e)})"


def split_of(fp: str) -> str:
    return f"CASE WHEN CAST('0x' || substr({fp}, 1, 8) AS BIGINT) % 100 < {V.HOLDOUT_PERCENT} THEN 'holdout' ELSE 'train' END"


def snippet(e: str, limit: int = V.EVIDENCE_CHARS) -> str:
    clean = squeeze(mask(e))
    return f"CASE WHEN length({clean}) <= {limit} THEN {clean} ELSE rtrim(substr({clean}, 1, {limit - 1})) || '…' END"


# ---------------------------------------------------------------- links
def host(url: str) -> str:
    authority = f"regexp_extract(regexp_replace({url}, '(?i)^https?://', ''), '^([^/?#]*)', 1)"
    return rf"regexp_replace(lower(split_part(regexp_replace({authority}, '^.*@', ''), ':', 1)), '\.+$', '')"


def without_www(h: str) -> str:
    return rf"regexp_replace({h}, '^www\.', '')"


def domain(h: str, second_level=tuple(V.SECOND_LEVEL_LABELS)) -> str:
    parts = f"string_split({h}, '.')"
    return (f"CASE WHEN len({parts}) >= 3 AND {parts}[-2] IN {strings(second_level)} THEN array_to_string({parts}[-3:], '.') "
            f"ELSE array_to_string({parts}[-2:], '.') END")


def lookup_domain(h: str) -> str:
    return domain(without_www(f"trim({h}, '.')"), tuple(V.LOOKUP_SECOND_LEVEL_LABELS))


def is_ip(h: str) -> str:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return f"regexp_full_match({h}, {q(rf'(?:{octet}{chr(92)}.){{3}}{octet}')})"


def official(h: str) -> str:
    known = sorted({d for ds in V.OFFICIAL_DOMAINS.values() for d in ds} | set(V.TRUSTED_DOMAINS) | {V.TRUSTED_PARENT})
    pattern = r"(?:^|\.)(?:" + "|".join(re.escape(d).replace(r"\-", "-") for d in known) + ")$"
    return f"regexp_matches({h}, {q(pattern)})"


def brand_abroad(h: str) -> str:
    d = domain(h)
    return (f"(({d}) IN {strings(V.BRAND_SERVICE_DOMAINS)} OR (split_part({d}, '.', 1) IN {strings(V.INTERNATIONAL_BRANDS)} "
            f"AND string_split({d}, '.')[-1] NOT IN {strings(V.SUSPICIOUS_TLDS)}))")


def never_listed(h: str) -> str:
    return f"({official(h)} OR {h} IN {strings(V.SHORTENERS)} OR {brand_abroad(h)})"


def words(h: str) -> str:
    folded = f"replace(translate({h}, {q(''.join(V.HOMOGLYPHS))}, {q(''.join(V.HOMOGLYPHS.values()))}), 'rn', 'm')"
    parts = "list_filter(string_split(lb, '-'), lambda p: p <> '')"
    pairs = f"list_transform(range(1, len({parts})), lambda i: {parts}[i] || {parts}[i + 1])"
    return f"flatten(list_transform(string_split({folded}, '.'), lambda lb: list_concat({parts}, {pairs})))"


def brand_cte(source: str, name: str = "branded") -> str:
    """`source` (with host) plus brand: the first brand of the list that some word of the host imitates."""
    brands = ", ".join(f"({i}, {q(b)})" for i, b in enumerate(V.OFFICIAL_DOMAINS))
    bait = "(?:" + "|".join(V.BAIT_AFFIXES) + "){0," + str(V.MAX_BAIT_PER_SIDE) + "}"
    return f"""{name}_hosts AS (SELECT DISTINCT host FROM {source}),
{name}_words AS (SELECT host, unnest({words('host')}) AS w FROM {name}_hosts WHERE NOT {official('host')} AND NOT {brand_abroad('host')}),
{name}_brands AS (SELECT host, min_by(b.brand, b.ord) AS brand FROM {name}_words JOIN (VALUES {brands}) b(ord, brand)
  ON regexp_full_match(w, {q(bait)} || b.brand || {q(bait)})
  OR (length(b.brand) >= 5 AND abs(length(w) - length(b.brand)) <= 1 AND levenshtein(regexp_replace(w, '[^\x00-\x7f]', '?', 'g'), b.brand) = 1) GROUP BY host),
{name} AS (SELECT s.*, nb.brand FROM {source} s LEFT JOIN {name}_brands nb ON s.host = nb.host)"""


def scored_links_cte(source: str, name: str = "scored") -> str:
    """`source` (with url, host, brand) plus official, score, signals (text, comma separated) and link_signals (list)."""
    authority = r"regexp_extract(url, '^(?:.*?//)?([^/]*)', 1)"
    flags = {
        "lookalike_site": "brand IS NOT NULL",
        "punycode": "(starts_with(host, 'xn--') OR contains(host, '.xn--'))",
        "ip_link": is_ip("host"),
        "shortener": f"host IN {strings(V.SHORTENERS)}",
        "risky_tld": f"string_split(host, '.')[-1] IN {strings(V.SUSPICIOUS_TLDS)}",
        "subdomains": "len(string_split(host, '.')) >= 5",
        "at_trick": f"contains({authority}, '@')",
        "apk_link": r"regexp_matches(url, '(?i)\.apk(?:$|[?#])')",
        "bait_domain": f"regexp_matches(host, {q(V.HOST_BAIT)})",
    }
    total = " + ".join(f"CASE WHEN {n} THEN {V.LINK_WEIGHTS[n]} ELSE 0 END" for n in flags)
    listed = ", ".join(["CASE WHEN lookalike_site THEN 'brand:' || brand END"] + [f"CASE WHEN {n} THEN '{n}' END" for n in flags]
                       + ["CASE WHEN starts_with(lower(url), 'http://') AND base > 0 THEN 'http' END"])
    cols = ", ".join(f"(NOT official AND {expr}) AS {n}" for n, expr in flags.items())
    return f"""{name}_o AS (SELECT *, {official('host')} AS official FROM {source}),
{name}_f AS (SELECT *, {cols} FROM {name}_o),
{name}_b AS (SELECT *, CAST({total} AS DOUBLE) AS base FROM {name}_f),
{name} AS (SELECT *, least(1.0, least(1.0, base) + CASE WHEN starts_with(lower(url), 'http://') AND base > 0 THEN 0.1 ELSE 0 END) AS score,
  list_filter([{listed}], lambda s: s IS NOT NULL) AS link_signals FROM {name}_b)"""


URL = r"(?i)\b((?:https?://|www\.)[^\s<>\"']+|(?:[a-z0-9-]{1,63}\.){1,10}(?:[a-z]{2,24}|xn--[a-z0-9-]+)(?:/[^\s<>\"']*)?)"


def urls_cte(source: str, name: str = "urls") -> str:
    """`source` (msg_id, text) to msg_id, pos (1-based), url, host; one row per link, first spelling kept."""
    return rf"""{name}_found AS (SELECT msg_id, unnest(u) AS raw, generate_subscripts(u, 1) AS nth
  FROM (SELECT msg_id, regexp_extract_all(text, {q(URL)}, 1) AS u FROM {source})),
{name}_trim AS (SELECT msg_id, nth, rtrim(raw, {q(V.URL_TRAILING)}) AS url FROM {name}_found),
{name}_host AS (SELECT *, {host('url')} AS host FROM {name}_trim),
{name}_kept AS (SELECT * FROM {name}_host WHERE contains(host, '.')
  AND NOT (regexp_full_match(string_split(host, '.')[-1], '\p{{Nd}}+') AND NOT {is_ip('host')})
  AND NOT (NOT regexp_matches(url, '(?i)^(?:https?://|www\.)') AND NOT contains(url, '/') AND string_split(host, '.')[-1] IN {strings(V.FILE_EXTENSIONS)})),
{name}_once AS (SELECT * FROM {name}_kept QUALIFY row_number() OVER (PARTITION BY msg_id, lower(url) ORDER BY nth) = 1),
{name} AS (SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY nth) AS pos, url, host FROM {name}_once)"""


def message_links_ctes(source: str = "messages") -> str:
    return ",\n".join([urls_cte(source), brand_cte("urls"), scored_links_cte("branded")])


# ---------------------------------------------------------------- rules and intent
def rules_cte(source: str, name: str = "hits") -> str:
    """`source` (msg_id, norm, latin) to msg_id, ord, rule, weight, amplifier."""
    tests = " UNION ALL ".join(
        f"SELECT msg_id, {i} AS ord, '{n}' AS rule, CAST({w} AS DOUBLE) AS weight, {str(a).lower()} AS amplifier FROM {source} "
        f"WHERE {either('norm', 'latin', alternatives)}" for i, (n, w, a, alternatives) in enumerate(V.RULES))
    return f"{name} AS MATERIALIZED ({tests})"


def forms_cte(source: str, name: str = "forms") -> str:
    return f"{name} AS MATERIALIZED (SELECT msg_id, norm, {latin('norm')} AS latin FROM (SELECT msg_id, {norm('text')} AS norm FROM {source}))"


def intent_ctes(source: str = "messages") -> str:
    """`source` (msg_id, text) to intents (msg_id, kind, evidence, asks_money)."""
    quoted = r'"[^"]*"|«[^»]*»|“[^”]*”|„[^“”]*[“”]'
    sep = rf"([.!?…]{SPACE}+)|(\n+)"
    ask_text = lambda t: (f"regexp_replace({t}, '(not |n''t |never )(send|pay|transfer|enter|click|tap|install|download|share|open)', "  # noqa: E731
                          "'\\1#', 'g')")
    safe = "|".join(f"(?:{a})" for a in [
        rf"xabar ber[{WORD}]*", rf"murojaat qil[{WORD}]*", rf"qo'ng'iroq qil[{WORD}]*", rf"blok(?:la[{WORD}]*| qil[{WORD}]*)",
        rf"o'chir[{WORD}]*", rf"tekshir[{WORD}]*", "call (?:your|the) bank", "report (?:it|them)"])
    safe_free = "|".join(f"(?:{a})" for a in [
        rf"позвоните[{WORD}]*", rf"обратитесь[{WORD}]*", rf"сообщите в (?:банк|полици[{WORD}]*)"])

    def cleaned(t: str) -> str:
        bounded = rf"(^|[^{WORD}])(?:{safe})"
        return f"regexp_replace(regexp_replace({t}, {q(bounded)}, '\\1 ', 'g'), {q(safe_free)}, ' ', 'g')"

    def tail(t: str) -> str:
        return f"regexp_replace({cleaned(t)}, {q(rf'^(?:.*[^{WORD}])?(?:desa|deyishsa|deyilsa|degan|deb|dedi|deydi|deya|deyish[{WORD}]*)($|[^{WORD}])')}, '\\1')"

    def asks(t: str, ctx: str, suffix: str) -> str:
        return (f"{has(tail(t), V.NEED)} AS need{suffix}, ({has(ask_text(tail(t)), V.ASK_VERB)} AND {has(ctx, V.RISKY_OBJECT)}) AS verb{suffix}, "
                f"{has(ctx, V.MONEY)} AS cash{suffix}")

    past = rf"[{WORD}]{{2,}}(?:di|dim|dik|dilar|ibdi|ibdilar|ishibdi|ishdi|gandi|ganman|ла|ли|ло|ал|ил|ел|ял)"
    verbs = lambda t: (f"len(list_filter(regexp_extract_all({t}, '[{WORD}]+'), lambda w: regexp_full_match(w, {q(past)})))")
    # the look-behind alternative of ASK_VERB begins with a boundary once its look-behinds are gone
    return rf"""i_mark AS (SELECT msg_id, regexp_replace(text, {q(sep)}, '\1\2{MARK}', 'g') AS raw FROM {source}),
i_blank AS (SELECT msg_id, raw, array_to_string(list_transform(list_zip(string_split_regex(raw, {q(quoted)}), regexp_extract_all(raw, {q(quoted)})),
  lambda z: z[1] || regexp_replace(coalesce(z[2], ''), '[^{MARK}]', ' ', 'g')), '') AS blank FROM i_mark),
i_pieces AS (SELECT msg_id, unnest(string_split(raw, '{MARK}')) AS raw, unnest(string_split(blank, '{MARK}')) AS blank,
  generate_subscripts(string_split(raw, '{MARK}'), 1) AS nth FROM i_blank),
i_norm AS (SELECT msg_id, nth, raw, {norm('raw')} AS n, {norm('blank')} AS m FROM i_pieces),
i_sent AS (SELECT *, {latin('n')} AS nl, {latin('m')} AS ml FROM i_norm WHERE n <> ''),
i_prev AS (SELECT *, coalesce(lag(m) OVER w, '') AS pm, coalesce(lag(ml) OVER w, '') AS pml FROM i_sent WINDOW w AS (PARTITION BY msg_id ORDER BY nth)),
i_ctx AS MATERIALIZED (SELECT *, trim(pm || ' ' || m) AS cm, trim(pml || ' ' || ml) AS cml FROM i_prev),
i_flag AS MATERIALIZED (SELECT msg_id, nth, raw, m <> ml AS two, n <> nl AS two_raw,
  {either('n', 'nl', V.QUOTE)} AS quote, {either('n', 'nl', V.WARNING)} OR ({either('n', 'nl', V.TELL_NOT)} AND {either('n', 'nl', V.SECRET)}) AS warning,
  {either('m', 'ml', V.WHO)} AND {either('m', 'ml', V.PAST)} AS report,
  {asks('m', 'cm', '1')}, {asks('ml', 'cml', '2')}, {asks('n', 'n', '3')}, {asks('nl', 'nl', '4')} FROM i_ctx),
i_judge AS (SELECT msg_id, nth, raw, quote, warning, report, (need1 OR verb1) OR (two AND (need2 OR verb2)) AS request,
  CASE WHEN need1 OR verb1 THEN need1 OR cash1 WHEN two AND (need2 OR verb2) THEN need2 OR cash2 ELSE false END AS money,
  CASE WHEN need3 OR verb3 THEN need3 OR cash3 WHEN two_raw AND (need4 OR verb4) THEN need4 OR cash4 ELSE false END AS raw_money FROM i_flag),
i_first AS (SELECT msg_id, min_by(raw, nth) FILTER (quote) AS q, min_by(raw, nth) FILTER (request) AS r, min_by(money, nth) FILTER (request) AS rm,
  min_by(raw, nth) FILTER (warning) AS w, min_by(raw, nth) FILTER (report) AS p, min_by(raw, nth) AS head, bool_or(raw_money) AS qm FROM i_judge GROUP BY msg_id),
i_whole AS (SELECT msg_id, {norm(f"replace(blank, '{MARK}', ' ')")} AS m FROM i_blank),
i_verbs AS (SELECT msg_id, greatest({verbs('m')}, {verbs(latin('m'))}) AS past FROM i_whole),
i_told AS (SELECT f.*, coalesce(p, CASE WHEN r IS NULL AND v.past >= {V.NARRATIVE_PAST_VERBS} THEN head END) AS told FROM i_first f JOIN i_verbs v USING (msg_id)),
i_kind AS (SELECT msg_id, CASE WHEN q IS NOT NULL THEN 'quote' WHEN r IS NOT NULL THEN 'request' WHEN w IS NOT NULL THEN 'warning' WHEN told IS NOT NULL THEN 'report' ELSE 'info' END AS kind,
  coalesce(q, r, w, told, '') AS said, CASE WHEN q IS NOT NULL THEN qm WHEN r IS NOT NULL THEN rm ELSE false END AS asks_money FROM i_told),
intents AS (SELECT msg_id, kind, {snippet('said')} AS evidence, asks_money FROM i_kind)"""


def verdict_ctes(proba: str = "CAST(NULL AS DOUBLE)") -> str:
    """messages (msg_id, text, …) to verdicts (msg_id, score, level, signals list, …)."""
    return f"""{forms_cte('messages')},
{rules_cte('forms')},
{message_links_ctes('messages')},
link_sum AS (SELECT msg_id, max(score) AS link_score, flatten(list(link_signals ORDER BY pos)) AS link_signals FROM scored GROUP BY msg_id),
{intent_ctes('messages')},
core AS (SELECT msg_id, bool_or(NOT amplifier) AS core FROM hits GROUP BY msg_id),
counted AS (SELECT h.* FROM hits h JOIN core USING (msg_id) LEFT JOIN link_sum USING (msg_id)
  WHERE NOT h.amplifier OR core.core OR coalesce(link_score, 0) > 0),
rule_sum AS (SELECT msg_id, 1 - product(1 - weight) AS rule_score, list(rule ORDER BY weight DESC, amplifier, ord) AS rules FROM counted GROUP BY msg_id),
parts AS (SELECT m.msg_id, i.kind, i.evidence, i.asks_money, i.kind IN ('warning', 'report') AS mention, coalesce(rule_score, 0) AS rs0,
  coalesce(link_score, 0) AS link_score, coalesce(rules, []) AS rules, coalesce(link_signals, []) AS link_signals, {proba} AS p
  FROM messages m JOIN intents i USING (msg_id) LEFT JOIN rule_sum USING (msg_id) LEFT JOIN link_sum USING (msg_id)),
weighed AS (SELECT *, CASE WHEN mention THEN rs0 * {V.MENTION_WEIGHT} ELSE rs0 END AS rule_score,
  CASE WHEN mention OR p IS NULL OR p < {V.MODEL_MIN} THEN 0 ELSE {V.SUSPICIOUS_AT} + (p - {V.MODEL_MIN}) / 0.25 * 0.15 END AS m FROM parts),
fused AS (SELECT *, 1 - (1 - rule_score) * (1 - link_score) * (1 - m) AS s_all, 1 - (1 - rule_score) * (1 - link_score) AS s_hard FROM weighed),
leveled AS (SELECT *, s_all >= 0.65 AND s_hard < 0.65 AS model_only FROM fused),
asked AS (SELECT *, CASE WHEN model_only THEN 'suspicious' WHEN s_all >= 0.65 THEN 'dangerous' WHEN s_all >= 0.35 THEN 'suspicious' ELSE 'safe' END AS lv,
  CASE WHEN model_only THEN least(s_all, 0.64) ELSE s_all END AS sc FROM leveled),
context AS (SELECT *, lv = 'safe' AND asks_money AND kind IN ('request', 'quote') AS needs_context FROM asked),
verdicts AS (SELECT msg_id, kind, evidence, asks_money, rule_score, link_score, needs_context, rules AS counted_rules,
  CASE WHEN needs_context THEN greatest(sc, 0.35) ELSE sc END AS score, CASE WHEN needs_context THEN 'suspicious' ELSE lv END AS level,
  list_concat(list_concat(CASE WHEN mention THEN [] ELSE rules END, link_signals),
    list_concat(CASE WHEN m > 0 THEN ['ai_model'] ELSE [] END, CASE WHEN needs_context THEN ['needs_context'] ELSE [] END)) AS signals FROM context)"""


# ---------------------------------------------------------------- derived tables
MESSAGES = (
    "messages AS (SELECT doc_id AS msg_id, doc_id % 97 AS sender_id, doc_id % 13 AS chat_id, "
    "make_timestamp((1704067200 + (doc_id * 37 % 43200) * 60) * 1000000) AS ts, "
    f"text || ' ' || {array(PHRASES)}[doc_id % {len(PHRASES)} + 1] AS text FROM documents)")
LINKS = (
    f"moved AS (SELECT page_id, url, {array(HOSTS)}[page_id % {len(HOSTS)} + 1] AS h FROM pages), "
    "links AS (SELECT page_id, CASE WHEN h = '' THEN url ELSE regexp_extract(url, '^(https?://)', 1) || h || "
    "regexp_replace(url, '^https?://[^/?#]*', '') || CASE WHEN page_id % 5 = 0 THEN '.apk' ELSE '' END END AS url FROM moved)")
EVENTS = ("e AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)")
CHECKS = EVENTS + ", " + (
    "checks0 AS (SELECT *, CASE event_type WHEN 'error' THEN 'dangerous' WHEN 'purchase' THEN 'suspicious' ELSE 'safe' END AS level, "
    f"string_split({array(SIGNAL_SETS)}[k % {len(SIGNAL_SETS)} + 1], ',') AS signals, "
    "CASE WHEN k % 7 = 0 THEN 'shop' || k || '.click.uz' ELSE 'site' || k || '.xyz' END AS domain FROM e), "
    "checks AS (SELECT event_id, ts, user_id AS person, level, signals, domain, value > 60 AS confirmed, "
    "CASE WHEN event_id % 11 = 0 THEN 'web' ELSE 'bot' END AS channel FROM checks0)")
REPORTS = EVENTS + ", " + (
    "reports AS (SELECT 'ind' || k AS ind, ['site', 'phone', 'tg'][k % 3 + 1] AS kind, "
    "CASE WHEN k % 2 = 0 THEN 'site' || k || '.xyz' ELSE 'sites.google.com/view/p' || k END AS preview, "
    "CAST(user_id AS VARCHAR) AS reporter, ts FROM e WHERE event_type IN ('click', 'error'))")


def select(ctes: list[str] | str, body: str) -> str:
    parts = [ctes] if isinstance(ctes, str) else ctes
    return "WITH " + ",\n".join(parts) + "\n" + body
