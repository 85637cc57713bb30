"""Queries over texts and links."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions import hosts as H
from wardlight.functions import text as X
from wardlight.functions.staging import stage
from wardlight.operators import curation, intent, links, rules
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.catalog import query

SALT = "pepper"


@query("normalize_text", f"SELECT doc_id, {S.norm('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query("translit_latin", S.select(S.MESSAGES, f"SELECT msg_id, latin, CASE WHEN latin = norm THEN 1 ELSE 2 END AS n_variants FROM (SELECT msg_id, norm, {S.latin('norm')} AS latin FROM (SELECT msg_id, {S.norm('text')} AS norm FROM messages))"))
def translit_latin(spark, d):
    v = X.variants(F.col("text"))
    return D.messages(spark, d).select("msg_id", v.alias("v")).select(
        "msg_id", F.element_at("v", -1).alias("latin"), F.size("v").alias("n_variants"))


@query("mask_private", S.select(S.MESSAGES, f"SELECT msg_id, {S.mask('text')} AS masked FROM messages"))
def mask_private(spark, d):
    return D.messages(spark, d).select("msg_id", X.mask_private(F.col("text")).alias("masked"))


@query("mask_for_dataset", S.select(S.MESSAGES, f"SELECT msg_id, {S.mask_dataset('text')} AS masked FROM messages"))
def mask_for_dataset(spark, d):
    return D.messages(spark, d).select("msg_id", X.mask_for_dataset(F.col("text")).alias("masked"))


@query("content_fingerprint", f"SELECT doc_id, {S.fingerprint('text')} AS fp FROM documents")
def content_fingerprint(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.content_fingerprint(F.col("text")).alias("fp"))


@query("fingerprint_dedup", f"SELECT fp, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, {S.fingerprint('text')} AS fp FROM documents) GROUP BY fp")
def fingerprint_dedup(spark, d):
    return D.table(spark, d, "documents").groupBy(X.content_fingerprint(F.col("text")).alias("fp")).agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("holdout_split", f"SELECT split, count(*) AS n FROM (SELECT {S.split_of('fp')} AS split FROM (SELECT {S.fingerprint('text')} AS fp FROM documents)) GROUP BY split")
def holdout_split(spark, d):
    fp = X.content_fingerprint(F.col("text"))
    return D.table(spark, d, "documents").groupBy(X.holdout_split(fp).alias("split")).agg(F.count("*").alias("n"))


@query("new_only", f"""WITH k AS (SELECT DISTINCT {S.fingerprint('text')} AS fp FROM benchmark WHERE text <> ''),
d AS (SELECT doc_id, {S.fingerprint('text')} AS fp FROM documents)
SELECT min(doc_id) AS doc_id, fp FROM d WHERE fp NOT IN (SELECT fp FROM k) GROUP BY fp""")
def new_only(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text")
    return curation.new_only(docs, D.table(spark, d, "benchmark"), ["doc_id"]).select("doc_id", "fp")


@query("curate", f"""WITH k AS (SELECT DISTINCT {S.fingerprint('text')} AS fp FROM benchmark WHERE text <> ''),
m AS (SELECT doc_id, {S.mask_dataset('text')} AS text FROM documents),
f AS (SELECT doc_id, text, {S.fingerprint('text')} AS fp FROM m WHERE length(regexp_replace(text, '[^{S.WORD}]', '', 'g')) >= {V.MIN_CONTENT_CHARS})
SELECT min(doc_id) AS doc_id, fp, {S.split_of('fp')} AS split FROM f WHERE fp NOT IN (SELECT fp FROM k) GROUP BY fp""")
def curate(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text")
    return curation.curate(docs, D.table(spark, d, "benchmark"), ["doc_id"]).select("doc_id", "fp", "split")


@query("salted_fingerprint", f"SELECT event_id, substr(sha256('{SALT}' || user_id), 1, 32) AS fp, substr(sha256('{SALT}' || event_type || ':' || props), 1, 32) AS ind FROM events")
def salted_fingerprint(spark, d):
    return D.table(spark, d, "events").select(
        "event_id", X.salted_fingerprint(F.col("user_id"), SALT).alias("fp"),
        X.indicator_fingerprint(F.col("event_type"), F.col("props"), SALT).alias("ind"))


_APOS = V.LANGUAGE_APOSTROPHES.replace("'", "''")
_EN = "the|you|your|is|are|to|and|of|for|on|in|at|a|an|be|it|i|my|me|we|our|now|this|that|have|has|will|please|from|with".split("|")
_RU = "и|в|не|на|что|вы|ваш|ваша|вам|для|по|это|с|у|от|за|как|если|чтобы|я|мы".split("|")
_TOK = f"regexp_extract_all(t, '[{S.WORD}]+')"


def _ends(pattern: str) -> str:
    return f"len(list_filter({_TOK}, lambda w: regexp_matches(w, '[{S.WORD}](?:{pattern})$')))"


@query("guess_lang", S.select([S.MESSAGES, f"""l AS (SELECT msg_id, lower(text) AS t, text FROM messages),
p AS (SELECT msg_id, len(regexp_extract_all(text, '[а-яА-ЯёЁўқғҳЎҚҒҲ]')) AS cyr, length(text) AS n,
 len(regexp_extract_all(t, '[ўқғҳ]')) + {_ends('лар|ни|га|да|дан|нинг|ди|миз|сиз|ингиз|моқда|лик')} AS uz_cyr,
 len(regexp_extract_all(t, '[ыьщё]')) + len(list_filter({_TOK}, lambda w: w IN {S.strings(_RU)})) + {_ends('ть|ие|ия|ий|ый|ой|ую|ешь|ете|ого|ему')} AS ru,
 len(regexp_extract_all(t, '[{S.WORD}]?[og][{_APOS}][{S.WORD}]')) + {_ends('lar|ni|ga|da|dan|ning|di|miz|siz|ingiz|moqda|lik|mi|man|san')} AS uz_lat,
 len(list_filter(regexp_extract_all(t, '[{S.WORD}]+[{_APOS}]?'), lambda w: w IN {S.strings(_EN)}))
 + len(regexp_extract_all(replace(t, ' ', '  '), '(?:^|[^{S.WORD}])(?:don''t|i''ll)(?:$|[^{S.WORD}{_APOS}])')) + {_ends('ing|ed|tion|ly')} AS en FROM l)"""],
    "SELECT msg_id, CASE WHEN cyr > n * 0.2 THEN CASE WHEN ru > uz_cyr THEN 'ru' ELSE 'uz' END WHEN en > uz_lat THEN 'en' ELSE 'uz' END AS guessed FROM p"))
def guess_lang(spark, d):
    return D.messages(spark, d).select("msg_id", X.guess_lang(F.col("text")).alias("guessed"))


@query("detect_script", S.select(S.MESSAGES, """SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), '[а-яёўқғҳ]') THEN
 CASE WHEN regexp_matches(lower(text), '[a-z]') THEN 'mixed' WHEN regexp_matches(lower(text), '[ўқғҳ]') THEN 'cyrl' ELSE 'ru' END ELSE 'latn' END AS script FROM messages) GROUP BY script"""))
def detect_script(spark, d):
    return D.messages(spark, d).groupBy(X.detect_script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


_HTML5 = "MAP {" + ", ".join(f"'{name}': {' || '.join(f'chr({ord(c)})' for c in value)}" for name, value in html5.items()) + "}"
_LOOSE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@query("strip_tags", rf"""WITH names AS (SELECT {_HTML5} AS known),
p AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages),
r AS (SELECT page_id, string_split_regex(t, '&[A-Za-z][A-Za-z0-9]*;?') AS between, regexp_extract_all(t, '&[A-Za-z][A-Za-z0-9]*;?') AS refs FROM p),
d AS (SELECT page_id, between, list_transform(refs, lambda x: coalesce(known[x[2:]], known[nullif(regexp_extract(x[2:], '^(?:{_LOOSE})'), '')]
 || substr(x, length(regexp_extract(x[2:], '^(?:{_LOOSE})')) + 2), x)) AS said FROM r, names)
SELECT page_id, {S.strip("array_to_string(list_transform(between, lambda b, i: b || coalesce(said[i], '')), '')")} AS plain FROM d""")
def strip_tags(spark, d):
    return D.table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


@query("ocr_clean", rf"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '([{S.WORD}])-{S.SPACE}*\n{S.SPACE}*([{S.WORD}])', '\1-\2', 'g'), '\n'),
 lambda x: {S.strip('x')}), lambda x: len(regexp_extract_all(x, '[{S.WORD}]')) >= 3), chr(10)) AS clean FROM documents""")
def ocr_clean(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.clean_ocr_text(F.col("text")).alias("clean"))


_HOST = rf"(?i)\b(?:[{S.WORD}-]+\.){{1,126}}[a-z]{{2,}}\b"


@query("defang_text", S.select(S.LINKS, f"""SELECT page_id, array_to_string(list_transform(string_split_regex('see ' || url || ' now', '{_HOST}'),
 lambda piece, i: piece || coalesce(replace(regexp_extract_all('see ' || url || ' now', '{_HOST}')[i], '.', '[.]'), '')), '') AS defanged FROM links"""))
def defang_text(spark, d):
    return D.links(spark, d).select("page_id", X.defang_text(F.concat(F.lit("see "), F.col("url"), F.lit(" now"))).alias("defanged"))


@query("defang_hosts", S.select(S.LINKS, r"SELECT page_id, replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', '[.]') AS defanged_host FROM links"))
def defang_hosts(spark, d):
    return D.links(spark, d).select(
        "page_id", X.defang(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("defanged_host"))


@query("encoder_text", f"SELECT doc_id, {S.squeeze(S.mask('text'))} AS encoder_text FROM documents")
def encoder_text(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.encoder_text(F.col("text")).alias("encoder_text"))


@query("min_content", f"SELECT conv_id, turn FROM conversations WHERE length(regexp_replace(text, '[^{S.WORD}]', '', 'g')) >= {V.MIN_CONTENT_CHARS}")
def min_content(spark, d):
    return D.table(spark, d, "conversations").filter(X.has_min_content(F.col("text"))).select("conv_id", "turn")


@query("url_parts", S.select([S.LINKS, f"h AS (SELECT page_id, url, {S.host('url')} AS host FROM links)"],
       f"""SELECT page_id, host, {S.is_ip('host')} AS ip, {S.domain('host')} AS domain, {S.lookup_domain('host')} AS lookup_domain,
 {S.official('host')} AS official, regexp_replace(url, '[?#].*$', '') || CASE WHEN regexp_matches(url, '^https?://[^/?#]*/') THEN '' ELSE '/' END AS public_url FROM h"""))
def url_parts(spark, d):
    df = D.links(spark, d).withColumn("host", H.host_of(F.col("url")))
    h = F.col("host")
    return df.select("page_id", "host", H.is_ip(h).alias("ip"), H.registered_domain(h).alias("domain"),
                     H.lookup_domain(h).alias("lookup_domain"), H.is_official(h).alias("official"),
                     H.public_url(F.col("url")).alias("public_url"))


@query("host_words", S.select([S.LINKS, f"h AS (SELECT page_id, {S.host('url')} AS host FROM links)"],
       f"SELECT page_id, array_to_string({S.words('host')}, ' ') AS words FROM h"))
def host_words(spark, d):
    return D.links(spark, d).select("page_id", F.array_join(H.host_words(H.host_of(F.col("url"))), " ").alias("words"))


@query("brand_lookalike", S.select([S.LINKS, f"h AS (SELECT page_id, {S.host('url')} AS host FROM links)", S.brand_cte("h")],
       "SELECT page_id, host, brand FROM branded WHERE brand IS NOT NULL"))
def brand_lookalike(spark, d):
    df = D.links(spark, d).withColumn("host", H.host_of(F.col("url")))
    brand = F.when(~H.is_official(F.col("host")), H.imitated_brand(F.col("host")))
    return df.select("page_id", "host", brand.alias("brand")).filter(F.col("brand").isNotNull())


@query("link_score", S.select([S.LINKS, f"h AS (SELECT page_id, url, {S.host('url')} AS host FROM links)", S.brand_cte("h"), S.scored_links_cte("branded")],
       "SELECT page_id, official, round(score, 6) AS score, array_to_string(link_signals, ',') AS signals FROM scored"))
def link_score(spark, d):
    return links.score_links(D.links(spark, d)).select(
        "page_id", "official", F.round("score", 6).alias("score"), F.array_join("signals", ",").alias("signals"))


@query("extract_urls", S.select([S.MESSAGES, S.urls_cte("messages")], "SELECT msg_id, pos - 1 AS pos, url, host FROM urls"))
def extract_urls(spark, d):
    return D.messages(spark, d).select("msg_id", F.posexplode(links.urls_in(F.col("text"))).alias("pos", "u")).select(
        "msg_id", F.col("pos").cast("long").alias("pos"), "u.url", "u.host")


@query("message_link_score", S.select([S.MESSAGES, S.message_links_ctes()],
       f"""SELECT m.msg_id, round(coalesce(max(score), 0), 6) AS link_score, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN score >= 0.7 AND NOT official
 AND NOT {S.official(S.without_www('host'))} AND {S.without_www('host')} NOT IN {S.strings(V.SHORTENERS)} THEN {S.domain(S.without_www('host'))} END))), ','), '') AS domains
 FROM messages m LEFT JOIN scored USING (msg_id) GROUP BY m.msg_id"""))
def message_link_score(spark, d):
    found = D.messages(spark, d).select("msg_id", links.message_links(F.col("text")).alias("links"))
    return found.select("msg_id", F.round(links.message_link_score(F.col("links")), 6).alias("link_score"),
                        F.array_join(F.array_sort(links.scam_domains(F.col("links"))), ",").alias("domains"))


@query("rule_hits", S.select([S.MESSAGES, S.forms_cte("messages"), S.rules_cte("forms")], "SELECT msg_id, rule, weight, amplifier FROM hits"))
def rule_hits(spark, d):
    hits = rules.match_rules(D.messages(spark, d)).select("msg_id", F.inline_outer("hits"))
    return hits.filter(F.col("rule").isNotNull())


@query("noisy_or", S.select([S.MESSAGES, S.forms_cte("messages"), S.rules_cte("forms"), S.message_links_ctes(),
       "ls AS (SELECT msg_id, max(score) AS s FROM scored GROUP BY msg_id)", "c AS (SELECT msg_id, bool_or(NOT amplifier) AS core FROM hits GROUP BY msg_id)"],
       """SELECT h.msg_id, round(1 - product(1 - weight), 6) AS rule_score, count(*) AS n FROM hits h JOIN c USING (msg_id) LEFT JOIN ls USING (msg_id)
 WHERE NOT amplifier OR core OR coalesce(s, 0) > 0 GROUP BY h.msg_id"""))
def noisy_or(spark, d):
    df = stage(rules.match_rules(D.messages(spark, d)), {"links": links.message_links(F.col("text"))})
    df = stage(df, {"counted": rules.counted_hits(F.col("hits"), links.message_link_score(F.col("links")))})
    return df.filter(F.size("counted") > 0).select(
        "msg_id", F.round(rules.rule_score(F.col("counted")), 6).alias("rule_score"), F.size("counted").cast("long").alias("n"))


@query("split_sentences", rf"""WITH m AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?…]{S.SPACE}+)|(\n+)', '\1\2{S.MARK}', 'g'), '{S.MARK}')) AS s FROM documents)
SELECT doc_id, count(*) AS n, max(length(regexp_replace(s, '{S.SPACE}+$', ''))) AS longest FROM m WHERE {S.strip('s')} <> '' GROUP BY doc_id""")
def split_sentences(spark, d):
    return intent.split_sentences(D.table(spark, d, "documents"), "text", "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query("intent_detect", S.select([S.MESSAGES, S.intent_ctes()], "SELECT msg_id, kind, evidence, asks_money FROM intents"))
def intent_detect(spark, d):
    return intent.detect_intent(D.messages(spark, d)).select("msg_id", "intent.kind", "intent.evidence", "intent.asks_money")
