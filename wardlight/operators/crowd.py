"""Crowd evidence: what people report, how many different people, and what follows for a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions import hosts as H
from wardlight.functions.patterns import noisy_or_agg
from wardlight.functions.skew import count_distinct, salted_join
from wardlight.functions.text import indicator_fingerprint, mask_for_dataset, mask_preview, salted_fingerprint
from wardlight.operators.links import urls_in

_INDICATORS = "array<struct<kind:string,value:string,preview:string>>"


def _indicator(kind: str, value: Column, preview: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), preview.alias("preview"))


def site_indicators(text: Column) -> Column:
    """Platforms host other people's pages, so the exact page is meant there; elsewhere the whole domain."""

    def of_link(link: Column) -> Column:
        host, url = link["host"], link["url"]
        short = H.without_www(host)
        platform = (H.is_shortener(host) | host.isin(V.PLATFORMS) | H.registered_domain(host).isin(V.PLATFORMS)
                    | short.isin(V.PLATFORMS))
        at = F.instr(url, host)
        after = F.when(at > 0, F.substr(url, at + F.length(host))).otherwise(url)
        path = F.rtrim(F.substring_index(after, "?", 1), F.lit("/"))
        chat = host.endswith("t.me") | host.endswith("telegram.me")
        page = F.lower(F.concat(short, path))
        domain = H.registered_domain(host)
        return (F.when(platform, F.when((F.length(path) > 1) & ~chat, _indicator("site", page, page)))
                .when(~H.is_official(host), _indicator("site", domain, domain)))

    return F.array_compact(F.transform(urls_in(text), of_link)).cast(_INDICATORS)


def handle_indicators(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + V.HANDLE), F.lit(1)), F.lower)
    kept = F.filter(names, lambda n: ~n.isin([*V.RESERVED_HANDLES, *[i.lower() for i in ignored]]))
    return F.transform(kept, lambda n: _indicator(
        "tg", F.concat(F.lit("@"), n), F.concat(F.lit("@"), mask_preview(n, 3)))).cast(_INDICATORS)


def phone_indicators(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + V.MOBILE), F.lit(0))
    digits = F.transform(found, lambda m: F.right(F.regexp_replace(m, r"(?U)\D", ""), F.lit(9)))
    mobile = F.filter(digits, lambda d: F.left(d, F.lit(2)).isin(V.MOBILE_CODES))
    return F.transform(mobile, lambda d: _indicator(
        "phone", F.concat(F.lit("+998"), d), mask_preview(F.concat(F.lit("+998"), d), 6, 2))).cast(_INDICATORS)


def forward_indicator(sender_id: Column, display: Column) -> Column:
    """The original sender of a forwarded message, by stable id."""
    shown = F.coalesce(display, F.lit(""))
    preview = (F.when(shown.startswith("@"), F.concat(F.lit("@"), mask_preview(F.lower(F.substr(shown, F.lit(2))), 3)))
               .when(shown != "", mask_preview(shown, 3)).otherwise("Telegram"))
    return F.array_compact(F.array(F.when(sender_id.isNotNull(), _indicator("tg", sender_id, preview)))).cast(_INDICATORS)


def message_indicators(text: Column, forward: Column | None = None, ignored: tuple[str, ...] = ()) -> Column:
    parts = [site_indicators(text), handle_indicators(text, ignored), phone_indicators(text)]
    if forward is not None:
        parts.append(forward)
    return F.array_distinct(F.concat(*parts))


def extract_indicators(messages: DataFrame, *keys: str, text: str = "text", forward_id: str | None = None,
                       forward_name: str | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """One row per (message, kind, value, preview); distinct inside the message, so no shuffle."""
    forward = forward_indicator(F.col(forward_id), F.col(forward_name)) if forward_id else None
    found = message_indicators(F.coalesce(F.col(text), F.lit("")), forward, ignored)
    return messages.select(*keys, F.inline_outer(found)).filter(F.col("kind").isNotNull())


def report_rows(indicators: DataFrame, reporter: str, ts: str, salt: str) -> DataFrame:
    """Indicators as report rows: only fingerprints of the value and the person, and a safe preview."""
    return indicators.select(
        indicator_fingerprint(F.col("kind"), F.col("value"), salt).alias("ind"), "kind", "preview",
        salted_fingerprint(F.col(reporter), salt).alias("reporter"), F.col(ts).cast("timestamp").alias("ts"))


def current_reports(reports: DataFrame) -> DataFrame:
    """One row per (indicator, reporter) with the newest time: a repeat only refreshes the date."""
    return reports.groupBy("ind", "reporter").agg(
        F.max("ts").alias("ts"), F.min("kind").alias("kind"), F.min("preview").alias("preview"))


def new_report_counts(reports: DataFrame) -> DataFrame:
    """Per person, how many different indicators they reported."""
    return count_distinct(reports, ["reporter"], "ind", "new_reports")


def within_days(df: DataFrame, as_of: Column, days: int = V.REPORT_DAYS, ts: str = "ts") -> DataFrame:
    """Rows not older than `days`; on a table partitioned by day the same filter prunes partitions."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def reporter_counts(reports: DataFrame, as_of: Column, days: int = V.REPORT_DAYS) -> DataFrame:
    """(ind, reporters): different people in the period; the two-step count keeps a hot indicator even."""
    return count_distinct(within_days(reports, as_of, days), ["ind"], "reporter", "reporters")


def report_weight(reporters: Column) -> Column:
    return (F.when(reporters >= V.STRONG_REPORTS, V.STRONG_WEIGHT).when(reporters >= V.REPORT_THRESHOLD, V.WEAK_WEIGHT)
            .otherwise(0.0))


def crowd_hits(indicators: DataFrame, counts: DataFrame, salt: str, *keys: str) -> DataFrame:
    """Message indicators that enough people reported: keys, kind, preview, reporters, weight.

    Only indicators with weight reach the join, and the message side is salted: one scam site may be in a
    third of all messages.
    """
    known = counts.withColumn("weight", report_weight(F.col("reporters"))).filter("weight > 0")
    asked = indicators.select(*keys, "kind", "preview",
                              indicator_fingerprint(F.col("kind"), F.col("value"), salt).alias("ind"))
    return salted_join(asked, known, ["ind"])


def crowd_weights(hits: DataFrame, key: str) -> DataFrame:
    """(key, crowd_weight): all crowd evidence of a message combined."""
    return hits.groupBy(key).agg(noisy_or_agg(F.col("weight")).alias("crowd_weight"))


def blocked_count(counts: DataFrame, threshold: int = V.REPORT_THRESHOLD) -> DataFrame:
    return counts.filter(F.col("reporters") >= threshold).agg(F.count("*").alias("blocked"))


def community_sites(reports: DataFrame, as_of: Column, threshold: int = V.REPORT_THRESHOLD,
                    limit: int | None = None) -> DataFrame:
    """Sites enough different people reported: preview, first report day, reporters; newest first, `limit` of them or all."""
    people = within_days(reports.filter("kind = 'site'"), as_of).groupBy("ind", "reporter").agg(
        F.min("preview").alias("preview"), F.max("ts").alias("ts"))
    sites = people.groupBy("ind").agg(
        F.min("preview").alias("preview"), F.to_date(F.min("ts")).alias("first_day"),
        F.count("*").alias("reporters"), F.max("ts").alias("last_ts"))
    listed = sites.filter(F.col("reporters") >= threshold).orderBy(F.desc("last_ts"), "preview")
    return listed if limit is None else listed.limit(limit)


def similar_hits(similar: DataFrame, key: str, threshold: int = V.REPORT_THRESHOLD) -> DataFrame:
    """`similar` is (key, reporters); two people who reported nearly the same message are worth one half."""
    return similar.filter(F.col("reporters") >= threshold).select(key, "reporters", F.lit(V.SIMILAR_WEIGHT).alias("weight"))


def report_to_feedback(actions: DataFrame, salt: str) -> dict[str, DataFrame]:
    """Splits user actions (msg_id, user_id, ts, action report|agree|disagree, level, text) into their sinks."""
    flagged = F.col("level") != "safe"
    agrees = F.when(F.col("action") == "report", flagged).otherwise(F.col("action") == "agree")
    label = (F.when(F.col("action") == "report", 1).when(F.col("action") == "agree", flagged.cast("int"))
             .otherwise((~flagged).cast("int")))
    judged = actions.withColumn("label", label).withColumn("user_agreed", agrees)
    feedback = judged.select(
        "msg_id", mask_for_dataset(F.col("text")).alias("text"), "label", F.col("level").alias("predicted"),
        "user_agreed", "ts")
    missed = (F.col("action") == "disagree") & ~flagged
    remembered = judged.filter((F.col("action") == "report") | missed).select(
        "msg_id", salted_fingerprint(F.col("user_id"), salt).alias("reporter"), "ts")
    reported = extract_indicators(judged.filter("action = 'report'"), "msg_id", "user_id", "ts")
    return {"feedback": feedback, "vectors": remembered, "reports": report_rows(reported, "user_id", "ts", salt)}
