"""Online evidence, given as tables of lookup answers (JSON text), merged into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions import hosts as H
from wardlight.functions.patterns import noisy_or_agg

RDAP = "struct<events:array<struct<eventAction:string,eventDate:string>>>"
LISTED = "struct<matches:array<struct<threatType:string,threat:struct<url:string>>>>"
VOTES = "struct<data:struct<attributes:struct<last_analysis_stats:map<string,bigint>>>>"


def lookup_candidates(links: DataFrame, message: str = "msg_id", pos: str = "pos") -> DataFrame:
    """What to ask about per message: the first 5 links and the first 3 domains that are neither official nor IPs.

    `links` has one row per link (message, pos, url, host, official). Per-message lists are short arrays, so
    ranking happens inside the row group of one message, never across messages.
    """
    asked = links.filter(~F.col("official") & (F.col("host") != "") & ~H.is_ip(F.col("host")))
    by_message = Window.partitionBy(message).orderBy(pos)
    ranked = asked.select(
        message, pos, H.public_url(F.col("url")).alias("url"), H.lookup_domain(F.col("host")).alias("domain"),
        F.row_number().over(by_message).alias("url_rank"))
    first = Window.partitionBy(message, "domain").orderBy(pos)
    new_domain = F.when(F.row_number().over(first) == 1, 1).otherwise(0)
    ranked = ranked.withColumn("new_domain", new_domain).withColumn("domain_rank", F.sum("new_domain").over(by_message))
    return ranked.select(
        message, pos, "url", "domain",
        (F.col("url_rank") <= V.LOOKUP_URLS).alias("ask_url"),
        ((F.col("new_domain") == 1) & (F.col("domain_rank") <= V.LOOKUP_DOMAINS)).alias("ask_domain"),
    ).filter("ask_url OR ask_domain")


def registered_at(answer: Column) -> Column:
    """Registration time from a registry answer; NULL when absent or unreadable."""
    events = F.from_json(answer, RDAP)["events"]
    named = F.filter(events, lambda e: (e["eventAction"] == "registration") & (F.coalesce(e["eventDate"], F.lit("")) != ""))
    return F.try_to_timestamp(F.get(named, F.lit(0))["eventDate"])


def domain_age_findings(answers: DataFrame, as_of: Column, answer: str = "rdap") -> DataFrame:
    """Adds age_days, evidence and signals; young domains are a red flag, old or unknown ones are nothing."""
    created = registered_at(F.col(answer))
    seconds = as_of.cast("timestamp").cast("double") - created.cast("double")
    days = F.greatest(F.lit(0), F.floor(seconds / V.DAY_SECONDS)).cast("int")
    dated = answers.withColumn("age_days", F.when(created.isNotNull(), days))
    very_new = F.col("age_days") < V.VERY_NEW_DOMAIN_DAYS
    new = F.col("age_days") < V.NEW_DOMAIN_DAYS
    return (dated
            .withColumn("evidence", F.when(very_new, V.VERY_NEW_WEIGHT).when(new, V.NEW_WEIGHT).otherwise(0.0))
            .withColumn("signals", F.array_compact(F.array(F.when(very_new, "domain_very_new").when(new, "domain_new"))))
            .withColumn("confirmed", F.array().cast("array<string>")))


def blocklist_service_findings(answers: DataFrame, answer: str = "listed") -> DataFrame:
    """Any match on the list is strong evidence and confirms the domains it names."""
    matches = F.coalesce(F.from_json(F.col(answer), LISTED)["matches"], F.array().cast(
        "array<struct<threatType:string,threat:struct<url:string>>>"))
    hosts = F.filter(F.transform(matches, lambda m: H.host_of(F.coalesce(m["threat"]["url"], F.lit("")))), lambda h: h != "")
    return (answers.withColumn("_m", matches)
            .withColumn("evidence", F.when(F.size("_m") > 0, V.LISTED_WEIGHT).otherwise(0.0))
            .withColumn("signals", F.array_compact(F.array(F.when(F.size("_m") > 0, "google_safe_browsing"))))
            .withColumn("confirmed", F.array_distinct(F.transform(hosts, H.lookup_domain))).drop("_m"))


def engine_vote_findings(answers: DataFrame, answer: str = "votes", domain: str | None = "domain") -> DataFrame:
    """Two engines or more settle it, one is a hint. Adds bad, total, evidence, signals, confirmed."""
    stats = F.from_json(F.col(answer), VOTES)["data"]["attributes"]["last_analysis_stats"]
    bad = F.coalesce(stats["malicious"], F.lit(0))
    total = F.aggregate(F.coalesce(F.map_values(stats), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"),
                        lambda a, v: a + F.coalesce(v, F.lit(0)))
    none = F.array().cast("array<string>")
    confirmed = F.when(bad >= 2, F.array(F.col(domain))).otherwise(none) if domain else none
    return (answers.withColumn("bad", bad).withColumn("total", total)
            .withColumn("evidence", F.when(F.col("bad") >= 2, V.LISTED_WEIGHT).when(F.col("bad") == 1, V.SINGLE_ENGINE_WEIGHT)
                        .otherwise(0.0))
            .withColumn("signals", F.array_compact(F.array(F.when(F.col("bad") > 0, "virustotal"))))
            .withColumn("confirmed", confirmed))


def merge_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """Noisy-or of the evidence, signals in check order, distinct confirmed domains, per key.

    The checks of one key are few kinds times few domains, so identical findings are folded first and the
    gathered lists stay short whatever the number of rows.
    """
    folded = findings.groupBy(*keys, "check", "signals", "confirmed", "evidence").agg(F.lit(1).alias("_one"))
    ordered = F.array_sort(F.collect_list(F.struct("check", "signals", "confirmed")))
    return folded.groupBy(*keys).agg(noisy_or_agg(F.col("evidence")).alias("evidence"), ordered.alias("_all")).select(
        *keys, "evidence",
        F.flatten(F.transform("_all", lambda x: x["signals"])).alias("signals"),
        F.array_distinct(F.flatten(F.transform("_all", lambda x: x["confirmed"]))).alias("confirmed"))


def latest_valid_lookup(messages: DataFrame, lookups: DataFrame, key: str = "domain", ts: str = "ts",
                        answer: str = "answer", hours: int = V.LOOKUP_TTL_HOURS, salts: int = 8) -> DataFrame:
    """Adds looked_up_at and the answer of the newest successful lookup younger than `hours` (NULL if none).

    An as-of join without a join: both tables are laid on one time line and each message takes the last
    lookup before it. The line of a key is cut into slots as long as the answer lives, each lookup also
    standing in the following slot, and messages of a slot are salted, so a hot domain is many small groups.
    """
    life = hours * 3600
    slot = F.floor(F.col(ts).cast("timestamp").cast("double") / life)
    ok = lookups.filter(F.col(answer).isNotNull()).select(
        key, F.col(ts).cast("timestamp").alias("_at"), F.col(answer).alias("_answer"))
    # one answer per key and instant, so equal copies of a lookup cost nothing
    ok = ok.groupBy(key, "_at").agg(F.max("_answer").alias("_answer"))
    placed = ok.select(key, F.col("_at").alias("_t"), F.struct("_at", "_answer").alias("_lookup"), F.lit(0).alias("_is_message"),
                       F.explode(F.array(F.floor(F.col("_at").cast("double") / life),
                                         F.floor(F.col("_at").cast("double") / life) + 1)).alias("_slot"),
                       ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    columns = messages.columns
    asked = messages.select(
        F.col(key), F.col(ts).cast("timestamp").alias("_t"), F.lit(1).alias("_is_message"), slot.alias("_slot"),
        F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int").alias("_salt"), F.struct(*columns).alias("_row"))
    line = asked.unionByName(placed, allowMissingColumns=True)
    w = (Window.partitionBy(key, "_slot", "_salt").orderBy("_t", "_is_message")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = line.withColumn("_last", F.last("_lookup", ignorenulls=True).over(w)).filter("_is_message = 1")
    fresh = F.col("_t").cast("double") - F.col("_last._at").cast("double") < life
    return seen.select("_row.*", F.when(fresh, F.col("_last._at")).alias("looked_up_at"),
                       F.when(fresh, F.col("_last._answer")).alias(answer))
