"""Public, aggregated views: daily numbers, categories, flagged domains, threat feed.

Facts are append-only checks: (check_id, ts, person, level, signals, domains, confirmed, channel). Every table
here is an aggregate of them, so replays and late files change nothing but the numbers they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions import hosts as H
from wardlight.functions.skew import count_distinct
from wardlight.functions.text import defang


def _asks_context(signals: Column) -> Column:
    return F.array_contains(signals, "needs_context")


def public_level(level: Column, signals: Column) -> Column:
    """A question about a money request is not a detected scam: it counts as safe in public numbers."""
    return F.when(_asks_context(signals), "safe").otherwise(level)


def daily_counts(checks: DataFrame) -> DataFrame:
    """day, checks, safe, suspicious, dangerous."""
    level = public_level(F.col("level"), F.col("signals"))
    return checks.select(F.to_date("ts").alias("day"), level.alias("level")).filter(F.col("level").isin(V.LEVELS)).groupBy(
        "day").agg(F.count("*").alias("checks"), *[F.count_if(F.col("level") == x).alias(x) for x in V.LEVELS])


def primary_category(signals: Column) -> Column:
    """The most specific public category any signal belongs to."""
    chosen = F.lit("other")
    for category, names in reversed(V.CATEGORIES):
        chosen = F.when(F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names])), category).otherwise(chosen)
    return chosen


def daily_categories(checks: DataFrame) -> DataFrame:
    """day, category, n over checks that found something."""
    flagged = checks.filter((F.col("level") != "safe") & ~_asks_context(F.col("signals")))
    return flagged.groupBy(F.to_date("ts").alias("day"), primary_category(F.col("signals")).alias("category")).agg(
        F.count("*").alias("n"))


def domain_sightings(checks: DataFrame) -> DataFrame:
    """One row per check and fake-site domain. Checks from the public web channel never list a domain."""
    found = checks.filter((F.col("level") != "safe") & ~_asks_context(F.col("signals")) & (F.col("channel") != "web"))
    exploded = found.select("ts", "person", "confirmed", F.explode("domains").alias("domain"))
    return exploded.select("domain", F.to_date("ts").alias("day"), "person",
                           F.array_contains("confirmed", F.col("domain")).alias("confirmed"))


def flagged_domains(sightings: DataFrame) -> DataFrame:
    """domain, first_seen, last_seen, hits, confirmed."""
    return sightings.groupBy("domain").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("hits"),
        F.bool_or("confirmed").alias("confirmed"))


def domain_people(sightings: DataFrame) -> DataFrame:
    return count_distinct(sightings, ["domain"], "person", "people")


def flagged_with_people(sightings: DataFrame) -> DataFrame:
    """Both aggregates in one pass: (domain, person) first, which spreads a hot domain, then domain."""
    per_person = sightings.groupBy("domain", "person").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("hits"),
        F.bool_or("confirmed").alias("confirmed"))
    return per_person.groupBy("domain").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits"),
        F.bool_or("confirmed").alias("confirmed"), F.count("person").alias("people"))


def newest(rows: DataFrame, then: list[str], limit: int | None) -> DataFrame:
    """Sorted by last_seen and the two columns after it; a top-k only if asked for."""
    ordered = rows.orderBy(F.desc("last_seen"), F.desc(then[0]), then[1])
    return ordered if limit is None else ordered.limit(limit)


def feed_domains(sightings: DataFrame, min_people: int = V.FEED_MIN_PEOPLE, limit: int | None = None) -> DataFrame:
    """Domains one may publish: confirmed by a service, or seen by enough different people; the newest `limit`, or all."""
    listed = flagged_with_people(sightings).filter(F.col("confirmed") | (F.col("people") >= min_people))
    return newest(listed.select("domain", "first_seen", "last_seen", "hits"), ["hits", "domain"], limit)


def recent_domains(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(flagged.select("domain", "first_seen", "last_seen", "hits"), ["hits", "domain"], limit)


def daily_series(daily: DataFrame, today: Column, days: int = V.TREND_DAYS) -> DataFrame:
    """The last `days` days, zero-filled, oldest first: day, checks, scams."""
    first = F.date_sub(today, days - 1)
    spark = daily.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(first, today)).alias("day"))
    known = daily.filter(F.col("day") >= first).select(
        "day", "checks", (F.col("suspicious") + F.col("dangerous")).alias("scams"))
    return calendar.join(known, "day", "left").select(
        "day", F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("scams", F.lit(0)).alias("scams")).orderBy("day")


def category_counts(daily_cat: DataFrame, since: Column) -> DataFrame:
    return daily_cat.filter(F.col("day") >= since).groupBy("category").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "category")


def totals(daily: DataFrame, people: DataFrame, today: Column) -> DataFrame:
    """One row: first_day, users, checks, suspicious, dangerous, today. `people` has a column person."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    numbers = daily.agg(
        F.min("day").alias("first_day"), zero("checks").alias("checks"), zero("suspicious").alias("suspicious"),
        zero("dangerous").alias("dangerous"), zero(F.when(F.col("day") == today, F.col("checks"))).alias("today"),
    ).withColumn("_one", F.lit(1))
    users = people.select("person").distinct().agg(F.count("person").alias("users")).withColumn("_one", F.lit(1))
    return numbers.join(users, "_one").drop("_one")


def gate_totals(numbers: DataFrame, blocked: DataFrame, minimum: int = V.SHOW_TOTALS_FROM) -> DataFrame:
    """totals struct, NULL until enough checks have been made to hide any single one."""
    joined = numbers.withColumn("_one", F.lit(1)).join(blocked.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.select("first_day", F.when(F.col("checks") >= minimum, F.struct(
        "checks", (F.col("suspicious") + F.col("dangerous")).alias("scams"), "blocked", "users")).alias("totals"))


def threat_feed(feed: DataFrame, community: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged and reported sites merged by name; neither official sites nor shorteners are ever listed.

    Newest first; a publisher who wants a short list gives a `limit`.
    """
    auto = feed.filter(~H.never_listed(F.col("domain"))).select(
        F.col("domain").alias("indicator"), "first_seen", "last_seen", F.col("hits").alias("detections"))
    value = H.without_www(F.lower(F.col("preview")))
    reported = (
        community.select(value.alias("indicator"), "first_day", "reporters", "last_ts")
        .filter((F.col("indicator") != "") & ~H.never_listed(F.substring_index("indicator", "/", 1))
                & ~H.is_shortener(F.col("indicator")))
        .groupBy("indicator").agg(
            F.min("first_day").alias("first_day"),
            # several previews of one site: the newest-first list names the oldest report last
            F.min_by("reporters", "last_ts").alias("reporters"), F.max_by("first_day", "last_ts").alias("newest_day"))
    )
    both = auto.join(reported, "indicator", "full_outer")
    merged = both.select(
        "indicator", F.when(F.col("indicator").contains("/"), "url").otherwise("domain").alias("type"),
        F.least("first_seen", "first_day").alias("first_seen"),
        F.coalesce("last_seen", "newest_day").alias("last_seen"),
        F.coalesce("detections", F.lit(0)).alias("detections"), F.coalesce("reporters", F.lit(0)).alias("reporters"),
        F.when(F.col("detections").isNull(), "community").when(F.col("reporters").isNull(), "auto").otherwise("both").alias("source"))
    return merged.orderBy(F.desc("last_seen"), F.desc(F.col("detections") + F.col("reporters")), "indicator").transform(lambda df: df if limit is None else df.limit(limit))


def radar_sites(recent: DataFrame, community: DataFrame, limit: int | None = None) -> DataFrame:
    """The page's list: defanged, newest first, the first `limit` or all."""
    auto = recent.filter(~H.never_listed(F.col("domain"))).select(
        F.col("domain").alias("key"), "first_seen", "last_seen", "hits")
    reported = community.groupBy(F.col("preview").alias("key")).agg(
        F.max_by("first_day", "last_ts").alias("first_day"), F.min_by("reporters", "last_ts").alias("reporters"))
    both = auto.join(reported, "key", "full_outer")
    sites = both.select(
        defang(F.col("key")).alias("site"), F.coalesce("first_seen", "first_day").alias("first_seen"),
        F.coalesce("last_seen", "first_day").alias("last_seen"), F.coalesce("hits", F.lit(0)).alias("hits"), "reporters",
        F.when(F.col("hits").isNull(), "community").when(F.col("reporters").isNull(), "auto").otherwise("both").alias("source"),
    )
    return newest(sites, ["hits", "site"], limit)
