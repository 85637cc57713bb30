"""Sinks: curated splits, training exports, threat feed and radar documents, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.ranks import numbered_in_order

CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
FEED_HEAD = [
    "# Sources: detected automatically (rules + link analysis + online reputation)",
    "#          or reported by at least {threshold} different users.",
    "# Automatic detections can be wrong.",
    "# Do not open these sites.",
    "",
]


def append_split(df: DataFrame, path: str, day: Column) -> None:
    """Adds curated rows (text, label, lang, category, source, split) to the train or holdout folder."""
    df.withColumn("added", day).select(*V.CURATED_COLUMNS, "split").write.mode("append").partitionBy("split").parquet(path)


def training_rows(feedback: DataFrame, candidates: DataFrame) -> DataFrame:
    """Everything collected for training: feedback first, then group messages by repeats."""
    said = feedback.select(
        "text", F.col("label").cast("string").alias("label"), "predicted", F.col("user_agreed").cast("int").cast("string").alias("user_agreed"),
        F.col("ts").cast("string").alias("timestamp"), F.lit("feedback").alias("source"), F.lit(1).cast("long").alias("hits"),
        F.lit(0).alias("_part"), F.col("ts").cast("string").alias("_order"))
    groups = candidates.select(
        "text", F.lit("").alias("label"), F.col("verdict").alias("predicted"), F.lit("").alias("user_agreed"),
        F.col("first_seen").cast("string").alias("timestamp"), F.lit("group").alias("source"), F.col("hits").cast("long").alias("hits"),
        F.lit(1).alias("_part"), F.col("first_seen").cast("string").alias("_order"))
    return said.unionByName(groups).orderBy("_part", F.desc(F.when(F.col("_part") == 1, F.col("hits"))), "_order").drop("_part", "_order")


def export_training_csv(feedback: DataFrame, candidates: DataFrame, path: str) -> None:
    training_rows(feedback, candidates).write.mode("overwrite").options(**CSV).csv(path)


def export_feedback_csv(feedback: DataFrame, path: str) -> None:
    feedback.select("text", "label", "predicted", F.col("user_agreed").cast("int").alias("user_agreed"),
                    F.col("ts").cast("string").alias("timestamp")).write.mode("overwrite").options(**CSV).csv(path)


def feed_lines(feed: DataFrame, title: str, updated: Column, threshold: int = V.REPORT_THRESHOLD) -> DataFrame:
    """(line_no, line): a # header and one domain per line, newest first; lines are numbered over ranges."""
    domains = feed.filter("type = 'domain'").withColumn("n_", F.col("detections") + F.col("reporters"))
    order = [F.desc("last_seen"), F.desc("n_"), F.asc("indicator")]
    head = [F.lit(f"# {title}"), F.concat(F.lit("# Updated: "), updated), F.concat(F.lit("# Domains: "), F.col("n").cast("string")),
            *[F.lit(line.format(threshold=threshold)) for line in FEED_HEAD]]
    top = domains.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(F.array(*head)).alias("line_no", "line"))
    body = numbered_in_order(domains, [], order, "at_").select((F.col("at_") + (len(head) - 1)).cast("int").alias("line_no"), F.col("indicator").alias("line"))
    return top.union(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """(line_no, line) as text files; one after the other in the order of their names they are the whole list."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_feed_text(feed: DataFrame, path: str, title: str, updated: Column) -> None:
    write_lines(feed_lines(feed, title, updated), path)


def _entry() -> Column:
    return F.struct("indicator", "type", F.col("first_seen").cast("string").alias("first_seen"),
                    F.col("last_seen").cast("string").alias("last_seen"), "detections", "reporters", "source")


def feed_json_lines(feed: DataFrame, name: str, updated: Column) -> DataFrame:
    """(line_no, line): the lines of one JSON document, an indicator a line, for a feed of any length."""
    entries = numbered_in_order(feed.select(_entry().alias("e")), [], [F.asc("e")], "at_")
    count = feed.agg(F.count(F.lit(1)).alias("n"))
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    value = lambda c: F.substring(text(c), 6, 1 << 20).substr(F.lit(1), F.length(text(c)) - 6)
    head = F.concat(F.lit('{"name":'), value(F.lit(name)), F.lit(',"updated":'), value(updated), F.lit(',"count":'), F.col("n").cast("string"), F.lit(',"indicators":['))
    ends = count.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), head.alias("line")),
                                          F.struct((F.col("n") + 1).alias("line_no"), F.lit("]}").alias("line")))).alias("x")).select("x.*")
    comma = F.when(F.col("at_") > 1, ",").otherwise("")
    return ends.union(entries.select(F.col("at_").alias("line_no"), F.concat(comma, F.to_json("e")).alias("line")))


def write_feed_json(feed: DataFrame, path: str, name: str, updated: Column) -> None:
    write_lines(feed_json_lines(feed, name, updated), path)


def feed_document(feed: DataFrame, name: str, updated: Column) -> DataFrame:
    """One row with a short feed as JSON: name, updated, count, indicators (sorted by name). `write_feed_json` takes any."""
    entries = F.array_sort(F.collect_list(_entry()))
    return feed.agg(entries.alias("indicators")).select(F.to_json(F.struct(
        F.lit(name).alias("name"), updated.alias("updated"), F.size("indicators").alias("count"), "indicators")).alias("document"))


def radar_document(gated: DataFrame, series: DataFrame, categories: DataFrame, sites: DataFrame, updated: Column,
                   threshold: int = V.REPORT_THRESHOLD) -> DataFrame:
    """One row with the whole public document. It lists the sites it is given: a page that shows a few passes a few."""
    one = F.lit(1).alias("_one")
    text = lambda c: F.col(c).cast("string").alias(c)
    daily = series.agg(F.array_sort(F.collect_list(F.struct(text("day"), "checks", "scams"))).alias("daily")).select("daily", one)
    cats = categories.filter("n > 0").agg(F.sort_array(F.collect_list(F.struct("n", "category")), asc=False).alias("c")).select(
        F.transform("c", lambda x: F.struct(x["category"].alias("id"), x["n"].alias("count"))).alias("categories"), one)
    places = sites.agg(F.sort_array(F.collect_list(F.struct(
        text("last_seen"), "hits", "site", text("first_seen"), "source", "reporters")), asc=False).alias("sites")).select("sites", one)
    joined = gated.withColumn("_one", F.lit(1)).join(daily, "_one").join(cats, "_one").join(places, "_one")
    return joined.select(F.to_json(F.struct(
        updated.alias("updated"), F.col("first_day").cast("string").alias("since"), "totals", "daily", "categories", "sites",
        F.lit(threshold).alias("report_threshold")), {"ignoreNullFields": "false"}).alias("document"))


def write_document(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


MERGES = {"min": F.min, "max": F.max, "sum": F.sum}


def upsert_keyed(existing: DataFrame, delta: DataFrame, keys: list[str], merge: dict[str, str], order: str | None = None) -> DataFrame:
    """Existing rows with a delta folded in: per column min, max, sum, or last (of `order`, the delta winning ties)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.col(order), F.col("_new")) if order else F.col("_new")
    folded = [
        (F.max_by(c, rank) if how == "last" else MERGES[how](c)).alias(c) for c, how in merge.items()]
    return both.groupBy(*keys).agg(*folded)


def purge_expired(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """What retention leaves: members 2 days, group log 30, reports and vectors 90."""
    return df.filter(F.col(ts).cast("timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
