"""Queries run as streams over the driver's tables until all their rows are read; results equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.plans import aggregate_queries as A
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.catalog import ORACLES, query
from wardlight.plans.message_queries import _flat
from wardlight.session import STATE_STORE, shared_folder, staged
from wardlight.streaming import jobs, people, state


def _work(spark, name: str) -> str:
    """A fresh folder for one run, in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(spark, d: str, name: str, build) -> DataFrame:
    """`build` (a function of datasets) over `name` read as a stream of files."""
    return build(spark, d, D.table_stream(spark, d, name))


def _collected(spark, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into a table and reads it back."""
    path = _work(spark, name)
    stream.writeStream.outputMode(mode).format("parquet").option("path", path + "/out").option(
        "checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


def _checks(spark, d):
    return _as_stream(spark, d, "events", D.checks_from)


@query("stream_daily_counts", ORACLES["daily_counts"])
def stream_daily_counts(spark, d):
    path = _work(spark, "daily")
    jobs.maintain_totals(jobs.daily_count_stream(_checks(spark, d)), path + "/out", path + "/checkpoint").awaitTermination()
    return jobs.read_totals(spark, path + "/out", ["day"])


@query("stream_daily_categories", ORACLES["daily_categories"])
def stream_daily_categories(spark, d):
    path = _work(spark, "categories")
    jobs.maintain_totals(jobs.daily_category_stream(_checks(spark, d)), path + "/out", path + "/checkpoint").awaitTermination()
    return jobs.read_totals(spark, path + "/out", ["day", "category"])


@query("stream_flagged_domains", ORACLES["flagged_domains"])
def stream_flagged_domains(spark, d):
    path = _work(spark, "flagged")
    jobs.maintain_flagged_domains(_checks(spark, d), path + "/out", path + "/checkpoint").awaitTermination()
    jobs.compact_totals(spark, path + "/out", ["domain"], path + "/compact")
    return jobs.read_totals(spark, path + "/compact", ["domain"])


@query("stream_scored", ORACLES["score_messages"])
def stream_scored(spark, d):
    messages = _as_stream(spark, d, "documents", D.messages_from)
    return _flat(_collected(spark, jobs.score_stream(messages), "scored"))


@query("stream_wave_dedupe", f"SELECT count(DISTINCT {S.fingerprint('text')}) AS waves FROM documents")
def stream_wave_dedupe(spark, d):
    docs = _as_stream(spark, d, "documents", lambda s, p, source: source.select(
        "doc_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1440 * 60).alias("ts")))   # all within one day
    return _collected(spark, jobs.drop_wave_copies(docs).select("doc_id", "fp"), "waves").agg(F.count("fp").alias("waves"))   # as in SQL, a null text is no wave


@query("stream_newcomers", S.select([S.EVENTS, A._NEW], "SELECT event_id AS msg_id FROM nc JOIN e USING (event_id) WHERE event_type <> 'signup'"))
def stream_newcomers(spark, d):
    e = _as_stream(spark, d, "events", D.events_from).withColumn("chat_id", F.lit(1)).withColumnRenamed("user_id", "sender_id")
    messages = e.filter("event_type <> 'signup'").select(F.col("event_id").alias("msg_id"), "chat_id", "sender_id", "ts")
    other = _as_stream(spark, d, "events", D.events_from).withColumn("chat_id", F.lit(1)).withColumnRenamed("user_id", "sender_id")
    joins = other.filter("event_type = 'signup'").select("chat_id", "sender_id", "ts")
    return _collected(spark, jobs.newcomer_stream(messages, joins), "newcomers").select("msg_id")


def _with_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


@query("stream_rate_limit", ORACLES["rate_limit"])
def stream_rate_limit(spark, d):
    _with_rocksdb(spark)
    limited = state.rate_limit_stream(_as_stream(spark, d, "events", D.events_from), 2, V.DAY_SECONDS, ["user_id"], idle_seconds=None)
    return _collected(spark, limited, "limits").select("event_id", "admitted")


@query("stream_strikes", ORACLES["strikes_with_reset"])
def stream_strikes(spark, d):
    _with_rocksdb(spark)
    e = _as_stream(spark, d, "events", D.events_from).filter("event_type IN ('error', 'signup')").withColumn("undone", F.col("event_type") == "signup")
    return _collected(spark, state.strike_stream(e, ["user_id"], undone="undone", idle_seconds=None), "strikes").select("event_id", "strikes", "mute")


@query("stream_notices", ORACLES["notice_throttle"])
def stream_notices(spark, d):
    _with_rocksdb(spark)
    noticed = state.notice_stream(_as_stream(spark, d, "events", D.events_from), ["event_type"], gap=3600, idle_seconds=None)
    return _collected(spark, noticed, "notices").select("event_id", "notify")


#: Files of a micro-batch, so that it is read by as many tasks.
FILES = 12


@query("stream_feed_domains", ORACLES["feed_domains"])
def stream_feed_domains(spark, d):
    """Checks in four micro-batches to the feed, with the rule of three different people."""
    _with_rocksdb(spark)
    path = _work(spark, "feed")
    checks = D.checks(spark, d)
    checks.repartition(4 * FILES).write.parquet(f"{path}/in")
    source = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    return people.feed_of(people.newest_totals(_collected(spark, people.flagged_people_stream(source), "people")))


_AS_OF = ["2024-01-10", "2024-01-25", "2024-04-05", "2024-04-20"]


@query("stream_report_counts", S.select(S.REPORTS, f"""SELECT a.as_of, ind, count(DISTINCT reporter) AS reporters FROM reports, (SELECT unnest({_AS_OF}) AS as_of) a
WHERE ts >= a.as_of::TIMESTAMP - INTERVAL {V.REPORT_DAYS} DAY AND ts <= a.as_of::TIMESTAMP GROUP BY ALL"""))
def stream_report_counts(spark, d):
    """Reports in three micro-batches, none in order; reporters at several times, some of them forgotten by then."""
    _with_rocksdb(spark)
    path, reports = _work(spark, "reporters"), D.reports(spark, d).select("ind", "reporter", "ts")
    for part in range(3):
        reports.filter(F.pmod(F.xxhash64("ind", "reporter", "ts"), F.lit(3)) == part).repartition(FILES).write.parquet(f"{path}/in/{part}")
    reports.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit("end").alias("ind"), F.lit("end").alias("reporter"), "ts").write.parquet(f"{path}/in/end")
    source = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in/*")
    changes = staged(_collected(spark, people.reporter_changes(source, late="60 days"), "changes").filter("ind <> 'end'"))
    parts = [people.counts_at(changes, F.lit(t).cast("timestamp")).select(F.lit(t).alias("as_of"), "ind", "reporters") for t in _AS_OF]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
