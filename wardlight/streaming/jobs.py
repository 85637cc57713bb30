"""Streams: scoring, daily counters, flagged-domain upkeep, newcomers, waves, fresh crowd memory.

Scoring is a row expression and runs on a stream unchanged. Everything with state has a watermark of one day, so
state is dropped once no accepted row can need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight import values as V
from wardlight.functions.text import content_fingerprint
from wardlight.operators import radar, textmodel
from wardlight.operators.verdict import score_messages
from wardlight.session import shuffles_dropped

LATE = "1 day"


def score_stream(messages: DataFrame, text: str = "text", proba: str | None = None) -> DataFrame:
    return score_messages(messages, text, proba)


def daily_count_stream(checks: DataFrame, late: str = LATE) -> DataFrame:
    """Tumbling days: day, checks, safe, suspicious, dangerous."""
    level = radar.public_level(F.col("level"), F.col("signals"))
    return (
        checks.filter(F.col("level").isin(V.LEVELS)).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("checks"), *[F.count_if(level == x).alias(x) for x in V.LEVELS])
        .select(F.to_date("w.start").alias("day"), "checks", *V.LEVELS)
    )


def daily_category_stream(checks: DataFrame, late: str = LATE) -> DataFrame:
    flagged = checks.filter((F.col("level") != "safe") & ~F.array_contains("signals", "needs_context"))
    return (
        flagged.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), radar.primary_category(F.col("signals")).alias("category"))
        .agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "category", "n")
    )


def drop_wave_copies(messages: DataFrame, text: str = "text", late: str = LATE) -> DataFrame:
    """One message per content within the watermark: a wave is scored once, its copies are only counted."""
    return messages.withColumn("fp", content_fingerprint(F.col(text))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fp"])


def newcomer_stream(messages: DataFrame, joins: DataFrame, late: str = LATE) -> DataFrame:
    """Messages (msg_id, chat_id, sender_id, ts, …) within 24 hours of a join (chat_id, sender_id, ts), each once."""
    m = messages.withWatermark("ts", late).alias("m")
    j = joins.select("chat_id", "sender_id", F.col("ts").alias("joined")).withWatermark("joined", late).alias("j")
    near = ((F.col("m.chat_id") == F.col("j.chat_id")) & (F.col("m.sender_id") == F.col("j.sender_id"))
            & (F.col("m.ts") >= F.col("j.joined")) & (F.col("m.ts") < F.col("j.joined") + F.expr("INTERVAL 24 HOURS")))
    return m.join(j, near).select("m.*").dropDuplicatesWithinWatermark(["msg_id"])


def maintain_flagged_domains(checks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps domain, first_seen, last_seen, hits, confirmed up to date while checks stream in.

    The totals are the stream's state; a micro-batch writes only the domains that it changed. Read with `read_totals`.
    """
    return maintain_totals(radar.flagged_domains(radar.domain_sightings(checks)), path, checkpoint)


def maintain_totals(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every changed total of an aggregated stream under its batch; `read_totals` takes the newest per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def compact_totals(spark: SparkSession, path: str, keys: list[str], into: str) -> None:
    """The newest totals as one batch of a new folder, for a table that has gathered many batches."""
    read_totals(spark, path, keys).write.parquet(f"{into}/batch=0")


def with_fresh_side(stream: DataFrame, read_side: Callable[[SparkSession], DataFrame],
                    apply: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None],
                    checkpoint: str) -> StreamingQuery:
    """Joins every micro-batch with a static side read anew, so reports made a minute ago already count."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(apply(batch, read_side(batch.sparkSession)), batch_id)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def model_score_stream(messages: DataFrame, folder: str, write: Callable[[DataFrame, int], None], checkpoint: str,
                       out: str = "char_proba") -> StreamingQuery:
    """Scores every micro-batch with the newest saved model of a folder; a new version counts from the next batch on."""
    held: dict[int, PipelineModel] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = textmodel.versions(batch.sparkSession, folder)[-1]
        if newest not in held:
            held.clear()
            held[newest] = textmodel.load_version(batch.sparkSession, folder, newest)
        with shuffles_dropped(batch.sparkSession):
            write(textmodel.char_proba(batch, held[newest], out), batch_id)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
