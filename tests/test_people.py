"""Streams that count different people keep few Python states, whatever the people."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight.session import STATE_STORE
from wardlight.streaming import people


def _run(spark, stream, path):
    asked = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    asked.awaitTermination()
    states = {}
    for p in asked.recentProgress:
        for op in p["stateOperators"]:
            states[op["operatorName"]] = max(states.get(op["operatorName"], 0), op["numRowsTotal"])
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), states


@pytest.fixture
def path(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return f"{tmp_path}/{uuid.uuid4().hex}"


def test_states_of_reporters_are_slots(spark, path):
    day = datetime(2024, 1, 1)
    rows = [("a", f"r{i}", day + timedelta(days=i % 5)) for i in range(60)] + [("a", "r0", day + timedelta(days=80)), ("b", "r0", day)]
    for part in (rows[::2], rows[1::2], [("end", "end", day + timedelta(days=900))]):
        spark.createDataFrame(part, "ind string, reporter string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema("ind string, reporter string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    changes, states = _run(spark, people.reporter_changes(source, late="400 days", slots=4), path)
    at = lambda d: {r["ind"]: r["reporters"] for r in people.counts_at(changes.filter("ind <> 'end'"), F.lit(day + timedelta(days=d))).collect()}
    assert at(10) == {"a": 60, "b": 1} and at(92) == {"a": 37} and at(93) == {"a": 25} and at(94) == {"a": 13} and at(100) == {"a": 1} and at(171) == {}
    assert max(states.values()) <= 4 * 6   # at most a few rows a slot


def test_people_are_told_apart_without_python(spark, path):
    checks = spark.range(90).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id") % 30).alias("person"),
                                    F.lit("dangerous").alias("level"), F.array(F.lit("prize")).alias("signals"), F.array(F.lit("x.top")).alias("domains"),
                                    F.array().cast("array<string>").alias("confirmed"), F.lit("bot").alias("channel"))
    checks.repartition(3).write.parquet(f"{path}/in")
    stream = people.flagged_people_stream(spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    written, states = _run(spark, stream, path)
    row = people.newest_totals(written).collect()
    assert [(r["domain"], r["hits"], r["people"]) for r in row] == [("x.top", 90, 20)]
    assert states["dedupe"] == 20 and all(n <= 3 for name, n in states.items() if name != "dedupe")
