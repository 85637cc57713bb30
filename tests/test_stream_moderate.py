"""Moderation as a stream of several micro-batches against the batch operators on the same rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.operators import guard
from wardlight.plans import guard_queries
from wardlight.streaming import moderate, state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BAD = "Karta raqamini va sms kodni shu botga yuboring: kapital-bonus.xyz"
SCHEMA = ("msg_id long, chat_id long, sender_id long, ts timestamp, text string, is_bot boolean, auto_forward boolean, is_channel boolean, linked_chat long, "
          "test boolean, from_chat boolean")


def messages(n=90, seed=2):
    rng, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += rng.choice([60, 600, 7200, 20_000])
        rows.append((i, rng.randint(1, 3), rng.randint(10, 12), START + timedelta(seconds=t), BAD if rng.random() < 0.7 else "salom, bugun dars bor", False, False, False, 0, False, False))
    rows.append((n, 1, 10, rows[3][3], BAD, False, False, False, 0, False, False))   # a tie
    return rows


@pytest.mark.parametrize("resets", [True, False])
def test_stream_equals_batch(spark, tmp_path, resets):
    rows = messages()
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = (empty("msg_id long, file_level string, app_signals array<string>"), empty("msg_id long, weight double"), empty("msg_id long, reporters long"),
              spark.createDataFrame([(1, "delete", True), (2, "warn", True), (3, "delete", False)], "chat_id long, mode string, mute boolean"), empty("chat_id long, sender_id long, ts timestamp"), spark.createDataFrame([(1, 12)], "chat_id long, sender_id long"))
    rng = random.Random(7)
    dealt = [[], [], []]
    for r in rows:
        dealt[rng.randrange(3)].append(r)
    last = (-1, 0, 0, rows[-2][3] + timedelta(days=90), "", False, False, False, 0, False, False)
    for i, part in enumerate([*dealt, [last]]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    state.use_state_store(spark)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = moderate.moderate_stream(source, *tables, F.lit(True), resets=resets, gap=3600, late="60 days")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    names = ["msg_id", "chat_id", "sender_id", "ts", "action", "reason", "strikes", "mute", "notify"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(names).collect()))
    batch = guard.moderate_messages(spark.createDataFrame(rows, SCHEMA), *tables, F.lit(True), resets=True, gap=3600).select(names)
    want = sorted(map(tuple, batch.collect()))
    if not resets:   # ties are one by one here, together there; strikes without resets are counted below
        hits, want_strikes = {}, {}
        for m, c, s, t, action, *_ in sorted(want, key=lambda r: (r[3], r[0])):
            if action == "delete":
                hits[c, s] = [h for h in hits.get((c, s), []) if (t - h).total_seconds() <= 86400] + [t]
                want_strikes[m] = len(hits[c, s])
        assert {r[0]: r[6] for r in got if r[4] == "delete"} == want_strikes and [r[:6] + r[8:] for r in got] == [r[:6] + r[8:] for r in want]
        return
    assert got == want and len(got) > 30 and any(r[7] for r in got) and not any(r[7] for r in got if r[1] == 3) and any(not r[8] for r in got)


def test_parts_do_not_grow_with_the_files(spark, tmp_path):
    """A table of many files is three micro-batches and a last row, not one micro-batch for each file."""
    m = spark.range(600).selectExpr("id AS msg_id", "id % 7 AS sender_id", "id % 3 AS chat_id", "timestamp_seconds(1704067200 + id) AS ts", "'text' AS text").repartition(20)
    stream = guard_queries._dealt(m, str(tmp_path))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) == 4
    assert spark.read.parquet(f"{tmp_path}/out").count() == 601
