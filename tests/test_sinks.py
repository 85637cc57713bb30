"""Lists numbered over ranges, and sinks written and read back."""

import glob
import json
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.functions.ranks import numbered_in_order
from wardlight.sources import readers, sinks

FEED = "indicator string, type string, first_seen date, last_seen date, detections long, reporters long, source string"


def read_files(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def feed(spark, n):
    rng = random.Random(5)
    rows = [(f"site{i}.xyz", "domain" if i % 5 else "phone", date(2024, 1, 1 + i % 3), date(2024, 2, 1 + i % 7), rng.randint(0, 3), i % 4, "auto \"x\"") for i in range(n)]
    return spark.createDataFrame(rows, FEED).repartition(6)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbers_in_order(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 30 + ["b", None]), rng.randint(0, 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i long").repartition(7)
    got = sorted((r.i, r.rank) for r in numbered_in_order(df, keys, [F.desc("v"), F.asc("i")]).collect())
    want, seen = [], {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        k = k if keys else 0
        seen[k] = seen.get(k, 0) + 1
        want.append((i, seen[k]))
    assert got == sorted(want)
    assert numbered_in_order(df.limit(0), keys, [F.asc("i")]).count() == 0


@pytest.mark.parametrize("n", [0, 300])
def test_feed_files(spark, tmp_path, n):
    rows, now = feed(spark, n), F.lit("2024-02-09")
    sinks.write_feed_text(rows, f"{tmp_path}/text", "feed", now)
    lines = [r.line for r in sinks.feed_lines(rows, "feed", now).orderBy("line_no").collect()]
    assert read_files(f"{tmp_path}/text").split("\n")[:-1] == lines and lines[0] == "# feed" and len([x for x in lines if x.endswith(".xyz")]) == n - n // 5
    want = [r.indicator for r in sorted((r for r in rows.collect() if r.type == "domain"), key=lambda r: (-r.last_seen.toordinal(), -(r.detections + r.reporters), r.indicator))]
    assert lines[len(lines) - len(want) :] == want
    sinks.write_feed_json(rows, f"{tmp_path}/json", "a \"feed\"", now)
    assert json.loads(read_files(f"{tmp_path}/json")) == json.loads(sinks.feed_document(rows, "a \"feed\"", now).first().document)
    sinks.write_document(sinks.feed_document(rows, "feed", now), f"{tmp_path}/one")
    assert json.loads(read_files(f"{tmp_path}/one"))["count"] == n


def test_training_export_read_back(spark, tmp_path):
    at = datetime(2024, 1, 2, tzinfo=timezone.utc)
    said = spark.createDataFrame([("a \"quoted\", text\nwith a break", 1, "dangerous", True, at), ("b", 0, "safe", False, at)], "text string, label int, predicted string, user_agreed boolean, ts timestamp")
    groups = spark.createDataFrame([("c", "dangerous", date(2024, 1, 1), 3), ("d, e", "suspicious", date(2024, 1, 3), 9)], "text string, verdict string, first_seen date, hits long")
    sinks.export_training_csv(said, groups, f"{tmp_path}/csv")
    back = [(r.text, r.label, r.predicted, r.source, r.hits) for r in readers.read_csv(spark, f"{tmp_path}/csv").collect()]
    assert sorted(back, key=repr) == sorted([("a \"quoted\", text\nwith a break", "1", "dangerous", "feedback", "1"), ("b", "0", "safe", "feedback", "1"),
                                             ("d, e", None, "suspicious", "group", "9"), ("c", None, "dangerous", "group", "3")], key=repr)


def test_evaluation_set_and_message_stream(spark, tmp_path):
    from wardlight import values as V

    header = ",".join(V.EVAL_COLUMNS)
    rows = [",".join(f'"{c} {i}\nnext, ""x"""' for c in V.EVAL_COLUMNS) for i in range(3)]
    (tmp_path / "eval.csv").write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    found = readers.read_eval_set(spark, str(tmp_path / "eval.csv")).orderBy("line").collect()
    assert [r.line for r in found] == [2, 3, 4] and found[1][V.EVAL_COLUMNS[0]] == f'{V.EVAL_COLUMNS[0]} 1\nnext, "x"'
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_eval_set(spark, str(tmp_path / "bad.csv"))
    spark.range(20).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")).repartition(4).write.parquet(f"{tmp_path}/m")
    schema = spark.read.parquet(f"{tmp_path}/m").schema
    stream = readers.read_message_stream(spark, f"{tmp_path}/m", schema, 1)
    assert dict(stream.dtypes)["ts"] == "timestamp"
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 20


def test_parts_of_a_verdict(spark, tmp_path):
    from wardlight import values as V
    from wardlight.operators import explain, verdict

    bad = "Karta raqamini va sms kodni shu botga yuboring: kapital-bonus.xyz"
    scored = verdict.score_messages(spark.createDataFrame([(1, bad), (2, "salom"), (3, None)], "msg_id long, text string"))
    sinks.write_document(verdict.components_document(scored, "msg_id").filter("msg_id = 1").select("document"), f"{tmp_path}/d")
    one = json.loads(read_files(f"{tmp_path}/d"))
    assert set(one) == {"score", "level", "intent", "components"} and set(one["components"]) == {"rules", "links", "model"}
    assert one["level"] == "dangerous" and one["components"]["model"] is None and one["components"]["rules"] > 0 and one["intent"]["kind"] == "request"
    explained = explain.explain(scored, F.lit("en"))
    for whole, shown in zip(explained.orderBy("msg_id").collect(), explain.shown_reasons(explained, 2).orderBy("msg_id").collect(), strict=True):
        assert shown.reasons == whole.reasons[:2]
    assert explain.shown_reasons(explained).agg(F.max(F.size("reasons"))).first()[0] <= V.REASONS_SHOWN
