"""One bad row must not end a job: character references, malformed groups, null keys."""

import html
import random

import pytest
from pyspark.sql import functions as F

from wardlight.functions.text import unescape_entities
from wardlight.operators import moderation
from wardlight.operators.curation import scheme_split


def test_character_references(spark):
    rng = random.Random(3)
    pieces = ["&#9999999;", "&#xD800;", "&#0;", "&#150;", "&mdash;", "&copy", "&copyx", "&amp;lt;", "&#x41;", "&#65", "&#x1F600;", "&notit;", "&", "&;", "&#", "&#x",
              "&#99999999999999999999999;", "&#x0D;", "&#1;", "&#129;", "&bogus;", "&ampere", "&lt", "a", ";", " ", "x&", "&#xFFFE;", "&#000065;", "&NotEqualTilde;", "&#127;"]
    texts = pieces + ["".join(rng.choice(pieces) for _ in range(6)) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape_entities(F.col("t")).alias("out"))
    for r in df.collect():
        assert r.out == html.unescape(r.t), (r.t, r.out, html.unescape(r.t))


def test_scheme_split_of_any_group(spark):
    df = spark.createDataFrame([("g3-a",), ("g08",), ("x1",), ("",), (None,), ("g" + "9" * 30,)], "g string")
    assert [r[0] for r in df.select(scheme_split(F.col("g"))).collect()] == ["dev", "test", None, None, None, None]


@pytest.mark.parametrize("key", [None, "a"])
def test_limits_of_a_null_key(spark, key):
    rows = [(i, key, i * 10) for i in range(5)] + [(100 + i, "other", i * 10) for i in range(2)]
    df = spark.createDataFrame(rows, "event_id long, user string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.admitted for r in moderation.rate_limited(df, 2, 60, ["user"]).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 100: True, 101: True}
    assert moderation.rate_limited(df, 2, 60, ["user"]).columns == [*df.columns, "admitted", "retry_after"]
