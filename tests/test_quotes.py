"""Quoted speech inside phrases, lone quotation marks, and time on hostile lengths."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.phrases import GATES, PHRASES, linear
from wardlight.operators.intent import blank_quoted, detect_intent
from wardlight.operators.rules import match_rules

QUOTED = re.compile("\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]")


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.kind for r in detect_intent(df).select("i", "intent.kind").orderBy("i").collect()]


def test_quotation_inside_a_phrase(spark):
    assert kinds(spark, ['need"x"5 dollars', 'need "x" 5 dollars', 'bugun "salom" ertalab keldi', "bugun ertalab keldi"]) == [
        "request", "request", "report", "report"]


def test_blanking_equals_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("«»“”„\"ab .") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", blank_quoted(F.col("text")).alias("out"))
    for r in df.collect():
        assert r.out == QUOTED.sub(lambda m: " " * len(m[0]), r.text), r.text


def test_linear_search_finds_the_same(spark):
    rng = random.Random(6)
    for name, _, _, alternatives in V.RULES:
        for a in alternatives:
            if linear(a) == a:
                continue
            parts = re.split(r"[^\w' ]+", a) + [" ", ".", "\n", "x"]
            for _ in range(300):
                text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
                assert bool(re.search(a, text)) == bool(re.search(linear(a), text)), (name, a, text)
    assert set(GATES) <= set(PHRASES)


@pytest.mark.parametrize("piece", ["«", "kod", '"', "“", "„", "kripto", "siz", "'", "„“"])
def test_time_on_long_runs(spark, piece):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit(piece), n // len(piece)).alias("text"))
        start = time.perf_counter()
        match_rules(detect_intent(df)).select("intent.kind", "hits").collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(130_000) < 12
