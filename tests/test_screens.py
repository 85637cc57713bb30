"""Screens in front of phrase lists: what they let through, what they decide, and that sentences are cut and searched once."""

import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.functions import phrases as P
from wardlight.functions.patterns import ANY_SPACE, SPACE, count_matches, one_of
from wardlight.functions.text import normalize
from wardlight.operators import intent, rules, verdict

CASES = [(name, alternative) for name in P.GATES for alternative in P.LISTS[name]]


@pytest.mark.parametrize("name,alternative", CASES)
def test_screen_lets_every_match_through(name, alternative):
    @settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(alternative), fullmatch=False))
    def check(text):
        text = " ".join(re.sub(r"[\s\x1c-\x1f\x85]", " ", text).split(" "))
        if re.search(alternative, text):
            pattern = P.screen_pattern(name)
            assert pc.match_substring_regex(pa.array([text]), pattern)[0].as_py()
            sure, unsure = P.sure_pattern(name), P.unsure_pattern(name)
            assert any(p and pc.match_substring_regex(pa.array([text]), p)[0].as_py() for p in (sure, unsure))

    check()


def test_screens_of_slices_and_nulls(spark):
    df = spark.createDataFrame([(1, ["a kod", None, "b"]), (2, []), (3, None), (4, ["kod cvv"])], "id int, t array<string>").coalesce(1)
    rows = {r["id"]: r["m"] for r in df.filter("id > 0").select("id", P.screens(F.col("t"), ["kod", "", "cvv"]).alias("m")).collect()}
    assert rows == {1: [1, 0, 0], 2: [], 3: [], 4: [5]}


def test_white_space_class_is_the_same(spark):
    df = spark.range(0xFFFF).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert df.filter(F.col("c").rlike(f"(?U){SPACE}") != F.col("c").rlike(ANY_SPACE)).count() == 0
    texts = spark.createDataFrame([(t,) for t in ("a  b", " a\n b\u2003 c ", "a\tb", "\u00a0", "x \x1c y")], "t string")
    assert [r[0] for r in texts.select(normalize(F.col("t"))).collect()] == ["a b", "a b c", "a b", "", "x y"]


def test_searches_by_their_end_are_the_same(spark):
    words = ["keldi", "di", "adi", "aldi", "u yozibdi", "x-y.uz", "-.uz", "a-.com", ".top", "olib ber", "b ber", "ab bering", "сказал", "ал", "пошла да"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for name in ("PAST", "ASK_VERB", "RISKY_OBJECT"):
        counts = df.select("t", count_matches(F.col("t"), one_of(P.LISTS[name])).alias("a"), count_matches(F.col("t"), one_of(P.PHRASES[name])).alias("b"))
        assert counts.filter("(a > 0) <> (b > 0)" if name != "PAST" else "a <> b").count() == 0


def test_phrases_far_into_a_long_text(spark):
    """One reading of the text for all lists: stems used to be looked for one by one, with a `contains` each."""
    text = "Xx yyy zzz. " * 3000 + "Karta raqamini va sms kodni yuboring: kapital-bonus.xyz"
    df = spark.createDataFrame([(1, text)], "msg_id int, text string")
    row = verdict.score_messages(df).first()
    assert row["level"] == "dangerous" and row["intent"]["kind"] == "request" and "secret_code" in row["signals"]
    for scored in (verdict.score_messages(df), intent.detect_intent(df), rules.match_rules(df)):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "exists([" not in plan
