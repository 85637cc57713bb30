"""Every fast registered query against its SQL on the smallest tables (tests/oracle.py runs all of them on larger ones)."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"train_char_lr", "stream_char_model", "out_of_fold_report", "stream_rate_limit", "stream_strikes", "stream_notices",
        "stream_scored", "score_messages_with_model", "verdict_document", "apply_enrichment", "apply_attachments", "explain_trust", "stream_moderate"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    ok, text = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["msg_id", "level", "score", "signals"] and df.count() > 0
