"""Queries on tables that look otherwise than the small ones: folders of many files, nulls, letters of other alphabets."""

import pytest

import oracle
from wardlight.operators.links import urls_in
from wardlight.plans.catalog import ORACLES, QUERIES, load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, files=3):
    spark.createDataFrame(rows, DOCS).repartition(files).write.parquet(f"{path}/documents.parquet")


def compared(spark, path, name):
    import duckdb

    load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return oracle.compare(spark, con, QUERIES[name], ORACLES[name], str(path))


def test_waves_of_a_folder_of_files(spark, tmp_path):
    """A table of many files is read whole as a stream, and null texts are no wave."""
    texts = ["one text", "One  text!", "another", None, None, "third", "another"]
    write(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    ok, text = compared(spark, tmp_path, "stream_wave_dedupe")
    assert ok, text
    assert QUERIES["stream_wave_dedupe"](spark, str(tmp_path)).first()[0] == 3


@pytest.mark.parametrize("name", ["indicators", "indicator_previews", "forward_indicators"])
def test_links_after_letters_of_other_alphabets(spark, tmp_path, name):
    texts = ["mentmentç éoument.hrfkl Enanvi", "жclick-bonus.xyz ж-a.top", "é_b.site x_c.site", "ſd.site", "plain.site/é"]
    write(spark, tmp_path, [(20 * i, t, "fr", "s", 1) for i, t in enumerate(texts)])
    ok, text = compared(spark, tmp_path, name)
    assert ok, text


def test_link_edges(spark):
    df = spark.createDataFrame([("éoument.hrfkl",), ("x_c.site",), ("a-b.top",)], "text string")
    assert [[u.host for u in r.u] for r in df.select(urls_in(df.text).alias("u")).collect()] == [["oument.hrfkl"], [], ["a-b.top"]]


def test_effective_text_of_odd_texts(spark, tmp_path):
    """White space around a text stays; null and empty texts, with and without links and images, are as in the SQL."""
    texts = ["text", " led by a space", "ends in one ", "", None, "\n", "  "]
    write(spark, tmp_path, [(i, texts[i % 7 if i < 210 else (i + i // 7) % 7], "en", "s", 1) for i in range(420)] + [(None, "x", "en", "s", 1)])
    ok, text = compared(spark, tmp_path, "effective_text")
    assert ok, text
