"""Sources and sinks by writing given tables and reading them back, and operators over files, forwards and late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import attachments, crowd, moderation
from wardlight.plans import datasets as D
from wardlight.plans import sql as S
from wardlight.plans.catalog import query
from wardlight.plans.message_queries import _INDICATORS
from wardlight.plans.stream_queries import _work
from wardlight.sources import readers, sinks
from wardlight.streaming import jobs


@query("read_labelled", "SELECT md5(text) AS fp, (length(text) % 2)::INT AS label FROM documents WHERE text <> '' GROUP BY text")
def read_labelled(spark, d):
    """All documents as two labelled CSV folders that share a part of their rows."""
    docs, path = D.table(spark, d, "documents"), _work(spark, "labelled")
    rows = docs.select("doc_id", "text", (F.length("text") % 2).alias("label"))
    for name, part in (("a", rows.filter("doc_id % 3 <> 0")), ("b", rows.filter("doc_id % 3 <> 1"))):
        part.drop("doc_id").write.options(**sinks.CSV).csv(f"{path}/{name}")
    return readers.read_labelled(spark, [f"{path}/a", f"{path}/b"]).select(F.md5(F.col("text").cast("binary")).alias("fp"), "label")


@query("effective_text", """SELECT doc_id, md5(concat_ws(' ', CASE WHEN doc_id % 3 <> 0 THEN text ELSE 'caption ' || doc_id END,
 CASE WHEN doc_id % 2 = 0 THEN 'http://hidden.site/' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 'http://button.site' END)
 || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'image ' || doc_id ELSE '' END) AS fp FROM documents""")
def effective_text(spark, d):
    docs, key = D.table(spark, d, "documents"), F.col("doc_id")
    kind = "array<struct<type:string,url:string>>"
    link = F.array(F.struct(F.lit("text_link").alias("type"), F.concat(F.lit("http://hidden.site/"), key.cast("string")).alias("url")),
                   F.struct(F.lit("bold").alias("type"), F.lit("x").alias("url")))
    said = readers.effective_text(
        F.when(key % 3 != 0, F.col("text")), F.when(key % 3 == 0, F.concat(F.lit("caption "), key.cast("string"))), F.when(key % 2 == 0, link).otherwise(F.array().cast(kind)),
        F.when(key % 5 == 0, F.array(F.lit("http://button.site"))), F.when(key % 7 == 0, F.concat(F.lit("image "), key.cast("string"))))
    return docs.select("doc_id", F.md5(said.cast("binary")).alias("fp"))


_FEEDBACK = f"SELECT {S.mask_dataset('text')} AS text, ts FROM messages"


@query("export_feedback", S.select(S.MESSAGES, f"SELECT md5(text) AS fp, count(*) AS n, 'dangerous' AS predicted FROM ({_FEEDBACK}) WHERE text <> '' GROUP BY text"))
def export_feedback(spark, d):
    """Feedback rows as a CSV, read back."""
    path = _work(spark, "feedback")
    sinks.export_feedback_csv(moderation.undo_feedback(D.messages(spark, d).withColumn("level", F.lit("dangerous"))), path)
    back = readers.read_csv(spark, path).filter("text IS NOT NULL")
    return back.groupBy("text", "predicted").agg(F.count("*").alias("n")).select(F.md5(F.col("text").cast("binary")).alias("fp"), "n", "predicted")


@query("append_split", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT text) AS texts, DATE '2024-02-01' AS added FROM documents GROUP BY 1")
def append_split(spark, d):
    """Two days' curated rows appended to the split folders, read back."""
    path, docs = _work(spark, "splits"), D.table(spark, d, "documents")
    rows = docs.select("doc_id", "text", F.lit(1).alias("label"), "lang", F.lit("other").alias("category"), "source",
                       F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("train").alias("split"))
    for half in (0, 1):
        sinks.append_split(rows.filter(F.col("doc_id") % 2 == half).drop("doc_id"), path, F.to_date(F.lit("2024-02-01")))
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.max("added").alias("added"))


@query("disguised_program", "SELECT page_id, page_id % 4 = 0 AS odd FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 1")
def disguised_program(spark, d):
    """Every third page as a file that starts like a program; every fourth of all has a program's name."""
    pages, key = D.table(spark, d, "pages"), F.col("page_id")
    files = pages.select("page_id", F.concat(F.lit("dir/file"), key.cast("string"), F.when(key % 4 == 1, ".exe").when(key % 4 == 0, "").otherwise(".pdf")).alias("path"),
                         F.concat(F.when(key % 3 == 0, "MZ").otherwise("<"), F.col("html")).cast("binary").alias("content"))
    return attachments.disguised_program(files).select("page_id", (key % 4 == 0).alias("odd"))


def _masked(value: str, start: int, end: int = 0) -> str:
    tail = f" || right({value}, {end})" if end else ""
    return f"CASE WHEN length({value}) <= {start + end} THEN {value} ELSE left({value}, {start}) || '***'{tail} END"


@query("indicator_previews", S.select(_INDICATORS, f"""SELECT msg_id, kind, value, CASE kind WHEN 'tg' THEN '@' || {_masked('substr(value, 2)', 3)}
 WHEN 'phone' THEN {_masked('value', 6, 2)} ELSE value END AS preview FROM indicators"""))
def indicator_previews(spark, d):
    return crowd.extract_indicators(D.messages(spark, d), "msg_id").select("msg_id", "kind", "value", "preview")


@query("forward_indicators", S.select(_INDICATORS, f"""SELECT msg_id, kind, value, CASE kind WHEN 'tg' THEN '@' || {_masked('substr(value, 2)', 3)}
 WHEN 'phone' THEN {_masked('value', 6, 2)} ELSE value END AS preview FROM indicators UNION ALL
SELECT doc_id, 'tg', 'id' || doc_id, CASE WHEN doc_id % 3 = 0 THEN '@' || {_masked("'user' || doc_id", 3)} WHEN doc_id % 3 = 1
 THEN {_masked("'Name ' || source", 3)} ELSE 'Telegram' END AS preview FROM documents WHERE doc_id % 4 <> 0"""))
def forward_indicators(spark, d):
    """Everything that whole texts and the senders they were forwarded from give."""
    key = F.col("msg_id")
    m = D.messages(spark, d).join(D.table(spark, d, "documents").select(F.col("doc_id").alias("msg_id"), "source"), "msg_id")
    rows = m.select("msg_id", "text", F.when(key % 4 != 0, F.concat(F.lit("id"), key.cast("string"))).alias("fwd"),
                    F.when(key % 3 == 0, F.concat(F.lit("@USER"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("Name "), F.col("source"))).alias("shown"))
    return crowd.extract_indicators(rows, "msg_id", forward_id="fwd", forward_name="shown").select("msg_id", "kind", "value", "preview")


_LATE = ("mark AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM checks WHERE event_id % 10 <> 0), "
         "seen AS (SELECT CAST(ts AS DATE) AS day FROM checks, mark WHERE event_id % 10 <> 0 OR CAST(ts AS DATE) + INTERVAL 1 DAY > w)")


@query("stream_late_rows", S.select([S.CHECKS, _LATE], "SELECT day, count(*) AS checks FROM seen GROUP BY day"))
def stream_late_rows(spark, d):
    """Every tenth check comes in a second batch; those of days that the watermark has closed are not counted."""
    path, checks = _work(spark, "late"), D.checks(spark, d)
    for name, part in (("a", checks.filter("event_id % 10 <> 0")), ("b", checks.filter("event_id % 10 = 0"))):
        part.write.mode("append").parquet(f"{path}/in/{name}")
    totals = None
    for name in ("a", "b"):   # one run of the same query per batch; its checkpoint carries the watermark over
        spark.read.parquet(f"{path}/in/{name}").write.mode("append").parquet(f"{path}/stream")
        stream = spark.readStream.schema(checks.schema).parquet(f"{path}/stream")
        jobs.maintain_totals(jobs.daily_count_stream(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
        totals = jobs.read_totals(spark, f"{path}/out", ["day"])
    return totals.select("day", "checks")


@query("stream_fresh_side", S.select(S.REPORTS, "SELECT ind, count(*) AS reports, count(*) AS known FROM reports GROUP BY ind"))
def stream_fresh_side(spark, d):
    """Reports stream in and meet the table of counts as it stands when their batch runs."""
    path, reports = _work(spark, "fresh"), D.reports(spark, d)
    reports.write.parquet(f"{path}/in")
    reports.groupBy("ind").agg(F.count("*").alias("known")).write.parquet(f"{path}/side")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    jobs.with_fresh_side(spark.readStream.schema(reports.schema).parquet(f"{path}/in"), lambda s: s.read.parquet(f"{path}/side"),
                         lambda batch, side: batch.join(side, "ind"), write, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("ind").agg(F.count("*").alias("reports"), F.max("known").alias("known"))
