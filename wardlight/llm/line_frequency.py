"""Quality rules: lines that many documents of one host share are removed, documents left with too little are rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import each_batch, fresh_name, numbered, split_join, staged_texts

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
_NUMBER = re.compile(r"[0-9]+")
#: A text of fewer words, or with a larger share of words in repeated three-word windows, fails.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A line of a host is frequent if it stands in more documents than this, however many the host has.
MOST_DOCUMENTS = 10
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, "
            "lines array<struct<hash:long,words:long>>")


def normal_line(line: bytes) -> bytes:
    """Lower case, white space as one space, trimmed, numbers as 0."""
    return _NUMBER.sub("0", " ".join(w.decode() for w in line.split()).lower()).encode()


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, n = -1, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 2 - max(covered, i - 1)
            covered = i + 2
    return n


def measure(text: bytes) -> tuple:
    words, seen, again, lines = text.split(), set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        again += line in seen
        seen.add(line)
        key = xxhash.xxh64_intdigest(normal_line(line)) - (1 << 63)
        lines[key] = lines.get(key, 0) + n
    return (len(words), len(text) - len(text.translate(None, SYMBOLS)), again, repeated_words(words),
            xxhash.xxh64_intdigest(text) - (1 << 63), [{"hash": h, "words": n} for h, n in lines.items()],
            len(text) - len(text.translate(None, _WHITE)))


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
    names = ["key", "doc_id", "host", *[c.split()[0] for c in MEASURES.split(", ")]]
    for batch in batches:
        found = [measure(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        n, symbols, again, repeated, text_hash, lines, white = zip(*found, strict=True) if found else [()] * 7
        long = lambda x: pa.array(x, pa.int64())
        chars = pc.subtract(pc.utf8_length(batch.column("text")).cast(pa.int64()), long(white))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], long(n), chars, long(symbols), long(again),
                                          long(repeated), long(text_hash), pa.array(lines, line)], names=names)


def measure_documents(docs: DataFrame, host: str = "source", number: str | None = None) -> DataFrame:
    """key, doc_id, host, the counts of each whole text, a hash of the text, hash and words of its normalised lines.

    The key is the row's number, if it has one, or else a hash of the row: rows with the same key are then the same.
    """
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([F.col(number).alias("number")] if number else []))
    key = F.col("number") if number else F.xxhash64("doc_id", "host", "text")
    return each_batch(row.select(key.alias("key"), "doc_id", "host", "text"), f"key long, doc_id long, host string, {MEASURES}", _measurer)


def frequent_lines(measured: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """host, hash, n_documents of the lines above the limit.

    Documents are told apart by their text, so copies of one text are one document. (host, line, text) triples are made
    distinct before they are counted, so that a hot host or line is counted in parts.
    """
    lines = measured.select("host", "text_hash", F.explode("lines.hash").alias("hash"))
    return lines.groupBy("host", "hash", "text_hash").agg(F.lit(1).alias("_")).groupBy("host", "hash").agg(
        F.count("_").alias("n_documents")).filter(F.col("n_documents") > most_documents)


def judge(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS, number: str | None = None) -> DataFrame:
    """One row per document: key, doc_id, the counts, base_failed, n_removed (words in frequent lines), removed_lines, kept.

    kept is false if the base rules fail, or if the lines that are left hold less than LEAST_LEFT of the words.

    Null or empty text: no words, so the base rules fail. A null host is the host ''. A null doc_id is a document like any
    other. Repeated rows are judged each, and are one document in the counts. Lines at the limit stay. An empty table gives
    no rows. Other columns are not read.
    """
    measured = staged_texts(measure_documents(docs, host, number))
    frequent = frequent_lines(measured, most_documents).select("host", "hash")
    lines = measured.select("key", "host", F.explode("lines").alias("line")).select("key", "host", "line.hash", "line.words")
    removed = split_join(lines, frequent, ["host", "hash"]).groupBy("key").agg(F.collect_set(F.struct("hash", "words")).alias("removed"))
    judged = measured.drop("lines").join(removed, "key", "left").withColumn(
        "n_removed", F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < LEAST_LEFT * F.col("n_words")
    return judged.select("key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~(failed | depleted)).alias("kept"), "n_removed",
                         F.coalesce("removed.hash", F.array().cast("array<long>")).alias("removed_lines"))


def _cleaner(text: str, removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, gone in enumerate(batch.column(removed).to_pylist()):
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(line for line in texts[i].split("\n") if not (
                        (raw := line.encode().split()) and xxhash.xxh64_intdigest(normal_line(b" ".join(raw))) - (1 << 63) in gone))
            names = [name for name in batch.schema.names if name != removed]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if name == text else batch.column(name) for name in names], names=names)
    return run


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, without their frequent lines; all their columns, n_chars (if there) set anew.

    Rows are told apart by number: repeated rows are judged and kept each. Null and empty texts have no words and go. A null
    host is the host ''. Lines at the limit stay; a text keeps its other lines as they are, of any length. An empty table
    gives no rows. Columns of any name are kept. Only texts that lose lines pass through Python.
    """
    rows, number = numbered(docs)
    removed = fresh_name(rows, "removed_lines")
    verdict = judge(rows, host, number=number).filter("kept").select(F.col("key").alias(number), F.col("removed_lines").alias(removed))
    held = rows.join(verdict, number).drop(number)
    kept = each_batch(held.filter(F.size(removed) > 0), docs.schema, _cleaner("text", removed))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return held.filter(F.size(removed) == 0).select(*docs.columns).union(kept.select(*docs.columns))
