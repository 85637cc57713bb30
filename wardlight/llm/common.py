"""What several operators share: row streams between Spark and Python, staged tables, documents as inputs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import drop_staged, shared_folder, staged  # noqa: F401

#: The six ASCII white-space characters, as in the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
#: Rows and bytes of what is worked on at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty) and nothing else but the named columns, so that other columns cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                     *columns)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded rows and, by their mean row, bounded bytes."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, max(1, batch.num_rows), step):
            yield batch.slice(start, step)


def given_back(step: Step) -> Step:
    """`step`, after which what a task held goes back to the system, also what Arrow and the C library would keep for later:
    a worker stays when its task is done, there are more workers than cores, and all of them wait with what they keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def each_batch(df: DataFrame, schema: str, step: Step) -> DataFrame:
    """`step` over the Arrow batches of every partition, in bounded pieces; what a task held is given back at its end."""
    return df.mapInArrow(given_back(lambda batches: step(bounded(batches))), schema)


def staged_texts(df: DataFrame) -> DataFrame:
    """`df`, which sends whole texts to Python, as a table in the shared folder. While it is written, rows go to Python in batches of bounded rows."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        return staged(df)
    finally:
        spark.conf.set(name, before)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A staged copy of the rows with a number each, and the name of that column: rows are told apart, equal ones too."""
    name = fresh_name(docs, "row_number")
    return staged(docs.withColumn(name, F.monotonically_increasing_id())), name


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def split_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join with a lookup of unique keys. Rows of one key are dealt over `salts` groups, the lookup is repeated for each."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    every = F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt")
    return dealt.join(lookup.select("*", every), [*keys, "_salt"], how).drop("_salt")
