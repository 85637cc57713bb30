"""Session settings the jobs count on, and the folder for streams' state and outputs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "wardlight", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="wardlight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders that this thread has staged tables in.
_MADE = threading.local()


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: costly columns are computed once, and lineage starts there."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._staged_at = path
    _MADE.paths = [*getattr(_MADE, "paths", []), path]
    return held


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs in here gives back its shuffle files when it ends, not when the driver collects garbage.

    For jobs that run once, as writing a staged table or a pass over one: a table that is run again computes its shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged_once(df: DataFrame) -> DataFrame:
    """A staged copy of `df`, whose shuffles leave nothing behind."""
    with shuffles_dropped(df.sparkSession):
        return staged(df)


def drop_unread(docs: DataFrame) -> None:
    """Removes the tables that this thread has staged and that `docs`, which reads files, does not read.

    For a chain of steps that hand on nothing but files: what earlier steps staged is of no use once `docs` is written.
    """
    files = docs.inputFiles()
    unread = [p for p in getattr(_MADE, "paths", []) if files and not any(p in f for f in files)]
    for path in unread:
        where = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(docs.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _MADE.paths = [p for p in getattr(_MADE, "paths", []) if p not in unread]


def drop_staged(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
