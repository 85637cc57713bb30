"""Near-copies among meaning vectors, exactly.

Vectors have unit length, so "cosine at least t" is "angle at most θ". Reports are grouped around pivot
vectors; each group knows its radius, and by the triangle inequality a query only needs the groups with
angle(query, pivot) <= radius + θ. That never loses a pair, whatever the data looks like; tight data (waves of
near-copies) just visits fewer groups. Blocks of bounded size meet and are multiplied; only matches leave the task. Equal vectors are folded before any of this, so a wave of copies is one row with many reporters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import bind
from wardlight.session import drop_staged, shuffles_dropped, staged_once

_SLACK = 1e-4   # radians; covers rounding in the pruning test, the match itself is tested exactly


def dot(a, b):
    """Dot product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector):
    """The vector at length one (double precision)."""
    length = F.sqrt(dot(vector, vector))
    return bind(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _pivots(reports: DataFrame, n: int) -> np.ndarray:
    """At most n vectors chosen by hash: a bounded handful, the only rows that ever reach the driver."""
    rows = reports.select("vec").orderBy(F.xxhash64("vec")).limit(n).collect()
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def similar_pairs(queries: DataFrame, reports: DataFrame, threshold: float, pivots: int = 64,
                  block: int = 4096) -> DataFrame:
    """(query_id, report_id, cosine) with cosine >= threshold, for distinct vectors (query_id|report_id, vec).

    Both sides are written in blocks, a row each, and blocks meet without a shuffle: no vector is written once for each block
    that it meets, so that disk grows with the vectors and not with their pairs.
    """
    spark = queries.sparkSession
    reports, queries = staged_once(reports.select("report_id", "vec")), staged_once(queries.select("query_id", "vec"))
    with shuffles_dropped(spark):
        centres = _pivots(reports, pivots)
    empty = "query_id string, report_id string, cosine double"
    if not len(centres):
        return spark.createDataFrame([], empty)
    theta = float(np.arccos(min(1.0, threshold)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            angles = _angles(_stack(batch["vec"]), centres)
            yield batch.assign(pivot=angles.argmin(axis=1).astype("int32"), angle=angles.min(axis=1))

    placed, asked = (rows.select(F.col(name).alias("id"), "vec").mapInPandas(nearest, "id string, vec array<double>, pivot int, angle double")
                     for rows, name in ((reports, "report_id"), (queries, "query_id")))
    with shuffles_dropped(spark):
        groups = placed.groupBy("pivot").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()   # <= pivots rows
        sizes = asked.groupBy("pivot").agg(F.count("*").alias("n")).collect()   # <= pivots rows
    radius = {g["pivot"]: g["radius"] for g in groups}
    reach = np.array([radius.get(p, -np.inf) for p in range(len(centres))]) + theta + _SLACK

    def blocks(rows: DataFrame, groups: list) -> DataFrame:
        parts = {g["pivot"]: -(-g["n"] // block) for g in groups}
        number = F.element_at(F.create_map(*[F.lit(x) for p in range(len(centres)) for x in (p, int(parts.get(p, 1)))]), F.col("pivot"))
        dealt = rows.select("id", "vec", "pivot", F.pmod(F.xxhash64("id"), number).alias("part"))
        return staged_once(dealt.groupBy("pivot", "part").applyInArrow(_block(centres, reach), "pivot int, part long, ids array<string>, vecs binary, pivots array<int>"))

    held = blocks(placed, groups).select("pivot", F.col("part").alias("rpart"), F.col("ids").alias("report_ids"), F.col("vecs").alias("report_vecs"))
    met = blocks(asked, sizes).select((F.col("pivot") * F.lit(1 << 32) + F.col("part")).alias("qpart"), "ids", "vecs", "pivots")
    drop_staged(reports, queries)
    matches, unfold = _matches(threshold), _unfolded(centres, reach)
    return met.join(held, F.array_contains("pivots", F.col("pivot"))).drop("pivots").mapInArrow(lambda batches: matches(unfold(batches)), empty)


def _block(centres: np.ndarray, reach: np.ndarray):
    """Some vectors as one row, with the groups that one of them at least has to meet."""
    def run(rows: pa.Table) -> pa.Table:
        vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        near = (_angles(vectors, centres) <= reach).any(axis=0)
        return pa.table({"pivot": rows.column("pivot").slice(0, 1), "part": rows.column("part").slice(0, 1), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.string())),
                         "vecs": pa.array([vectors.tobytes()], pa.binary()), "pivots": pa.array([np.flatnonzero(near).tolist()], pa.list_(pa.int32()))})
    return run


def _unfolded(centres: np.ndarray, reach: np.ndarray):
    """Of blocks that meet: the rows of the reports, then those of the queries that have to meet their group."""
    def side(cell: tuple, first: int, ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1])
        same = [pa.array(np.full(len(ids), x)) for x in (*cell, first)]
        return pa.RecordBatch.from_arrays([*same, ids, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["pivot", "rpart", "qpart", "side", "id", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = tuple(batch.column(c)[i].as_py() for c in ("pivot", "rpart", "qpart"))
                reports, queries = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, centres.shape[1]) for c in ("report_vecs", "vecs"))
                near = np.flatnonzero(_angles(queries, centres[cell[0] : cell[0] + 1])[:, 0] <= reach[cell[0]])
                if len(near):
                    yield side(cell, 0, batch.column("report_ids")[i].values, reports)
                    yield side(cell, 1, batch.column("ids")[i].values.take(pa.array(near)), queries[near])
    return run


#: Queries multiplied at once, and pairs that leave a task at once.
_ROWS, _PAIRS = 256, 1 << 16


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _matches(threshold: float):
    """Pairs of each cell, whose reports come before its queries. Memory does not grow with the queries or with the matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("pivot", "rpart", "qpart", "side")], axis=1)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)])
            for start, end in zip(starts, [*starts[1:], len(where)], strict=True):
                here, rows = tuple(where[start][:3]), batch.slice(start, end - start)
                if here != at:
                    at, held = here, []
                if not where[start][3]:
                    held.append((rows.column("id"), _vectors(rows)))
                    continue
                for i in range(0, rows.num_rows, _ROWS):
                    part = rows.slice(i, _ROWS)
                    for ids, theirs in held:
                        cosine = _vectors(part) @ theirs.T
                        own, other = np.nonzero(cosine >= threshold)
                        for k in range(0, len(own), _PAIRS):
                            q, r = own[k:k + _PAIRS], other[k:k + _PAIRS]
                            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(q)), ids.take(pa.array(r)), pa.array(cosine[q, r])],
                                                             names=["query_id", "report_id", "cosine"])
    return run


def similar_reporters(queries: DataFrame, reports: DataFrame, threshold: float = V.SAME_SCAM_AT,
                      key: str = "msg_id", **how) -> DataFrame:
    """(key, reporters): different people who reported nearly the same message; 0 for vectors without a match.

    `queries` is (key, embedding), `reports` is (embedding, reporter); a NULL embedding is an empty text.
    """
    vec = lambda c: F.transform(c, lambda x: x.cast("double"))
    ident = lambda c: F.sha2(F.to_json(F.struct(c)), 256)
    asked = queries.select(key, vec(F.col("embedding")).alias("vec")).withColumn("query_id", F.when(F.col("vec").isNotNull(), ident(F.col("vec"))))
    said = reports.filter(F.col("embedding").isNotNull()).select(vec(F.col("embedding")).alias("vec"), "reporter").withColumn(
        "report_id", ident(F.col("vec")))
    distinct_queries = asked.filter(F.col("vec").isNotNull()).groupBy("query_id").agg(F.first("vec").alias("vec"))
    distinct_reports = said.groupBy("report_id").agg(F.first("vec").alias("vec"))
    people = said.groupBy("report_id", "reporter").agg(F.lit(1).alias("_one"))
    pairs = similar_pairs(distinct_queries, distinct_reports, threshold, **how)
    counts = (pairs.select("query_id", "report_id").join(people, "report_id").groupBy("query_id", "reporter")
              .agg(F.lit(1).alias("_one")).groupBy("query_id").agg(F.count("*").alias("reporters")))
    return asked.select(key, "query_id").join(counts, "query_id", "left").select(
        key, F.coalesce("reporters", F.lit(0)).alias("reporters"))


def pair_statistics(vectors: DataFrame, category: str, key: str, block: int = 2048, bins: int = 200_000) -> DataFrame:
    """One row: median cosine of same-type pairs, median and 99th percentile of different-type pairs.

    The statistic is over all pairs of the labelled scams by definition. Blocks of vectors are multiplied in
    tasks and only histogram counts leave them, so no pair is ever a row; quantiles are read from the histogram
    (bin width 1e-5).
    """
    n_blocks = max(1, -(-vectors.count() // block))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks))
    base = vectors.select(F.col(key).cast("string").alias("id"), F.col(category).cast("string").alias("kind"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("vec"), part.alias("part"))
    left = base.withColumn("other", F.explode(F.sequence(F.col("part"), F.lit(n_blocks - 1).cast("long"))))
    right = base.withColumnRenamed("part", "other").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other"))))

    def histogram(cell, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            theirs, ids, kinds = _stack(b["vec"]), b["id"].to_numpy(), b["kind"].to_numpy()
            for at in range(0, len(a), 512):
                rows = a.iloc[at:at + 512]
                cosine = _stack(rows["vec"]) @ theirs.T
                own, kind = rows["id"].to_numpy(), rows["kind"].to_numpy()
                wanted = own[:, None] < ids[None, :] if cell[0] == cell[1] else np.ones(cosine.shape, dtype=bool)
                same = kind[:, None] == kinds[None, :]
                at_bin = np.rint((np.clip(cosine, -1, 1) + 1) * bins / 2).astype(np.int64)
                for flag in (True, False):
                    where, n = np.unique(at_bin[wanted & (same == flag)], return_counts=True)
                    out.append(pd.DataFrame({"same": flag, "bin": where, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"same": [], "bin": [], "n": []})

    counts = left.groupBy("part", "other").cogroup(right.groupBy("part", "other")).applyInPandas(
        histogram, "same boolean, bin long, n long").groupBy("same", "bin").agg(F.sum("n").alias("n"))
    value = F.col("bin") * 2.0 / bins - 1
    same, different = F.when(F.col("same"), value), F.when(~F.col("same"), value)
    return counts.agg(
        F.percentile(same, F.lit(0.5), F.col("n")).alias("same_median"),
        F.percentile(different, F.lit(0.5), F.col("n")).alias("different_median"),
        F.percentile(different, F.lit(0.99), F.col("n")).alias("different_p99"))
