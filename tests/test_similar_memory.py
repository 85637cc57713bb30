"""Matching of vectors: what leaves a task stays small, however many pairs match and however the cells are dealt into batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardlight.operators import similarity

SCHEMA = pa.schema([("pivot", pa.int32()), ("rpart", pa.int64()), ("qpart", pa.int64()), ("side", pa.int32()), ("id", pa.string()), ("vec", pa.list_(pa.float64()))])


def rows(cell, side, names, vectors):
    return [dict(zip(SCHEMA.names, (*cell, side, n, list(v)), strict=True)) for n, v in zip(names, vectors, strict=True)]


def test_pairs_leave_in_bounded_batches():
    one = np.ones((900, 2)) / np.sqrt(2)
    table = pa.Table.from_pylist(rows((0, 0, 0), 0, map(str, range(900)), one) + rows((0, 0, 0), 1, map(str, range(900)), one), SCHEMA)
    out = list(similarity._matches(0.9)(iter(table.to_batches(max_chunksize=400))))
    assert sum(b.num_rows for b in out) == 900 * 900 and max(b.num_rows for b in out) <= similarity._PAIRS


def test_cells_do_not_mix():
    a, b = [1.0, 0.0], [0.0, 1.0]
    table = pa.Table.from_pylist(rows((0, 0, 0), 0, ["r0", "r1"], [a, b]) + rows((0, 0, 0), 1, ["q0"], [a]) + rows((0, 1, 0), 1, ["q0"], [a])
                                 + rows((1, 0, 0), 0, ["r2"], [a]) + rows((2, 0, 0), 0, ["r3"], [b]) + rows((2, 0, 0), 1, ["q1", "q2"], [b, a]), SCHEMA)
    for size in (1, 2, 3, 100):
        pairs = [(p["query_id"], p["report_id"]) for o in similarity._matches(0.9)(iter(table.to_batches(max_chunksize=size))) for p in o.to_pylist()]
        assert pairs == [("q0", "r0"), ("q1", "r3")]


def test_queries_leave_python_once(spark):
    """A query used to be copied for every group inside Python: a batch became up to 64 batches at once."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>")
    pairs = similarity.similar_pairs(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "report_id"), 0.5, pivots=8, block=50)
    assert "pivots" in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(v @ v.T >= 0.5), strict=True)}
    got = pairs.select("query_id", "report_id", F.col("cosine")).collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want)


def test_vectors_are_not_copied_for_the_blocks_they_meet(spark):
    """What is written grows with the vectors, not with the blocks that each of them meets."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>")
    pairs = similarity.similar_pairs(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "report_id"), 0.5, pivots=8, block=20)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Generate" not in plan
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(v @ v.T >= 0.5), strict=True)}
    for limit in ("10485760", "-1"):   # one side sent to all tasks, and both sides in parts
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = [(r[0], r[1]) for r in pairs.select("query_id", "report_id").collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert set(got) == want and len(got) == len(want)
