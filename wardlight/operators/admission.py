"""Limits over a time line that is never silent, decided in pieces, and limits that stand one behind the other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.session import drop_staged, staged

#: Rows of the largest key in a piece, if they are evenly spread, and its pieces at most. A dense line hands each change on to the
#: next piece, so that rounds are as many as its pieces; these are bounded, and a round is one pass.
PIECE_ROWS, MOST_PIECES = 1_000_000, 64
#: Checks of one visitor, and of all together, within so many seconds.
VISITOR_LIMIT, OVERALL_LIMIT = (8, 60.0), (120, 60.0)

STATE = "key_ string, piece_ long, hits_ array<double>"


def _walk(batches: Iterator[pa.RecordBatch], limit: int, window: float) -> Iterator[tuple[pa.RecordBatch, list[int | None], list[tuple]]]:
    """Each batch with the waiting time of its rows (0: admitted, null: an entry state) and the states of pieces that end in it.

    Rows are sorted by key, piece and time; the row without a time holds the state that a piece is entered with.
    """
    at, hits = None, []
    for batch in batches:
        waits, ended = [], []
        for key, piece, now, entry in zip(*[batch.column(c).to_pylist() for c in ("key_", "piece_", "t_", "hits_")], strict=True):
            if (key, piece) != at:
                if at is not None:
                    ended.append((*at, hits))
                at, hits = (key, piece), []
            if now is None:
                hits = list(entry or [])
                waits.append(None)
                continue
            first = next((i for i, h in enumerate(hits) if now - h <= window), len(hits))
            hits = hits[first:] if first else hits
            if len(hits) >= limit:
                waits.append(max(1, int(window - (now - hits[0])) + 1))
            else:
                hits.append(now)
                waits.append(0)
        yield batch, waits, ended
    if at is not None:
        yield None, [], [(*at, hits)]


def _states(limit: int, window: float, start: float, length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ended in _walk(batches, limit, window):
            # what the next piece can still see, and a second more for the rounding of its edge
            rows = [(k, p, [h for h in hits if h >= start + (p + 1) * length - window - 1]) for k, p, hits in ended]
            k, p, h = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(p, pa.int64()), pa.array(h, pa.list_(pa.float64()))], names=["key_", "piece_", "hits_"])
    return run


def _decisions(limit: int, window: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, waits, _ in _walk(batches, limit, window):
            if batch is not None:
                live = pa.array([w is not None for w in waits], pa.bool_())
                held = batch.select(names).filter(live)
                waits = [w for w in waits if w is not None]
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array([not w for w in waits], pa.bool_()), pa.array(waits, pa.int64())], names=[*names, "admitted", "retry_after"])
    return run


def _grid(line: DataFrame, window: float, piece_windows: int | None, piece_rows: int) -> tuple[float, float, int]:
    """Start, length and number of the pieces of a line of (key_, t_): by rows of the largest key, or of so many windows."""
    largest, first, last = line.groupBy("key_").agg(F.count(F.lit(1)).alias("n"), F.min("t_").alias("a"), F.max("t_").alias("b")).agg(
        F.max("n"), F.min("a"), F.max("b")).first()
    if largest is None:
        return 0.0, float(window), 0
    start = float(math.floor(first))
    if piece_windows is None:
        length = max(window, math.ceil((last - start + 1) / min(MOST_PIECES, math.ceil(largest / piece_rows))))
    else:
        length = window * max(1, piece_windows)
    return start, float(length), int((last - start) / length) + 1


def limited_in_pieces(events: DataFrame, limit: int, window: float, keys: list[str], ts: str = "ts", tie: str = "event_id",
                      piece_windows: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds admitted and retry_after. Only admitted events count towards the limit, of a key or, without keys, of all.

    The time line is cut into pieces of a window or more, as few as the rows of the largest key ask for, or of
    `piece_windows` windows each. A piece depends on what was admitted within one window before it, so
    on the piece before alone. All pieces are decided as if nothing came before; then those whose entry state is another one
    are decided again, until no state changes. The first piece is right at once and each round makes the next one right, so
    it ends; pieces with a calm window in them stop the change at once. No task holds more than a piece's sorted rows in a
    stream, and a key with very many events is many pieces. A line of one piece is right at once.

    Events without a time get null for both. Ties are decided in the order of `tie`. Repeated rows count each.
    """
    spark = events.sparkSession
    timed = events.withColumn("key_", F.to_json(F.struct(*keys)) if keys else F.lit("")).withColumn("t_", F.col(ts).cast("timestamp").cast("double"))
    timed = staged(timed.filter("t_ IS NOT NULL"))
    start, length, pieces = _grid(timed, float(window), piece_windows, piece_rows)
    line = timed.withColumn("piece_", F.floor((F.col("t_") - start) / length).cast("long")).withColumn("hits_", F.lit(None).cast("array<double>"))

    def entered(rows: DataFrame, states: DataFrame) -> DataFrame:
        entries = states.select("key_", (F.col("piece_") + 1).alias("piece_"), "hits_")
        both = rows.unionByName(entries, allowMissingColumns=True)
        return both.repartition("key_", "piece_").sortWithinPartitions("key_", "piece_", "t_", tie)

    def settled() -> DataFrame:
        nothing = spark.createDataFrame([], STATE)
        decide = lambda rows, states: staged(entered(rows, states).mapInArrow(_states(limit, float(window), start, length), STATE))
        states = decide(line.select("key_", "piece_", "t_", tie, "hits_"), nothing)
        fresh = states.filter(F.size("hits_") > 0)
        while True:
            after = fresh.select("key_", (F.col("piece_") + 1).alias("piece_"))
            again = line.select("key_", "piece_", "t_", tie, "hits_").join(after, ["key_", "piece_"], "left_semi")
            redone = decide(again, fresh)
            # An entry state without events after it goes on as a piece of its own: it is not one.
            redone = redone.join(states.select("key_", "piece_"), ["key_", "piece_"], "left_semi")
            old = states.select("key_", "piece_", F.col("hits_").alias("before_"))
            changed = staged(redone.join(old, ["key_", "piece_"]).filter("NOT (hits_ <=> before_)").select("key_", "piece_", "hits_"))
            if not changed.head(1):
                break
            last, states = states, staged(states.join(changed, ["key_", "piece_"], "left_anti").unionByName(changed))
            drop_staged(last)
            fresh = changed
        return states

    names = [c for c in line.columns if c not in ("key_", "piece_", "t_", "hits_")]
    kept = events.schema.add("admitted", "boolean").add("retry_after", "long")
    states = settled() if pieces > 1 else spark.createDataFrame([], STATE)
    known = states.select("key_", "piece_").withColumn("piece_", F.col("piece_") - 1)
    decided = entered(line, states.join(known, ["key_", "piece_"], "left_semi")).mapInArrow(_decisions(limit, float(window), names), kept)
    return decided.unionByName(events.filter(F.col(ts).cast("timestamp").isNull()), allowMissingColumns=True)


def admission(events: DataFrame, visitor: list[str], ts: str = "ts", tie: str = "event_id", per_visitor: tuple[int, float] = VISITOR_LIMIT,
              overall: tuple[int, float] = OVERALL_LIMIT, piece_windows: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds admitted, retry_after and refused_by (visitor, overall or null).

    A visitor's limit comes first and counts what it admits, also what the limit over everybody then refuses; that one
    counts what both admit.
    """
    first = staged(limited_in_pieces(events, *per_visitor, visitor, ts, tie, piece_windows, piece_rows))
    refused = first.filter("NOT coalesce(admitted, true)").withColumn("refused_by", F.lit("visitor"))
    passed = first.filter("coalesce(admitted, true)").drop("admitted", "retry_after")
    second = limited_in_pieces(passed, *overall, [], ts, tie, piece_windows, piece_rows)
    return refused.unionByName(second.withColumn("refused_by", F.when(~F.col("admitted"), "overall")))
