"""Limits in pieces and one behind the other against plain loops, in batch and as a stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from wardlight.operators import admission
from wardlight.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def loop(rows, limit, window):
    """(id, admitted, retry_after) of rows (id, seconds, key), each key on its own."""
    hits, out = {}, []
    for i, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        held = [h for h in hits.get(k, []) if t - h <= window]
        ok = len(held) < limit
        out.append((i, ok, 0 if ok else max(1, int(window - (t - held[0])) + 1)))
        hits[k] = [*held, t] if ok else held
    return sorted(out)


def coupled(rows, per, overall):
    first = {i: (ok, wait) for i, ok, wait in loop(rows, *per)}
    second = {i: (ok, wait) for i, ok, wait in loop([(i, t, "*") for i, t, _ in rows if first[i][0]], *overall)}
    return sorted((i, second[i][0], second[i][1], None if second[i][0] else "overall") if first[i][0] else (i, False, first[i][1], "visitor") for i, _, _ in rows)


def frame(spark, rows):
    data = [(i, START + timedelta(seconds=t), k, "z") for i, t, k in rows]
    return spark.createDataFrame(data, "event_id long, ts timestamp, visitor string, hits string").repartition(5)


def never_silent(n=900, step=(0, 3), seed=1):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randint(*step)
        out.append((i, t, rng.choice(["a", "a", "b", "c", None])))
    return out


@pytest.mark.parametrize("limit,window,step", [(5, 20, (0, 3)), (3, 7, (0, 1)), (1, 10, (9, 11)), (40, 5, (0, 1)), (2, 30, (0, 60))])
def test_one_key_with_every_event(spark, limit, window, step):
    rows = [(i, t, None) for i, t, _ in never_silent(step=step)]
    got = admission.limited_in_pieces(frame(spark, rows), limit, window, [], piece_windows=2).collect()
    assert sorted((r.event_id, r.admitted, r.retry_after) for r in got) == loop(rows, limit, window)


def test_limits_one_behind_the_other(spark):
    rows = never_silent()
    got = admission.admission(frame(spark, rows), ["visitor"], per_visitor=(4, 15), overall=(6, 15), piece_windows=1).collect()
    assert sorted((r.event_id, r.admitted, r.retry_after, r.refused_by) for r in got) == coupled(rows, (4, 15), (6, 15))
    assert {r.refused_by for r in got} == {None, "visitor", "overall"} and all(r.hits == "z" for r in got)


def test_events_without_time_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, START, "a"), (2, START, "a")], "event_id long, ts timestamp, visitor string")
    got = sorted((r.event_id, r.admitted) for r in admission.limited_in_pieces(df, 1, 60, ["visitor"]).collect())
    assert got == [(1, None), (2, False), (2, True)]
    assert admission.admission(df.limit(0), ["visitor"]).count() == 0


def test_stream_of_several_batches(spark, tmp_path):
    rows = never_silent(300)
    for n, part in enumerate((rows[:90], rows[90:91], rows[91:200], rows[200:])):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = "event_id long, ts timestamp, visitor string, hits string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    state.use_state_store(spark)
    out = state.admission_stream(source, ["visitor"], (4, 15), (6, 15), idle_seconds=None)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.event_id, r.admitted, r.retry_after, r.refused_by) for r in got) == coupled(rows, (4, 15), (6, 15))


@pytest.mark.parametrize("piece_rows", [1, 60, 400, 10_000])
def test_pieces_follow_the_rows(spark, piece_rows):
    rows = never_silent()
    got = admission.admission(frame(spark, rows), ["visitor"], per_visitor=(4, 15), overall=(6, 15), piece_rows=piece_rows).collect()
    assert sorted((r.event_id, r.admitted, r.retry_after, r.refused_by) for r in got) == coupled(rows, (4, 15), (6, 15))


def test_rounds_do_not_grow_with_the_time_line(spark, monkeypatch):
    """A line that is full at all times hands every change on, so its rounds are as many as its pieces."""
    rows, passes, before = [(i, 7 * i, None) for i in range(400)], [], admission.staged
    monkeypatch.setattr(admission, "staged", lambda df: passes.append(1) or before(df))
    got = admission.limited_in_pieces(frame(spark, rows), 3, 30, []).collect()
    assert sorted((r.event_id, r.admitted, r.retry_after) for r in got) == loop(rows, 3, 30)
    assert len(passes) == 1
