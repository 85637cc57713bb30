"""What a worker keeps after its task: workers are used again and wait beside those that work."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from wardlight.llm import common, mixing, ngram_join

PINNED = []


def held_mb():
    return sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def hoard(batches):
    """Holds 300 MB in blocks that the C library does not return by itself, as the last one stays."""
    blocks = [bytes(100_000) for _ in range(3000)]
    PINNED.append(bytes(100_000))
    yield from batches
    del blocks


class Frame:
    def mapInArrow(self, run, schema):
        return run


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="no figures of memory")
def test_a_task_gives_back_what_it_held():
    batch, before = pa.record_batch({"x": [1, 2]}), held_mb()
    assert list(common.each_batch(Frame(), "x long", hoard)(iter([batch]))) == [batch]
    assert held_mb() - before < 100


def test_a_task_that_is_ended_early_gives_back_too(monkeypatch):
    calls = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(calls.append)}))
    rows = common.given_back(iter)(iter([1, 2]))
    next(rows)
    rows.close()
    assert calls == [0]


def test_every_python_step_of_near_copies_and_mixing_gives_back():
    for module in (ngram_join, mixing):
        source = Path(module.__file__).read_text()
        assert source.count(".mapInArrow(") == source.count(".mapInArrow(given_back(") > 0
