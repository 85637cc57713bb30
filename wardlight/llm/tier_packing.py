"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wardlight.llm.common import documents, each_batch
from wardlight.llm.tokens import tokenizer

TIERS = (512, 1024, 2048, 4096)
#: Tokens that are packed together; bounds a task's memory.
CHUNK_TOKENS = 4_000_000
#: Windows of one step hold as many tokens as so many of the longest tier.
STEP_WINDOWS = 8
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, "
          "step_group long")


class Shelf:
    """Items by length, with the longest one that fits."""

    def __init__(self):
        self.lengths: list[int] = []
        self.items: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, doc: int, start: int) -> None:
        if length not in self.items:
            insort(self.lengths, length)
            self.items[length] = []
        self.items[length].append((doc, start))

    def take(self, length: int) -> tuple[int, int]:
        found = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return found

    def fitting(self, most: int) -> int:
        """The greatest length up to `most`, else 0."""
        i = bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (window, [(document, start, length), …]) that hold every token once.

    What is over the longest tier is cut off a document in full windows first. The rest is routed to the shortest tier
    that holds it. Tiers are packed from the longest down: a window opens with the tier's longest item, then takes the
    longest item that fits, of its own or of a shorter tier; a gap over 1/128 of the window that no whole item fits is
    filled with the head of the longest item that is left, and its tail goes back to the shelf of its length.
    The last window of all is the smallest tier that holds what it has.
    """
    tiers = tuple(sorted(tiers))
    longest, out, shelf = tiers[-1], [], Shelf()
    for doc, size in enumerate(sizes):
        for start in range(0, size - longest + 1, longest):
            out.append((longest, [(doc, start, longest)]))
        if size % longest:
            shelf.put(size % longest, doc, size - size % longest)
    for window, least in zip(tiers[::-1], (*tiers[-2::-1], 0), strict=True):
        while shelf.lengths and shelf.lengths[-1] > least:
            gap, held = window, []
            while gap and shelf.lengths:
                length = shelf.fitting(gap)
                if not length:
                    if gap <= window // 128:
                        break
                    most = shelf.lengths[-1]
                    doc, start = shelf.take(most)
                    shelf.put(most - gap, doc, start + gap)
                    held.append((doc, start, gap))
                    gap = 0
                else:
                    held.append((*shelf.take(length), length))
                    gap -= length
            filled = window - gap
            out.append((next(t for t in tiers if t >= filled) if not shelf.lengths else window, held))
    return out


def step_groups(windows: list[int], longest: int) -> list[int]:
    """A step for each window: steps get the windows longest first, each the step with the fewest tokens."""
    n = max(1, round(sum(windows) / (STEP_WINDOWS * longest)))
    load, step = [(0, g) for g in range(n)], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        tokens, g = heapq.heappop(load)
        step[i] = g
        heapq.heappush(load, (tokens + windows[i], g))
    return step


def _packer(path: str, end_id: int, tiers: tuple[int, ...]):
    def chunk(docs: list, ids: np.ndarray, sizes: list[int], base: int, steps: int):
        raw, at = ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
        packed = pack(sizes, tiers)
        step = step_groups([w for w, _ in packed], max(tiers))
        rows = []
        for k, (window, held) in enumerate(packed):
            offset = 0
            for doc, start, length in held:
                crc = zlib.crc32(raw[at[doc] + start : at[doc] + start + length])
                rows.append((docs[doc], start, length, crc, sizes[doc], base + k, offset, window, steps + step[k]))
                offset += length
        return rows, len(packed), max(step, default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        base, steps = part, part
        docs, parts, sizes, held = [], [], [], 0

        def flush():
            nonlocal base, steps, docs, parts, sizes, held
            rows, n, m = chunk(docs, np.concatenate(parts), sizes, base, steps)
            base, steps, docs, parts, sizes, held = base + n, steps + m, [], [], [], 0
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            ids, counts = tokenizer(path).encode(batch.column("text").cast(pa.binary()).to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id) if len(ends) else ids
            docs += batch.column("doc_id").to_pylist()
            parts.append(ids)
            sizes += (counts + 1).tolist()
            held += len(ids)
            if held >= CHUNK_TOKENS:
                yield from flush()
        if docs:
            yield from flush()
        tokenizer(path).forget()

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Every document's ids (and `end_id` after them) in packed sequences, one row per piece.

    A task packs what it reads, in chunks of a bounded number of tokens, so nothing is shuffled and a hot source is just
    more chunks. A sequence's id is made of the partition and its number there. `window` is the length that a sequence
    is padded to; `step_group` puts windows into training steps of about equal tokens.

    Null text: empty, a single `end_id`. A null doc_id stays null. Repeated rows are packed as often as they come.
    Ties are packed in reading order. An empty table gives no rows. Other columns are not read.
    """
    return each_batch(documents(docs), SCHEMA, _packer(path, end_id, tiers))
