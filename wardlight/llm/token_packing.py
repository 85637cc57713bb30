"""Packed id matrices: best-fit-decreasing packing of token ids into rows of one length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wardlight.llm.common import documents, each_batch
from wardlight.llm.tokens import tokenizer

#: Tokens that are packed together; bounds a task's memory.
CHUNK_TOKENS = 2_000_000
SCHEMA = ("sequence_id long, n_tokens int, ids binary, segment_ends array<int>, position_resets array<int>, "
          "doc_ids array<long>, starts array<long>, doc_tokens array<long>")


class CapacityTree:
    """Bins by what is left in them; finds the bin with the least room that is enough, in log(capacity) steps.

    Leaf c stands for 'c tokens left'. A node holds the greatest capacity below it that has a bin, or -1; the first
    capacity from c upwards is found by climbing from leaf c to the first right neighbour that is not empty.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = self.leaves + room
        while node and not self.used[node]:
            self.used[node] = 1
            node >>= 1

    def pop(self, least: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the smallest room of at least `least`, taken out."""
        node = self.leaves + least
        if not self.used[node]:
            while node > 1 and not (node % 2 == 0 and self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.used[2 * node])
        room = node - self.leaves
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.used[node] = 0
            while node > 1 and not self.used[node ^ 1]:
                node >>= 1
                self.used[node] = 0
        return room, number


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (all at most `capacity`), longest items first, each into the fullest bin that holds it."""
    tree, bins, n = CapacityTree(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.pop(size)
        if found is None:
            room, number, n = capacity, n, n + 1
        else:
            room, number = found
        bins[i] = number
        if room > size:
            tree.add(room - size, number)
    return bins


def _packer(path: str, end_id: int, length: int):
    def chunk(docs: list, ids: np.ndarray, sizes: np.ndarray, base: int):
        at = np.cumsum(sizes) - sizes
        pieces = -(-sizes // length)                      # documents over `length` are split, nothing is lost
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(length, sizes[doc] - start)
        bins = best_fit(size, length)
        order = np.argsort(bins, kind="stable")
        cuts = np.flatnonzero(np.diff(bins[order])) + 1
        for k, held in enumerate(np.split(order, cuts)):
            row = np.concatenate([ids[at[doc[i]] + start[i] : at[doc[i]] + start[i] + size[i]] for i in held])
            ends = np.cumsum(size[held])
            whole = np.full(length, end_id, "<u4")
            whole[: len(row)] = row
            yield (base + k, len(row), whole.tobytes(), ends.tolist(), (ends - size[held]).tolist(), [docs[i] for i in doc[held]],
                   start[held].tolist(), sizes[doc[held]].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        docs, parts, sizes = [], [], []
        types = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 3]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def flush():
            nonlocal base, docs, parts, sizes
            rows = []
            for row in chunk(docs, np.concatenate(parts), np.concatenate(sizes), base):
                rows.append(row)
                if len(rows) == 500:
                    yield made(rows)
                    base, rows = base + 500, []
            if rows:
                yield made(rows)
            base, docs, parts, sizes = base + len(rows), [], [], []

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            ids, counts = tokenizer(path).encode(batch.column("text").cast(pa.binary()).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            docs += batch.column("doc_id").to_pylist()
            parts.append(ids)
            sizes.append(counts + 1)
            if sum(map(len, parts)) >= CHUNK_TOKENS:
                yield from flush()
        if docs:
            yield from flush()

    return run


def pack_matrix(docs: DataFrame, path: str, end_id: int, length: int = 2048) -> DataFrame:
    """One row per packed sequence: the ids as little-endian unsigned 32-bit numbers, padded with `end_id` to `length`.

    segment_ends are the cumulative lengths of its segments, position_resets the places where positions start at 0
    again; doc_ids, starts and doc_tokens say which part of which document a segment is. `rows_of` gives the ids back.
    A task packs what it reads, in chunks of a bounded number of tokens: no shuffle, and a hot source is more chunks.

    Null text: empty, a single `end_id`. A null doc_id stays null in doc_ids. Repeated rows are packed as often as they
    come; equal lengths in reading order. An empty table gives no rows. Other columns are not read.
    """
    return each_batch(documents(docs), SCHEMA, _packer(path, end_id, length))


def write_matrix(packed: DataFrame, folder: str) -> None:
    """Packed sequences as Parquet files; the ids column of a file is its id matrix, row after row."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def matrix_of(ids: list[bytes]) -> np.ndarray:
    """The id matrix of some rows."""
    return np.stack([np.frombuffer(x, "<u4") for x in ids])
