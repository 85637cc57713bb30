"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Shingles are counted over the whole corpus in blocks: a block of documents asks each range of keys how many documents hold
them, and gets back those that stand in more than one. A shingle of one document can be in no intersection, so what comes
back is all that a join and its verification need, and documents whose prefix holds nothing but such shingles are done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, given_back, split_join, staged
from wardlight.llm.components import connected

#: Words of a shingle. Two documents link at a Jaccard similarity of at least 4/5.
SHINGLE = 5
#: A block ends at so many documents (they are numbered in 16 bits) or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 2000, 4_000_000
#: A key in so many documents of one block is counted there and asked for once.
BLOCK_HOT = 64
#: Bits of a key, ranges of the keys for each shuffle partition, ranges of a suffix that are compared by their sizes.
KEY_BITS, RANGES, SUFFIXES = 48, 8, 8
#: Rows of a prefix key up to which all its pairs are looked at; those of larger ones are, after stars, in tiles of two sides.
SMALL, TILE = 48, 1000
#: Rows and columns of the blocks in which a tile counts what its documents share.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 4096
INFO, HELD = -1, -2


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Of two sets with n shingles together, those that they must share."""
    return (4 * n + 8) // 9


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    split = [t.lower().split() for t in texts]
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64)
    runs = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(runs)]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(29)
    out, at = [], 0
    for words in split:
        if len(words) >= SHINGLE:
            out.append(np.unique(runs[at : at + len(words) - SHINGLE + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64))
        at += len(words)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; sorted keys compress once their bytes stand by place."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays), 1)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    sizes, at, out = np.frombuffer(data, np.uint32, len(types)), 4 * len(types), []
    for n, kind in zip(sizes.tolist(), types, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        size = pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = start + max(1, int(np.searchsorted(np.cumsum(size[start : start + BLOCK_DOCS]), BLOCK_BYTES, "right")))
            part = batch.slice(start, end - start)
            yield part, part.column("text").cast(pa.binary()).to_pylist()
            start = end


ASKED = "block long, part int, data binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    b, p, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], names=["block", "part", "data"])


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        for batch, texts in _blocks(batches):
            sets = shingles(texts)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.uint8).reshape(-1, 16)
            ids, none = batch.column("doc_id").fill_null(0).to_numpy(), np.asarray(batch.column("doc_id").is_null())
            out = [(number, INFO, pack(ids, none.astype(np.uint8), sizes, np.ascontiguousarray(digests).view("V16").ravel()))]
            keys = np.concatenate(sets) >> np.uint64(64 - KEY_BITS)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(keys)))
            many = counts >= BLOCK_HOT
            hot = np.repeat(many, counts)
            if many.any():
                out.append((number, HELD, pack(keys[hot], owner[hot])))
            hot_keys, hot_counts = keys[starts[many]], counts[many].astype(np.uint32)
            keys, owner = keys[~hot], owner[~hot]
            part, hot_part = range_of(keys, parts), range_of(hot_keys, parts)
            for p in np.union1d(part, hot_part).tolist():
                a, b = np.searchsorted(part, [p, p + 1])
                c, d = np.searchsorted(hot_part, [p, p + 1])
                out.append((number, p, pack(keys[a:b], owner[a:b], hot_keys[c:d], hot_counts[c:d])))
            for i in range(0, len(out), 500):
                yield _asked(out[i : i + 500])
            number += 1
    return run


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """Rows with the same value of a column, of batches that are sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][name] != row[name]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, those of its entries whose key stands in two documents or more, with the number of documents.

    Rows that ask for nothing go on as they are.
    """
    for rows in _groups(batches, "part"):
        if rows[0]["part"] < 0:
            yield from (_asked([(r["block"], r["part"], r["data"])]) for r in rows)
            continue
        found = [unpack(r["data"], "u8", "u2", "u8", "u4") for r in rows]
        keys = np.concatenate([k for f in found for k in (f[0], f[2])])
        weight = np.concatenate([w for f in found for w in (np.ones(len(f[0])), f[3])])
        _, at = np.unique(keys, return_inverse=True)
        df = np.minimum(np.bincount(at, weight)[at], (1 << 32) - 1).astype(np.uint32)
        out, start = [], 0
        for row, (own, owner, hot, _) in zip(rows, found, strict=True):
            n = df[start : start + len(own)]
            hot_n = df[start + len(own) : start + len(own) + len(hot)]
            start += len(own) + len(hot)
            live = n > 1
            if live.any() or len(hot):
                out.append((row["block"], 0, pack(own[live], owner[live], n[live], hot, hot_n)))
        for i in range(0, len(out), 500):
            yield _asked(out[i : i + 500])


def _read_info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            ids, none, sizes, digests = unpack(data, "i8", "u1", "i8", "V16")
            yield pa.RecordBatch.from_arrays(
                [pa.array((block << 16) + np.arange(len(ids))), pa.array(ids, mask=none.astype(bool)), pa.array(sizes), pa.array([d.tobytes() for d in digests], pa.binary())],
                names=["node", "doc_id", "n", "digest"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, single, keys of the documents that can have a partner: what stands in other documents, rarest first."""
    for rows in _groups(batches, "block"):
        chosen = [x for r in rows for x in r["chosen"] or []]
        if not chosen:
            continue
        n = np.zeros(1 << 16, np.int64)
        n[[x["node"] & 0xFFFF for x in chosen]] = [x["n"] for x in chosen]
        parts, hot, held = [], [], None
        for r in rows:
            if r["chosen"] is None and r["part"] == HELD:
                held = unpack(r["data"], "u8", "u2")
            elif r["chosen"] is None:
                *own, keys, counts = unpack(r["data"], "u8", "u2", "u4", "u8", "u4")
                parts.append(own)
                hot.append((keys, counts))
        if held:
            keys, counts = (np.concatenate(x) for x in zip(*hot, strict=True))
            order = np.argsort(keys)
            parts.append([*held, counts[order][np.searchsorted(keys[order], held[0])]])
        if not parts:
            continue
        keys, owner, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = n[owner] > 0
        keys, owner, df = keys[live], owner[live], df[live]
        order = np.lexsort((keys, df, owner))
        keys, owner = keys[order], owner[order]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends, size = np.append(starts[1:], len(owner)), n[owner[starts]]
        single = size - (ends - starts)
        live = single < prefix_length(size)
        block = rows[0]["block"] << 16
        for i in range(0, int(live.sum()), 500):
            at = np.flatnonzero(live)[i : i + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block + owner[starts[at]].astype(np.int64)), pa.array(size[at]), pa.array(single[at]),
                 pa.array([keys[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)], pa.binary())], names=["node", "n", "single", "keys"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, n, single, place, suffix: the prefix of each document without shingles that stand in it alone."""
    for batch in batches:
        for node, n, single, keys in zip(*[batch.column(c).to_pylist() for c in ("node", "n", "single", "keys")], strict=True):
            keys = np.frombuffer(keys, np.int64)
            m = int(prefix_length(n)) - single
            sizes = np.bincount(keys & (SUFFIXES - 1), minlength=SUFFIXES) - np.cumsum(np.eye(SUFFIXES, dtype=np.int64)[keys[:m] & (SUFFIXES - 1)], axis=0)
            suffix = pa.ListArray.from_arrays(np.arange(0, SUFFIXES * m + 1, SUFFIXES, dtype=np.int32), pa.array(sizes.ravel().astype(np.int32)))
            same = lambda x: pa.array(np.full(m, x))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(keys[:m]), same(node), same(n), same(single), pa.array(single + np.arange(m)), suffix],
                                             names=["key", "node", "n", "single", "place", "suffix"])


PREFIX = "key long, node long, n long, single long, place long, suffix array<int>"


class Rows:
    """Prefix rows as arrays."""

    def __init__(self, table: pa.Table):
        self.key, self.node, self.n, self.place, self.label = (table.column(c).to_numpy() for c in ("key", "node", "n", "place", "label"))
        self.suffix = table.column("suffix").combine_chunks().flatten().to_numpy().reshape(-1, SUFFIXES).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows a and b of one key, the pairs that the filters leave: other components, lengths, places, suffixes."""
        live = self.label[a] != self.label[b]
        a, b = a[live], b[live]
        x, y, p, q = self.n[a], self.n[b], self.place[a], self.place[b]
        shared = least_overlap(x + y)
        live = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (np.minimum(p, q) + np.minimum(x - p, y - q) >= shared)
        a, b, most = a[live], b[live], (x + y - 2 * shared)[live]
        apart = np.abs(self.place[a] - self.place[b]) + np.abs(self.suffix[a] - self.suffix[b]).sum(1)
        return a[apart <= most], b[apart <= most]


def small_pairs(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one key; rows are sorted by key."""
    us, vs, here = [], [], np.arange(len(rows.key))
    for step in range(1, len(here)):
        a = here[: len(here) - step]
        a = a[rows.key[a] == rows.key[a + step]]
        if not len(a):
            break
        u, v = rows.pairs(a, a + step)
        us.append(rows.node[u])
        vs.append(rows.node[v])
    return (np.concatenate(us), np.concatenate(vs)) if us else (here[:0], here[:0])


def star_pairs(large: DataFrame) -> DataFrame:
    """u, v: each row with two others of its key, if the filters leave them: that with the least share of shingles of its own,
    and one by a hash of the node. A key's two are found by partial aggregation, so it may have any number of rows."""
    other = F.struct("node", "n", "place", "suffix")
    hub = F.struct((F.col("single") / F.col("n")).alias("by"), other.alias("row"))
    drawn = F.struct(F.xxhash64("node", F.col("key") % 4).alias("by"), other.alias("row"))
    pivots = large.groupBy("key").agg(F.array(F.min(hub).getField("row"), F.min(drawn).getField("row")).alias("pivots"))
    both = split_join(large, pivots, ["key"]).select("*", F.explode("pivots").alias("o")).select(
        "node", "n", "place", "suffix", F.col("o.node").alias("node_"), F.col("o.n").alias("n_"), F.col("o.place").alias("place_"), F.col("o.suffix").alias("suffix_"))
    apart = F.abs(F.col("place") - F.col("place_")) + F.aggregate(F.zip_with("suffix", "suffix_", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.withColumn("shared", F.floor((4 * (F.col("n") + F.col("n_")) + 8) / 9)).filter("node <> node_ AND 5 * least(n, n_) >= 4 * greatest(n, n_)").filter(
        F.least("place", "place_") + F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) >= F.col("shared")).filter(
        apart <= F.col("n") + F.col("n_") - 2 * F.col("shared")).select(F.least("node", "node_").alias("u"), F.greatest("node", "node_").alias("v"))


def shared_keys(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The number of keys that the sets a and b have in common, for all pairs, by products of blocks of their incidence."""
    out, used = np.zeros(len(a), np.int64), np.unique(np.concatenate([a, b]))
    keys = np.concatenate([sets[i] for i in used.tolist()])
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
    names, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    live = times[at] > 1
    row, at = row[live], column[at[live]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    block = a // BLOCK_ROWS
    for low in range(0, int(column[-1]) + 1 if len(names) else 0, BLOCK_COLUMNS):
        i, j = np.searchsorted(at, [low, low + BLOCK_COLUMNS])
        dense = np.zeros((len(used), BLOCK_COLUMNS), np.float32)
        dense[row[i:j], at[i:j] - low] = 1
        for k in np.unique(block).tolist():
            mine = np.flatnonzero(block == k)
            product = dense[k * BLOCK_ROWS : (k + 1) * BLOCK_ROWS] @ dense.T
            out[mine] += product[a[mine] - k * BLOCK_ROWS, b[mine]].astype(np.int64)
    return out


def tile_links(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of one key and tile; in a tile of two sides (numbers from zero) those of different sides.

    Pairs that have a key before this one in both prefixes are left to that key. What the others share is counted here.
    """
    rows, side = Rows(table), table.column("side").to_numpy()
    sets = [np.frombuffer(k, np.int64) for k in table.column("keys").to_pylist()]
    before = [s[: p - x] for s, p, x in zip(sets, rows.place.tolist(), table.column("single").to_pylist(), strict=True)]
    us, vs, here = [], [], np.arange(len(sets))
    for i in range(0, len(sets), BLOCK_ROWS):
        a, b = (x.ravel() for x in np.meshgrid(here[i : i + BLOCK_ROWS], here, indexing="ij"))
        live = (a < b) & ((side[a] != side[b]) | (side[a] < 0))
        u, v = rows.pairs(a[live], b[live])
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    for held in (before, sets):
        if len(u):
            n = shared_keys(u, v, held)
            live = n == 0 if held is before else 100 * n >= 80 * (rows.n[u] + rows.n[v] - n)
            u, v = u[live], v[live]
    return rows.node[u], rows.node[v]


def _pair_rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])


def _chunks(batches: Iterator[pa.RecordBatch], least: int, *names: str) -> Iterator[pa.Table]:
    """Some whole groups of sorted rows at a time, of so many rows at least."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        changed = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in names:
            changed |= np.diff(batch.column(c).to_numpy()) != 0
        edges = np.flatnonzero(changed) + 1 + rows - batch.num_rows
        if rows >= least and len(edges):
            table, cut = pa.Table.from_batches(held), int(edges[-1])
            yield table.slice(0, cut)
            held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _chunks(batches, 50_000, "key"):
        yield _pair_rows(*small_pairs(Rows(table)))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _chunks(batches, 1, "key", "tile"):
        key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            yield _pair_rows(*tile_links(table.slice(i, j - i)))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y, a, b in zip(*[batch.column(c).to_pylist() for c in ("n_u", "n_v", "keys_u", "keys_v")], strict=True):
            shared = len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True))
            good.append(100 * shared >= 80 * (x + y - shared))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(good, pa.bool_())], names=["u", "v", "good"])


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """u, v, good of each pair of nodes, by the whole sets."""
    side = lambda c: held.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))
    return staged(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(given_back(_verify), "u long, v long, good boolean"))


def replayable(df: DataFrame) -> DataFrame:
    """`df` if it only scans files, whose rows come in the same order when a lost task runs again, or a staged copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "Exchange" not in plan and "Scan" in plan else staged(df)


def counted(docs: DataFrame, write: Callable[[DataFrame], DataFrame] = staged) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id, n, digest of every document; node, n, single, keys of one document per set that can have a partner).

    `write` stages what reads the texts; blocks end where batches do.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = replayable(documents(docs)).mapInArrow(given_back(_ask(parts)), ASKED)
    to = F.when(F.col("part") < 0, F.hash("block")).otherwise(F.col("part"))
    sent = write(asked.repartition(to).sortWithinPartitions("part").mapInArrow(given_back(_count), ASKED))
    info = staged(sent.filter(F.col("part") == INFO).mapInArrow(given_back(_read_info), "node long, doc_id long, n long, digest binary"))
    first = info.filter("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.first("n").alias("n"))
    chosen = first.groupBy(F.shiftright("node", 16).alias("block")).agg(F.collect_list(F.struct("node", "n")).alias("chosen"))
    none = F.lit(None).cast("array<struct<node:long,n:long>>").alias("chosen")
    sent = sent.filter(F.col("part") != INFO).select("*", none).unionByName(chosen.select(
        "block", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("data"), "chosen"))
    return info, staged(sent.repartition("block").sortWithinPartitions("block").mapInArrow(given_back(_gather), "node long, n long, single long, keys binary"))


def links(held: DataFrame, few: int = SMALL) -> DataFrame:
    """(u, v): links whose components are those of all links between the sets of `held`.

    All pairs of a prefix key with `few` rows that pass the filters are verified. In a key with many, each row is compared with
    two of them first, so that near copies of one text, however many, fall into one component without all their pairs; then
    pairs that are still in different components are looked at in tiles of bounded size, which hold the sets themselves.
    """
    rows = held.mapInArrow(given_back(_prefixes), PREFIX)
    rows = staged(rows)
    kinds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = staged(split_join(rows, kinds, ["key"]))
    small, large = rows.filter(F.col("m") <= few).withColumn("label", F.col("node")), rows.filter(F.col("m") > few)
    pairs = small.repartition("key").sortWithinPartitions("key").mapInArrow(given_back(_small), "u long, v long")
    found = verified(pairs.union(star_pairs(large)).distinct(), held).filter("good").select("u", "v")
    if not large.head(1):
        return found
    roots = connected(found).select("node", F.col("root").alias("label"))
    labelled = staged(split_join(large, roots, ["node"], "left").withColumn("label", F.coalesce("label", "node")))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("m") / TILE)).cast("int")
    dealt = split_join(labelled, open_, ["key"]).withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = F.least("own", "other").cast("long") * F.col("tiles") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    dealt = dealt.select("key", "node", "n", "single", "place", "suffix", "label", tile.alias("tile"), side.alias("side")).join(held.select("node", "keys"), "node")
    return found.union(dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(given_back(_tiles), "u long, v long"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document, read whole.

    A document's set holds its distinct shingles of five lower-case words (A-Z only; with fewer words the whole sequence).
    Documents link at a Jaccard similarity of 4/5; component_id is the least doc_id that links reach, itself included.

    Shingles are compared by 48 bits of their hashes, whole sets by 128. Each pair of different sets is verified at most
    once, and pairs of a large group that links connect already are not. Equal sets are one node of the join.

    Null or empty texts, and texts of white space: an empty set, linked with nothing; component_id is the doc_id. Null ids
    count only where a component has no other. Repeated rows are documents with equal sets. An empty table gives no rows.
    Other columns are not read.
    """
    info, held = counted(docs)
    found = connected(links(held))
    sets = info.filter("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"))
    rooted = staged(sets.join(found, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = split_join(rooted, least, ["root"]).select("digest", "component_id")
    shown = split_join(info.filter("n > 0"), named, ["digest"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return shown.unionByName(info.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
