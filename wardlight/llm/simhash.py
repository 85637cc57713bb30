"""Near duplicates by SimHash fingerprints, matched through an index over several segments of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, each_batch, numbered, split_join, staged, staged_texts
from wardlight.llm.components import connected, forest

#: Words of a shingle, greatest distance of a link, segments of the fingerprint (bits of each, low bits first).
SHINGLE, DISTANCE, SEGMENTS = 4, 4, (22, 21, 21)
#: A segment's ball: with three segments, four differing bits leave at most one for some segment.
RADIUS = DISTANCE // len(SEGMENTS)
SEED = 42
#: Rows of the index that a task looks at together, at least; whole buckets.
CHUNK_ROWS = 500_000
#: Entries of a bucket up to which all of them are compared with all its probes at once.
DENSE = 128


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' 64-bit hashes, as a signed number; of a text without words zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n, hash_of = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    if n == 1:
        return _signed(hash_of(joined, SEED))
    starts = [0, *ends]
    hashes = np.fromiter((hash_of(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):   # bounded memory for very long texts
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _signed(int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, pa.int64())], names=["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, number: str | None = None) -> DataFrame:
    """doc_id, row (its number, if it has one, or else a hash of id and text), fp."""
    row = F.col(number) if number else F.xxhash64("doc_id", "text")
    rows = documents(docs, *[number] * bool(number)).select("doc_id", row.alias("row"), "text")
    return each_batch(rows, "doc_id long, row long, fp long", _fingerprints)


def index_rows(prints: DataFrame) -> DataFrame:
    """bucket, fp, probe: each fingerprint in its own bucket of every segment, and as a probe in all buckets around it."""
    out, shift = None, 0
    for number, width in enumerate(SEGMENTS):
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        flips = [0] + [1 << b for b in range(width)]
        rows = prints.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select(
            (F.lit(number << 32) + own.bitwiseXOR(F.col("flip"))).alias("bucket"), "fp", (F.col("flip") != 0).alias("probe"))
        out, shift = rows if out is None else out.union(rows), shift + width
    return out


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def dense_links(fp: np.ndarray, start: np.ndarray, entries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in many small buckets at once: rows start … start+size-1, entries first. Entry j meets all rows after it."""
    us, vs = [], []
    for j in range(int(entries.max(initial=0))):
        live = entries > j
        first, n = start[live] + j, size[live] - j - 1
        total = int(n.sum())
        if total:
            other = np.repeat(first + 1 - (np.cumsum(n) - n), n) + np.arange(total)
            one = np.repeat(fp[first], n)
            hit = near(one, fp[other])
            us.append(one[hit])
            vs.append(fp[other[hit]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `a`, a place in `b` of one that is near, or -1."""
    found = np.full(len(a), -1)
    step = max(1, 4_000_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        hit = near(a[i : i + step, None], b[None, :])
        any_ = hit.any(1)
        found[i : i + step][any_] = hit[any_].argmax(1)
    return found


def star_links(entries: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect one large bucket as all its links would, without making them all.

    Entries are gathered in stars around pivots. Stars whose pivots are close enough to hold a link, and that are not
    connected yet, are compared until one is found. Probes are linked once to each component that they touch.
    """
    us, vs, stars, rest = [], [], [], entries
    while len(rest):
        held = near(rest, rest[0])
        stars.append(rest[held])
        us.append(rest[held])
        vs.append(np.full(int(held.sum()), rest[0]))
        rest = rest[~held]
    pivots = np.array([s[0] for s in stars], np.uint64)
    root = list(range(len(stars)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(stars)):
        for j in (np.flatnonzero(np.bitwise_count(pivots[i + 1 :] ^ pivots[i]) <= 3 * DISTANCE) + i + 1).tolist():
            if find(i) != find(j):
                at = crossing(stars[i], stars[j])
                hit = np.flatnonzero(at >= 0)[:1]
                if len(hit):
                    root[find(j)] = find(i)
                    us.append(stars[i][hit])
                    vs.append(stars[j][at[hit]])
    groups: dict[int, list[int]] = {}
    for i in range(len(stars)):
        groups.setdefault(find(i), []).append(i)
    for members in groups.values():
        open_ = np.ones(len(probes), bool)
        for i in members:
            left = np.flatnonzero(open_)
            left = left[np.bitwise_count(probes[left] ^ pivots[i]) <= 2 * DISTANCE]
            if len(left):
                at = crossing(probes[left], stars[i])
                hit = at >= 0
                us.append(probes[left[hit]])
                vs.append(stars[i][at[hit]])
                open_[left[hit]] = False
    return np.concatenate(us), np.concatenate(vs)


def bucket_links(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all links in whole buckets; rows sorted by bucket, entries before probes."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, len(bucket)))
    entries = np.add.reduceat((~probe).astype(np.int64), start)
    live = (entries > 0) & (size > 1)
    start, size, entries = start[live], size[live], entries[live]
    small = entries <= DENSE
    us, vs = [], []
    order = np.flatnonzero(small)
    for part in np.array_split(order, max(1, int((entries[order] * size[order]).sum() // 20_000_000))):
        u, v = dense_links(fp, start[part], entries[part], size[part])
        us.append(u)
        vs.append(v)
    for s, e, n in zip(start[~small], entries[~small], size[~small], strict=True):
        u, v = star_links(fp[s : s + e], fp[s + e : s + n])
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
    return forest(u, v)


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by bucket, some whole buckets at a time."""
    def made(bucket, fp, probe):
        u, v = bucket_links(bucket, fp, probe)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)])
        rows += batch.num_rows
        if rows >= CHUNK_ROWS and held[-1][0][-1] != held[-1][0][0]:
            bucket, fp, probe = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            yield made(bucket[:cut], fp[:cut], probe[:cut])
            held, rows = [[bucket[cut:], fp[cut:], probe[cut:]]], len(bucket) - cut
    if rows:
        yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))


def link_forest(prints: DataFrame) -> DataFrame:
    """(u, v): links whose components are those of all links between the distinct fingerprints `fp`."""
    rows = index_rows(prints).repartition("bucket").sortWithinPartitions("bucket", "probe")
    return rows.mapInArrow(_linker, "u long, v long")


def classes(prints: DataFrame, label: str = "component_id") -> DataFrame:
    """fp, component_id (or root, its least fingerprint) for every distinct fingerprint of (doc_id, fp)."""
    own = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected(link_forest(own.select("fp")))
    joined = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    if label == "root":
        return joined.select("fp", "root")
    joined = staged(joined)
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return split_join(joined, least, ["root"]).select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp, component_id of every document: documents that links connect, directly or through others.

    Work is by distinct fingerprint, so exact copies cost one row; index buckets are shuffled, and in a large one only as
    many links are made as connect it. The component is the least doc_id (null ids do not count unless all are null).

    Null or empty text: fingerprint zero, linked like any other. Repeated rows give repeated rows. An empty table gives
    no rows. Other columns are not read.
    """
    prints = staged_texts(fingerprints(docs))
    return split_join(prints, classes(prints), ["fp"]).select("doc_id", "row", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id, with all its columns.

    Rows are told apart by number, so of repeated rows one stays. Whole texts are shuffled once, to the numbers that stay.
    Null and empty texts have fingerprint zero, linked like any other. Null ids come last. An empty table gives no rows.
    Columns of any name are kept.
    """
    rows, number = numbered(docs)
    prints = staged_texts(fingerprints(rows, number))
    found = split_join(prints, classes(prints, "root"), ["fp"])
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    winners = found.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.row").alias(number))
    return rows.join(winners, number, "left_semi").select(*docs.columns)
