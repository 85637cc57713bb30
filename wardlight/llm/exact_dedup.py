"""Exact deduplication against a minimal perfect hash of the digests seen before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, numbered, split_join, staged, without_white

#: Digests of one part of the index. Digests are uniform, so parts are even.
PART_DIGESTS = 20_000
#: Bits per key that is still to be placed, on each level of the hash.
GAMMA = 2

BEST = "struct<less:long,no_id:boolean,id:long,row:long>"
INDEX = f"part int, level_bits array<int>, bits binary, digests binary, best array<{BEST}>, counts array<long>"


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of 64-bit keys for a level."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A slot of its own in 0 … n-1 for each of n distinct 64-bit keys.

    On every level a key is hashed into GAMMA bits per key that is left. Keys alone in their bit are placed there, the
    others go on to the next level. A key's slot is the number of set bits before its bit.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits) - bits

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys are not distinct")
        while len(keys):
            size = GAMMA * len(keys) + 1
            at = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels).astype(np.int64) if levels else np.zeros(0, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, any slot or -1."""
        found, start, open_ = np.full(len(keys), -1), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = start + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            found[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
            start += size
        return found


def keys_of(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest that have no part in choosing its part of the index."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8")


def digested(docs: DataFrame, number: str | None = None) -> DataFrame:
    """doc_id, row (its number, if it has one), digest (of the text without white space), chars (code points of the text itself)."""
    row = (F.col(number) if number else F.lit(0)).cast("long").alias("row")
    return documents(docs, row).select("doc_id", "row", F.unhex(F.sha2(without_white(F.col("text")), 256)).alias("digest"),
                                  F.length("text").cast("long").alias("chars"))


def distinct_digests(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per digest (and keys): its best row (most characters, then smallest id; a null id last) and the number of rows."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")
    return rows.groupBy(*keys, "digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))


def part_of(digest: Column, parts: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def _build(group: pa.Table) -> pa.Table:
    digests = group.column("digest").to_pylist()
    keys = keys_of(digests)
    made = PerfectHash.of(keys)
    order = np.argsort(made.slots(keys))
    take = pa.array(order)
    held = group.take(take)
    list_of = lambda name: pa.array([held.column(name).to_pylist()], pa.list_(held.column(name).type))
    return pa.table({
        "part": pa.array(group.column("part").to_pylist()[:1], pa.int32()), "level_bits": pa.array([made.sizes], pa.list_(pa.int32())),
        "bits": pa.array([np.packbits(made.bits.astype(np.uint8)).tobytes()], pa.binary()),
        "digests": pa.array([b"".join(digests[i] for i in order)], pa.binary()), "best": list_of("best"), "counts": list_of("n")})


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """The index of distinct digests: one row per part, with the hash, and in each slot the full digest and its best row."""
    return history.withColumn("part", part_of(F.col("digest"), parts)).groupBy("part").applyInArrow(_build, INDEX)


def _look_up(index: pa.Table, rows: pa.Table) -> pa.Table:
    digests = rows.column("digest").to_pylist()
    slots, held, best, counts = [], b"", [], []
    if index.num_rows:
        row = index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["level_bits"])).astype(np.int64)
        slots = PerfectHash(row["level_bits"], bits).slots(keys_of(digests)).tolist()
        held, best, counts = row["digests"], row["best"], row["counts"]
    member = [s >= 0 and held[32 * s : 32 * s + 32] == d for s, d in zip(slots, digests, strict=True)] if slots else [False] * len(digests)
    order = lambda b: (b["less"], b["no_id"], b["id"] if b["id"] is not None else 0, b["row"])
    new_best, new_n, seen = rows.column("best").to_pylist(), rows.column("n").to_pylist(), set()
    out = []
    for i, d in enumerate(digests):
        if member[i]:
            s = slots[i]
            seen.add(s)
            out.append((d, min(best[s], new_best[i], key=order), counts[s] + new_n[i], True))
        else:
            out.append((d, new_best[i], new_n[i], False))
    out += [(held[32 * s : 32 * s + 32], best[s], counts[s], True) for s in range(len(best)) if s not in seen]
    d, b, n, m = zip(*out, strict=True)
    kind = pa.struct([("less", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())])
    return pa.table({"digest": pa.array(d, pa.binary()), "best": pa.array(b, kind), "n": pa.array(n, pa.int64()),
                     "historical": pa.array(m, pa.bool_())})


def look_up(index: DataFrame, arrivals: DataFrame, parts: int) -> DataFrame:
    """digest, best, n, historical: the groups of history with what came to them, and those of digests that were not in it.

    A slot's full digest is compared byte by byte, since a perfect hash gives a slot for strangers, too.
    """
    rows = arrivals.withColumn("part", part_of(F.col("digest"), parts))
    return index.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(_look_up, f"digest binary, best {BEST}, n long, historical boolean")


def digest_groups(rows: DataFrame, historical: Column) -> DataFrame:
    """digest, best, n, historical of all digested rows; those where `historical` holds are the history."""
    both = staged(distinct_digests(rows.withColumn("_old", F.coalesce(historical, F.lit(False))), "_old"))
    old, new = both.filter("_old").drop("_old"), both.filter("NOT _old").drop("_old")
    parts = max(1, -(-both.count() // PART_DIGESTS))
    return look_up(staged(build_index(old, parts)), new, parts)


def deduplicate(docs: DataFrame, historical: Column) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. `historical` marks the rows seen before.

    Texts are equal if they are without white space. Of equal texts the one with most code points stays, then the
    smallest doc_id; null ids come last. Groups of one need no join. The rows of larger groups are dealt over several
    tasks per digest, and all counting is by digest first, so a group may hold any share of the rows.

    Null text: empty, equal to other empty texts. Of repeated rows one stays. An empty table gives no rows. Other
    columns are not read.
    """
    rows = staged(digested(docs))
    groups = staged(digest_groups(rows, historical))
    shown = lambda df, keep: df.select(
        F.col("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), keep.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    single = shown(groups.filter("n = 1").withColumn("doc_id", F.col("best.id")), F.lit(True))
    counted = rows.groupBy("doc_id", "digest", "chars").agg(F.count(F.lit(1)).alias("times"))
    shared = split_join(counted, groups.filter("n > 1"), ["digest"]).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    wins = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.less")) & (F.col("time") == 1)
    return single.unionByName(shown(shared, wins))


def keep_first(docs: DataFrame, historical: Column) -> DataFrame:
    """The rows that stay, with all their columns. `historical` marks by doc_id the rows seen before.

    Rows are told apart by number, so of repeated rows, and of texts of one id, length and content without white space, one
    stays. Whole texts are shuffled once, to the winners' numbers. Null text: empty, equal to other empty texts; one stays.
    Null ids come last. An empty table gives no rows. Columns of any name are kept.
    """
    rows, number = numbered(docs)
    winners = digest_groups(digested(rows, number), historical).select(F.col("best.row").alias(number))
    return rows.join(winners, number, "left_semi").select(*docs.columns)
