"""Vector code compression: codebooks of vector parts, fitted over metric trees that the anchors hierarchy builds.

Vectors are dealt into chunks; each part position of a chunk has a tree of balls with sums and counts. A round of the fit
walks the trees with a list of candidate entries, which a ball passes on to its children without those that another entry
beats everywhere in it. A ball with one candidate left is owned: its sums count for that entry and nothing below is read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import split_join, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components beyond this are cut to it, so that squares and sums stay within 64 bits.
MOST = 1 << 28
#: Components of a chunk, and points of a ball that is not cut further.
CHUNK_VALUES, LEAF_POINTS = 1 << 18, 12


class Ball:
    __slots__ = ("sums", "count", "radius", "points", "children")

    def __init__(self, sums, count, radius, points=None, children=()):
        self.sums, self.count, self.radius, self.points, self.children = sums, count, radius, points, children


def anchors(points: np.ndarray, many: int) -> np.ndarray:
    """The anchor that owns each point. A new anchor is the point furthest from that of the widest one, and takes from each
    other anchor the points that are nearer to it; those within half the distance of both anchors cannot be."""
    held, owner, at = [0], np.zeros(len(points), np.int64), points.astype(np.float64)
    away = np.sqrt(((at - at[0]) ** 2).sum(1))
    while len(held) < many:
        new = int(away.argmax())
        if not away[new]:
            break
        between = np.sqrt(((at[held] - at[new]) ** 2).sum(1))
        asked = np.flatnonzero(2 * away >= between[owner])
        distance = np.sqrt(((at[asked] - at[new]) ** 2).sum(1))
        taken = distance < away[asked]
        owner[asked[taken]], away[asked[taken]] = len(held), distance[taken]
        owner[new], away[new] = len(held), 0
        held.append(new)
    return owner


def merged(balls: list[Ball]) -> Ball:
    """One ball over all, by merging the two whose common ball is smallest until one is left."""
    sums = np.array([b.sums for b in balls], np.float64)
    count = np.array([b.count for b in balls], np.float64)
    radius = np.array([b.radius for b in balls])
    held, live = list(balls), np.ones(len(balls), bool)

    def common(i: int) -> np.ndarray:
        total = count[i] + count
        centre = (sums[i] + sums) / total[:, None]
        reach = np.maximum(np.sqrt(((centre - sums[i] / count[i]) ** 2).sum(1)) + radius[i], np.sqrt(((centre - sums / count[:, None]) ** 2).sum(1)) + radius)
        reach[~live] = np.inf
        reach[i] = np.inf
        return reach

    size = np.array([common(i) for i in range(len(balls))])
    for _ in range(len(balls) - 1):
        i, j = (int(x) for x in np.unravel_index(size.argmin(), size.shape))
        held[i] = Ball(held[i].sums + held[j].sums, held[i].count + held[j].count, float(size[i, j]), children=(held[i], held[j]))
        sums[i], count[i], radius[i] = held[i].sums, held[i].count, held[i].radius
        live[j] = False
        size[j], size[:, j] = np.inf, np.inf
        size[i] = common(i)
        size[:, i] = size[i]
    return held[int(np.flatnonzero(live)[0])]


def grown(points: np.ndarray, weight: np.ndarray, at: np.ndarray) -> Ball:
    """The tree over some points: from the middle out, anchors below their common balls, and each anchor's own tree."""
    if len(at) > LEAF_POINTS:
        owner = anchors(points[at], math.isqrt(len(at) - 1) + 1)
        if owner.any():
            return merged([grown(points, weight, at[owner == k]) for k in range(owner.max() + 1)])
    held = points[at]
    sums, count = weight[at] @ held, int(weight[at].sum())
    return Ball(sums, count, float(np.sqrt(((held - sums / count) ** 2).sum(1).max())), points=at)


class Tree:
    """Balls as arrays, each over a run of points. `places` leads from the rows of the chunk to their points."""

    def __init__(self, rows: np.ndarray):
        points, places, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        balls, order, open_ = [], [], [(grown(points, weight, np.arange(len(points))), -1)]
        self.up = []
        while open_:   # in this order the points below a ball follow one another
            ball, up = open_.pop()
            self.up.append(up)
            open_ += [(child, len(balls)) for child in ball.children]
            balls.append((ball, len(order)))
            if ball.points is not None:
                order += ball.points.tolist()
        self.sums, self.count = np.array([b.sums for b, _ in balls]), np.array([b.count for b, _ in balls])
        self.radius, self.start = np.array([b.radius for b, _ in balls]), np.array([s for _, s in balls])
        self.leaf = np.array([b.points is not None for b, _ in balls])
        self.end = self.start + np.array([len(b.points) if b.points is not None else 0 for b, _ in balls])
        for i in range(len(balls) - 1, 0, -1):
            self.end[self.up[i]] = max(self.end[self.up[i]], self.end[i])
        children = np.argsort(self.up, kind="stable")[1:].reshape(-1, 2) if len(balls) > 1 else np.zeros((0, 2), np.int64)
        self.children = np.full((len(balls), 2), -1)
        self.children[~self.leaf] = children
        self.points, self.weight = points[order], weight[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.places = place[places.reshape(-1)]

    def owned(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(balls, their entries, None) and (points, their entries, distances) that together are all points.

        An entry is left out of a ball's list if another is nearer to all points in it by more than rounding errors. Points
        of a leaf are compared exactly; of entries at the same distance the lower one wins, and of equal entries the first.
        """
        lists = np.zeros((1, len(entries)), bool)
        lists[0, np.unique(entries, axis=0, return_index=True)[1]] = True
        between = np.sqrt(((entries[:, None] - entries[None]).astype(np.float64) ** 2).sum(2))
        balls = np.zeros(1, np.int64)
        while len(balls):
            centre = self.sums[balls] / self.count[balls, None]
            away = ((centre[:, None] - entries[None]) ** 2).sum(2)
            best = np.where(lists, away, np.inf).argmin(1)
            least = away[np.arange(len(balls)), best][:, None]
            lists = lists & (away - least <= 2 * self.radius[balls, None] * (1 + 1e-9) * between[best] + 1e-9 * (away + least) + 1e-3)
            lists[np.arange(len(balls)), best] = True
            one = lists.sum(1) == 1
            yield balls[one], best[one], None
            leaf = ~one & self.leaf[balls]
            if leaf.any():
                at, size = balls[leaf], self.end[balls[leaf]] - self.start[balls[leaf]]
                points = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                exact = ((self.points[points, None] - entries[None]) ** 2).sum(2)
                exact[~np.repeat(lists[leaf], size, axis=0)] = np.iinfo(np.int64).max
                entry = exact.argmin(1)
                yield points, entry, exact[np.arange(len(points)), entry]
            down = ~one & ~self.leaf[balls]
            lists, balls = np.repeat(lists[down], 2, axis=0), self.children[balls[down]].ravel()

    def totals(self, entries: np.ndarray) -> np.ndarray:
        """For each entry the number and the sums of the parts that are nearest to it."""
        out = np.zeros((len(entries), 1 + entries.shape[1]), np.int64)
        for at, entry, exact in self.owned(entries):
            count, sums = (self.count[at], self.sums[at]) if exact is None else (self.weight[at], self.points[at] * self.weight[at, None])
            np.add.at(out, entry, np.concatenate([count[:, None], sums], axis=1))
        return out

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry and the distance of each row of the chunk."""
        entry = np.zeros(len(self.points), np.int64)
        for at, found, exact in self.owned(entries):
            if exact is None:
                size = self.end[at] - self.start[at]
                at = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found = np.repeat(found, size)
            entry[at] = found
        return entry[self.places], ((self.points - entries[entry]) ** 2).sum(1)[self.places]


def whole(vectors: list[list[float]], width: int) -> np.ndarray:
    """Integer components, filled up with zeros to the common width."""
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), width), np.int64)
    flat = np.fromiter((x for v in vectors for x in v), np.float64)
    with np.errstate(over="ignore"):
        out[np.arange(width) < size[:, None]] = np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64)
    return out


def _chunks(width: int):
    most = max(1, CHUNK_VALUES // width)

    def made(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        parts = whole(vectors, width).reshape(len(vectors), PARTS, -1)
        trees = [pickle.dumps(vars(Tree(parts[:, p])), protocol=5) for p in range(PARTS)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array(
            [trees], pa.list_(pa.binary()))], names=["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                for out, column in zip(held, batch.slice(i, most).columns, strict=True):
                    out += column.to_pylist()
                if len(held[0]) >= most:
                    yield made(*(x[:most] for x in held))
                    held = tuple(x[most:] for x in held)
        if held[0]:
            yield made(*held)
    return run


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int, Tree]]:
    for row in range(batch.num_rows):
        for p, data in enumerate(batch.column("trees")[row].as_py()):
            tree = Tree.__new__(Tree)
            vars(tree).update(pickle.loads(data))
            yield p, tree


def _totals(entries: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((*entries.shape[:2], 1 + entries.shape[2]), np.int64)
        for batch in batches:
            for p, tree in _trees(batch):
                sums[p] += tree.totals(entries[p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "value"])
    return run


def _coded(entries: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids, labels = (one.column(c)[0].values for c in ("vec_ids", "labels"))
                codes, error = zip(*[tree.codes(entries[p]) for p, tree in _trees(one)], strict=True)
                raw = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                text = [raw[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(np.sum(error, 0))], names=["vec_id", "label", "code", "error"])
    return run


def fit_codebooks(chunks: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after some rounds; a round brings its totals, a few numbers an entry, here."""
    for _ in range(rounds):
        sums = np.zeros((*entries.shape[:2], 1 + entries.shape[2]), object)
        found = chunks.select("trees").mapInArrow(_totals(entries), "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")))
        for at, value in found.collect():
            sums.ravel()[at] = int(value)
        entries = np.array([[[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(part, olds.tolist(), strict=True)]
                            for part, olds in zip(sums.tolist(), entries, strict=True)], np.int64).reshape(entries.shape)
    return entries


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept vector; the codebooks: part, entry, component).

    Rows whose vector is null or holds null or non-finite components are dropped. The codebooks start from the smallest ids
    (null ids last, equal ids by their vectors); with fewer rows they have fewer entries. Vectors shorter than the longest,
    or than a multiple of eight components, are filled up with zeros; integer components beyond 2**28 are cut to it. Equal
    vectors of a chunk are one point with a count. Repeated rows are coded each. An empty table gives no rows. Labels are
    carried as strings, null ones as null. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & ~bad)
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").limit(entries).collect()
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(PARTS, -(-width // PARTS) * PARTS)
    books = whole([v for (v,) in first], width).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    chunks = staged(rows.mapInArrow(_chunks(width), "vec_ids array<long>, labels array<string>, trees array<binary>"))
    if first:
        books = fit_codebooks(chunks, np.ascontiguousarray(books), rounds)
    return chunks.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector; label_error is the error of all its label."""
    coded, books = compress(vectors)
    coded = staged(coded.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return split_join(coded, totals, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
