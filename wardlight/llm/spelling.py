"""Spelling variants of words, found by k-d trees over letter-count vectors.

One edit moves a word's letter counts by at most two in L1 distance. Letter counts stand in 64 bits: two bits for each of 32
letters, none, one or both set for a count of none, one or more. The L1 distance of such vectors is the number of bits that
differ, never more than that of the counts, and a box around some words is what all of them and what any of them have set.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, staged

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many runs loses a letter.
LOSES = 31
#: A form is so many times as frequent as its variant.
TIMES = 10
#: Words of a cell, and those that the planes between cells are fitted on, at most.
CELL_WORDS, SAMPLE_WORDS = 25_000, 50_000
#: Words of a leaf of a tree, words that a task counts before it passes them on, pairs that are looked at together.
LEAF_WORDS, COUNTED_WORDS, PAIRS = 24, 300_000, 2_000_000
_ALL = (1 << 64) - 1


def _letter_bits() -> np.ndarray:
    """For each code point the place of its letter: a to z, and six places for the others."""
    place = np.zeros(256, np.int64)
    place[97:123] = np.arange(26)
    place[192:256] = 26 + np.arange(64) % 6
    return place


_PLACE = _letter_bits()


def run_words(doc_id: int | None, text: bytes, least: int = LEAST_LENGTH) -> Counter:
    """How often each word stands in a text: its runs of letters, some without the letter that the hash names."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(re.findall(r"[a-zÀ-ÿ]{%d,}" % least, text.lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % LOSES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            found[run] += n
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[pa.RecordBatch]:
        words, n = pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([words[i : i + 100_000], n[i : i + 100_000]], names=["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            for word, n in run_words(doc_id, text.as_py()).items():
                total[word] += n
            if len(total) > COUNTED_WORDS:
                yield from made()
                total.clear()
    yield from made()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of the words that occur often enough."""
    return documents(docs).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letters(words: np.ndarray) -> np.ndarray:
    """Words of one length (a row of Latin-1 codes each) as letter counts in 64 bits."""
    once, twice = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        bit = np.uint64(1) << (2 * _PLACE[words[:, j]]).astype(np.uint64)
        twice |= once & bit
        once |= bit
    return once | twice << np.uint64(1)


def best_bit(vectors: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The bit that halves the vectors best, and which of them have it; None if all are the same."""
    bits = np.unpackbits(vectors.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    uneven = np.abs(2 * bits.sum(0, dtype=np.int64) - len(vectors))
    bit = int(uneven.argmin())
    return (bit, bits[:, bit].astype(bool)) if uneven[bit] < len(vectors) else None


def cells_of(vectors: np.ndarray, words: int, most: int = CELL_WORDS) -> list[tuple[int, int]]:
    """(bits that are set, bits that are not) of cells that cut `words` words, of which the vectors are a sample."""
    out, open_ = [], [(vectors, 0, 0)]
    while open_:
        held, ones, zeros = open_.pop()
        split = best_bit(held) if words * len(held) > most * len(vectors) and len(held) > 1 else None
        if split is None:
            out.append((ones, zeros))
            continue
        bit, has = split
        open_ += [(held[has], ones | 1 << bit, zeros), (held[~has], ones, zeros | 1 << bit)]
    return out


def coded(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def box_distance(vectors: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Of vectors from the box of those that have the bits `ones` set and the bits `zeros` not."""
    return np.bitwise_count((~vectors & np.uint64(ones)) | (vectors & np.uint64(zeros)))


ROUTED = "cell int, role int, word string, n long"
POINT, REPLACED, LONGER = 0, 1, 2


def _router(cells: dict[int, list[tuple[int, int, int]]]):
    """Each word to the cell it lies in, and to those with words of its length, or one letter more, that are near enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            n, length = batch.column("n").to_numpy(), np.fromiter(map(len, words), np.int64, len(words))
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                vectors = letters(coded([words[i] for i in at.tolist()]))
                for roles, others in (((POINT, REPLACED), cells[size]), ((LONGER,), cells.get(size + 1, []))):
                    for cell, ones, zeros in others:
                        distance = box_distance(vectors, ones, zeros)
                        for role in roles:
                            go = at[distance <= (0, 2, 1)[role]]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(go), cell, np.int32)), pa.array(np.full(len(go), role, np.int32)),
                                 pa.array([words[i] for i in go.tolist()], pa.string()), pa.array(n[go])], names=["cell", "role", "word", "n"])
    return run


class Tree:
    """A k-d tree over the letter counts of words of one length."""

    def __init__(self, words: list[str], n: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], np.array([n[i] for i in order])
        self.codes = coded(self.words)
        self.vectors = letters(self.codes)
        self.root = self._node(np.arange(len(words)))

    def _node(self, at: np.ndarray) -> tuple:
        """(bits that all have, bits that none has, points of a leaf or None, children)."""
        held = self.vectors[at]
        ones, zeros = int(np.bitwise_and.reduce(held)), _ALL ^ int(np.bitwise_or.reduce(held))
        split = best_bit(held) if len(at) > LEAF_WORDS else None
        return (ones, zeros, at, ()) if split is None else (ones, zeros, None, (self._node(at[split[1]]), self._node(at[~split[1]])))

    def near(self, vectors: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, points) whose letter counts are at most so far apart."""
        us, vs, held, open_ = [], [], 0, [(self.root, np.arange(len(vectors)))]
        while open_:
            (ones, zeros, points, children), q = open_.pop()
            q = q[box_distance(vectors[q], ones, zeros) <= most]
            if not len(q):
                continue
            open_ += [(child, q) for child in children]
            if points is None:
                continue
            step = max(1, PAIRS // len(points))
            for i in range(0, len(q), step):
                u, v = np.nonzero(np.bitwise_count(vectors[q[i : i + step], None] ^ self.vectors[points][None]) <= most)
                us.append(q[i : i + step][u])
                vs.append(points[v])
                held += len(u)
                if held > PAIRS:
                    yield np.concatenate(us), np.concatenate(vs)
                    us, vs, held = [], [], 0
        if us:
            yield np.concatenate(us), np.concatenate(vs)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a become those of b by replacing one letter, or where b is one longer by inserting one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= a.shape[1]


NEAR = "word string, n_near long, form_n long, form string"


def _best(owner: np.ndarray, other: np.ndarray, names: list[str], words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """For each owner the number of its near words, and the first of them by frequency, then by the order of words."""
    order = np.lexsort((other, -n[other], owner))   # words are in order
    owner, other = owner[order], other[order]
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    best = other[start]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in owner[start].tolist()], pa.string()), pa.array(np.diff(np.append(start, len(owner)))), pa.array(n[best]),
         pa.array([words[i] for i in best.tolist()], pa.string())], names=["word", "n_near", "form_n", "form"])


def matches(tree: Tree, role: int, words: list[str], n: list[int]) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(words)), key=words.__getitem__)
    words, n = [words[i] for i in order], np.array([n[i] for i in order])
    codes = coded(words)
    for u, v in tree.near(letters(codes), 2 if role == REPLACED else 1):
        good = one_edit(codes[u], tree.codes[v])
        u, v = u[good], v[good]
        yield _best(u, v, words, tree.words, tree.n)
        if role == LONGER:
            yield _best(v, u, tree.words, words, n)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and role: the words of a cell first, then those that look for near words in it."""
    tree, at, points, asking = None, None, ([], []), ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal tree
        if points[0]:
            tree = Tree(*points)
            for held in points:
                held.clear()
        if tree and asking[0]:
            by_length = sorted(range(len(asking[0])), key=lambda i: len(asking[0][i]))
            for _, rows in groupby(by_length, key=lambda i: len(asking[0][i])):
                rows = list(rows)
                yield from matches(tree, at[1], [asking[0][i] for i in rows], [asking[1][i] for i in rows])
        for held in asking:
            held.clear()

    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("cell", "role", "word", "n")], strict=True)
        for (cell, role), group in groupby(rows, key=lambda r: r[:2]):
            if at is not None and (cell, role) != at:
                yield from flush()
                if cell != at[0]:
                    tree = None
            at = (cell, role)
            held = points if role == POINT else asking
            for _, _, word, n in group:
                held[0].append(word)
                held[1].append(n)
            if role != POINT and len(asking[0]) >= 20_000:
                yield from flush()
    yield from flush()


def cell_planes(words: DataFrame, most: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, list[tuple[int, int, int]]]:
    """For each length its cells (number, bits that are set, bits that are not), fitted on a bounded sample of the words."""
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}
    sample: dict[int, list[str]] = {}
    share = 2 * sample_words / max(1, sum(sizes.values()))   # tasks pass on about twice the sample together, not each a whole one
    drawn = words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((1 << 20) * share) + 1)
    for (word,) in drawn.orderBy(F.xxhash64("word", F.lit(1)), "word").limit(sample_words).collect():
        sample.setdefault(len(word), []).append(word)
    cells, number = {}, 0
    for size, n in sorted(sizes.items()):
        made = cells_of(letters(coded(sample[size])), n, most) if size in sample else [(0, 0)]
        cells[size] = [(number + i, *c) for i, c in enumerate(made)]
        number += len(made)
    return cells


def near_words(words: DataFrame, most: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """word, n_near, form_n, form: the number of words one edit away, and the most frequent of them, in parts."""
    routed = words.mapInArrow(_router(cell_planes(words, most, sample_words)), ROUTED)
    return routed.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(_search, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form). Forms are more frequent at each step, so chains end."""
    held = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        step = held.alias("a").join(held.select(F.col("word").alias("at"), F.col("root").alias("next")), F.col("a.root") == F.col("at"), "left")
        held = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not held.filter("moved").head(1):
            return held.select("word", "root")


def spelling_variants(docs: DataFrame, most: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of the whole texts.

    Words are runs of letters in lower case (A-Z only), one in 31 of them, chosen by a hash of document and run, without one
    letter; those of seven letters or more that occur twice or more. Near words are one edit away. A word's form is the most
    frequent near word (ties: first in code-point order) if it occurs ten times as often or more; its root is the last form.

    Null or empty texts have no words. A null doc_id is hashed as nothing. Repeated rows count each. An empty table gives no
    rows. Words and texts may be of any length. Other columns are not read.
    """
    words = staged(word_counts(docs))
    near = near_words(words, most, sample_words).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    joined = staged(joined.select("word", "n", "n_near", *[F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n")]))
    ends = roots(joined.filter("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
