"""Substring deduplication: passages that stand earlier in the corpus, found by suffix automata of reference shards.

The corpus is its own reference here, so its automata grow with it and cannot be broadcast. They are cut into shards such
that equal windows always meet: a window belongs to the shard of its minimizer, the least hash of its word groups, and a
shard's automaton is built in the one task that streams the shard's passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, each_batch, split_join, staged, staged_texts

WINDOW, GROUP = 20, 6
#: Occurrences of a minimizer above which its windows are compared one by one instead of in one shard.
HOT = 20_000
#: Word hashes that a worker remembers.
KEPT_WORDS = 1_000_000
#: Passages whose bytes a task remembers to have sent.
SEEN_PASSAGES = 200_000
#: Bytes of a word's hash in a shard; a passage also shares its minimizer's full hash.
WORD_BYTES = 6


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def group_hashes(h: np.ndarray, group: int) -> np.ndarray:
    """A hash of every run of `group` words."""
    n = len(h) - group + 1
    out = np.zeros(n, np.uint64)
    for j in range(group):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def passages(h: np.ndarray, ends: np.ndarray, window: int = WINDOW, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, minimizer hash, first window, windows) of runs of windows that share a minimizer.

    `h` holds the words of several documents in a row, `ends` their ends; no window spans two of them. Equal windows
    have equal minimizer hashes, whatever stands around them.
    """
    n = len(h) - window + 1
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), np.maximum(0, ends - starts - window + 1))
    if not len(doc):
        return (doc, np.zeros(0, np.uint64), doc, doc)
    per = np.maximum(0, ends - starts - window + 1)
    first = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(per) - per), per)
    g, low = group_hashes(h, group), np.uint64((1 << 20) - 1)
    least = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    span, width = window - group + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:n], least[span - width : span - width + n])
    place = first + (((least[first] & low).astype(np.int64) - first) & ((1 << 20) - 1))
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))   # documents share no place
    return doc[start], g[place[start]], (first - starts[doc])[start], np.diff(np.append(start, len(doc)))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        ends = np.cumsum(list(map(len, split)), dtype=np.int64)
        doc, g, first, n = passages(word_hashes(list(chain.from_iterable(split))), ends)
        rows = batch.column("row").to_numpy()
        columns = [g.view(np.int64), rows[doc] if len(doc) else doc, first * 16 + n]
        for i in range(0, max(1, len(doc)), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000], pa.int64()) for c in columns], names=["shard", "row", "at"])


class SuffixAutomaton:
    """Of several word sequences; the longest end of a stream that stands in any of them, word by word."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the longest sequence of p followed by word: q itself, or a copy of it for the shorter ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matching(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest sequence ending there that was added."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def _bring_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each listed passage. Their bytes go along once per task and distinct passage, while memory lasts."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out = []
        for row, doc, text, listed in zip(*[batch.column(n).to_pylist() for n in ("row", "doc_id")], batch.column("text").cast(
                pa.binary()).to_pylist(), batch.column("listed").to_pylist(), strict=True):
            h = word_hashes(text.split())
            cut = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
            for item in listed:
                first, n = item["at"] >> 4, item["at"] & 15
                words = cut[first : first + n + WINDOW - 1].tobytes()
                if item["hot"]:
                    for i in range(n):
                        one = words[WORD_BYTES * i : WORD_BYTES * (i + WINDOW)]
                        out.append((item["shard"], xxhash.xxh3_128_digest(one), row, doc, (first + i) * 16 + 1, True, None))
                    continue
                key = xxhash.xxh3_128_digest(words)
                known = (item["shard"], key) in seen
                if not known and len(seen) < SEEN_PASSAGES:
                    seen.add((item["shard"], key))
                out.append((item["shard"], key, row, doc, item["at"], False, None if known else words))
            if len(out) > 20_000:
                yield _passage_rows(out)
                out = []
        yield _passage_rows(out)


PASSAGE = "shard long, passage binary, row long, doc_id long, at long, hot boolean, words binary"


def _passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PASSAGE.split(", ")])


def _numbers(words: bytes) -> list[int]:
    raw = np.zeros((len(words) // WORD_BYTES, 8), np.uint8)
    raw[:, :WORD_BYTES] = np.frombuffer(words, np.uint8).reshape(-1, WORD_BYTES)
    return raw.view("<u8").ravel().tolist()


def judge_shard(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row, first window, bits) of the windows of a shard's occurrences (passage, row, doc, at, words) that stand earlier.

    Occurrences come in the corpus's order. At least one occurrence of each passage has its words.
    """
    words_of = {key: words for key, _, _, _, words in rows if words is not None}
    first: dict[bytes, tuple[int, int]] = {}
    automaton = SuffixAutomaton() if len(words_of) > 1 else None   # one passage alone meets only its copies
    for key, row, doc, at, _ in rows:
        n, bits = at & 15, 0
        if key in first:
            bits = (1 << n) - 1 if first[key] != (doc, at) else 0
        else:
            first[key] = (doc, at)
            if automaton:
                said = _numbers(words_of[key])
                bits = sum(1 << (i - WINDOW + 1) for i, m in enumerate(automaton.matching(said)) if m >= WINDOW) if len(first) > 1 else 0
                automaton.add(said)
        if bits:
            yield row, at >> 4, bits


def _stream_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and order; a shard is of bounded size (HOT)."""
    def made(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*found, strict=True)) or [(), (), ()])], names=["row", "first", "bits"])

    shard, held, found = None, [], []
    for batch in batches:
        for s, *row in zip(*[batch.column(n).to_pylist() for n in ("shard", "passage", "row", "order", "at", "words")], strict=True):
            if s != shard:
                found += judge_shard(held)
                shard, held = s, []
            held.append(tuple(row))
        if len(found) > 50_000:
            yield made(found)
            found = []
    yield made([*found, *judge_shard(held)])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, texts = [], [], []
        for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if gone:
                edge = np.zeros(len(words) + 1, np.int64)
                for item in gone:
                    for i in range(item["bits"].bit_length()):
                        if item["bits"] >> i & 1:
                            edge[item["first"] + i] += 1
                            edge[item["first"] + i + WINDOW] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                words = [words[i] for i in np.flatnonzero(~covered).tolist()]
            n_removed.append(n_words[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text: each document's words without those of windows that stand earlier, joined by a space.

    Earlier is a smaller doc_id (null: last), or the same document and an earlier word. All windows are judged on the
    input. Steps: (1) minimizers that occur once are set aside, whose windows cannot repeat; (2) the passages around the
    others go to their shards, each in the corpus's order; (3) a passage is streamed through the automaton of what came
    before it in its shard, and windows whose matching statistic reaches the window length are removed, then it is added.
    Copies of a passage are told by a hash and not added again. A minimizer with very many occurrences has no shard: its
    windows are compared by their hashes, counted in parts.

    Null text: no words. Texts of fewer words than a window stay. Repeated rows have the same places, none of which is
    earlier than the other. An empty table gives no rows. Other columns are not read.
    """
    rows = documents(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = staged_texts(each_batch(rows, "shard long, row long, at long", _occurrences))
    counts = staged(found.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))   # a join of two scans can be split
    repeated = found.join(counts, "shard").select("row", F.struct("shard", "at", (F.col("n") > HOT).alias("hot")).alias("item"))
    listed = staged(repeated.groupBy("row").agg(F.collect_set("item").alias("listed")))
    brought = each_batch(rows.join(listed, "row"), PASSAGE, _bring_passages)
    brought = staged_texts(brought.withColumn("order", F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    shards = brought.filter("NOT hot").select("shard", "order", "at", "passage", "row", "words")
    streamed = shards.repartition("shard").sortWithinPartitions("shard", "order", "at")
    spans = streamed.mapInArrow(_stream_shards, "row long, first long, bits long")
    hot = brought.filter("hot").select("passage", "row", F.struct("order", "at").alias("place"))
    least = hot.groupBy("passage").agg(F.min("place").alias("least"))
    single = split_join(hot, least, ["passage"]).filter("place > least").select(
        "row", F.shiftright(F.col("place.at"), 4).alias("first"), F.lit(1).cast("long").alias("bits"))
    gone = staged(spans.union(single).groupBy("row").agg(F.collect_set(F.struct("first", "bits")).alias("gone")))
    return each_batch(rows.join(gone, "row", "left").select("doc_id", "text", "gone"), "doc_id long, n_words long, n_removed long, text string", _remove)

