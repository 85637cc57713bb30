"""Vector codes, n-gram join and spelling variants against plain readings of their rules."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASH, frame, odd_texts, words

from wardlight.llm import ngram_join, spelling, vector_codes


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def shingle_set(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def components(ids, sets):
    """The least id reachable over links, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        least[find(i)].append(k)
    known = {r: min((k for k in group if k is not None), default=None) for r, group in least.items()}
    return [known[find(i)] for i in range(len(ids))]


def joined(spark, rows, **options):
    got = ngram_join.similar_documents(frame(spark, rows, **options)).collect()
    sets = [shingle_set(t) for _, t, _ in rows]
    want = [(i, len(s), c) for (i, _, _), s, c in zip(rows, sets, components([r[0] for r in rows], sets), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ngram_join(spark):
    joined(spark, odd_texts())


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_documents(frame(spark, [])).collect() == []
    joined(spark, [(1, None, None), (2, "", "s"), (3, " \n", "s"), (None, "a b", "s"), (4, "A  B", "s"), (5, "a b c d e", "s")])


def near_copies(many, edits, seed=5, length=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    rows = []
    for i in range(many):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(length)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text), "s"))
    return rows


@pytest.mark.parametrize("edits", [1, 3])
def test_ngram_join_of_many_near_copies(spark, edits):
    joined(spark, near_copies(150, edits))


def test_ngram_join_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 20)
    joined(spark, near_copies(90, 3, seed=9))


def test_tiles_find_what_comparing_all_finds():
    rng = random.Random(4)
    base = rng.sample(range(10_000), 80)
    sets = [np.array(sorted({*rng.sample(base, rng.randint(66, 80)), *rng.sample(range(10_000), 4), 5}), np.int64) for _ in range(600)]
    at = [int(np.searchsorted(s, 5)) for s in sets]
    suffix = [np.bincount(s[s > 5] & 7, minlength=8).tolist() for s in sets]
    side = rng.choices([3, 7], k=600)
    table = pa.table({"key": [5] * 600, "node": range(600), "n": [len(s) for s in sets], "single": [0] * 600, "place": at, "label": range(600),
                      "suffix": pa.array(suffix, pa.list_(pa.int32())), "side": side, "keys": [s.tobytes() for s in sets]})
    u, v = ngram_join.tile_links(table)
    want = set()
    for i in range(600):
        for j in range(i):
            both = np.intersect1d(sets[i], sets[j])
            if side[i] != side[j] and both.min() == 5 and 5 * len(both) >= 4 * len(np.union1d(sets[i], sets[j])):
                want.add((j, i))
    assert {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)} == want and want


def test_filters_keep_every_link():
    """Length, place and suffix filters at any shared key of any linked pair."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        x = sorted(rng.sample(range(200), n))
        y = sorted({*rng.sample(x, max(1, n - rng.randint(0, n // 6))), *rng.sample(range(200), rng.randint(0, n // 6))})
        if 100 * len({*x} & {*y}) < 80 * len({*x} | {*y}):
            continue
        for key in {*x[: int(ngram_join.prefix_length(len(x)))]} & {*y[: int(ngram_join.prefix_length(len(y)))]}:
            side = lambda s: np.bincount([k & 7 for k in s if k > key], minlength=8).tolist()  # noqa: E731, B023
            table = pa.table({"key": [key] * 2, "node": [1, 2], "n": [len(x), len(y)], "single": [0, 0], "place": [x.index(key), y.index(key)], "label": [1, 2],
                              "suffix": pa.array([side(x), side(y)], pa.list_(pa.int32()))})
            assert len(ngram_join.Rows(table).pairs(np.array([0]), np.array([1]))[0]) == 1
        assert {*x[: int(ngram_join.prefix_length(len(x)))]} & {*y[: int(ngram_join.prefix_length(len(y)))]}


def spelled(rows):
    total = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) > 6 and n > 1}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = spelled(rows)
    beside = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n)


def letters_text(seed, many, alphabet="abcé"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    weight = [200 // (i + 1) + 1 for i in range(60)]
    return [(i, " ".join(rng.choices(pool, weight, k=120)) + "-ABCabcabc ÀÉ×÷ßÿabc", "s") for i in range(many)]


SHOWN = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("most", [50_000, 15])
def test_spelling_variants(spark, most):
    rows = [*letters_text(4, 40), (None, "Variant variants VARIANT variants\nvariant", None), (7, None, None), (8, "", "s"), (9, "x" * 40_000 + " " + "x" * 40_000, "s"),
            (7, "abcabca " * 50, "s"), (7, "abcabca " * 50, "s")]
    got = spelling.spelling_variants(frame(spark, rows), most, 500).select(*SHOWN).collect()
    assert sorted(map(tuple, got)) == variants(rows)


def test_spelling_of_odd_texts(spark):
    rows = odd_texts()
    got = spelling.spelling_variants(frame(spark, rows)).select(*SHOWN).collect()
    assert sorted(map(tuple, got)) == variants(rows)
    assert spelling.spelling_variants(frame(spark, [])).collect() == []


def test_one_edit_moves_counts_by_two_at_most():
    rng = random.Random(8)
    for _ in range(500):
        a = "".join(rng.choice("abcdÿàé") for _ in range(rng.randint(7, 12)))
        i, c = rng.randrange(len(a)), rng.choice("abxÿ")
        for b, most in ((a[:i] + c + a[i + 1 :], 2), (a[:i] + c + a[i:], 1)):
            va, vb = (spelling.letters(spelling.coded([w])) for w in (a, b))
            assert np.bitwise_count(va ^ vb)[0] <= most
            if a != b:
                assert spelling.one_edit(spelling.coded([a]), spelling.coded([b]))[0]


def plain_codes(rows, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = np.array([[int(np.floor(x * 4096)) for x in v] for _, v, _ in kept], object).reshape(len(kept), 8, -1)
    books = parts[:entries].transpose(1, 0, 2).copy()

    def nearest():
        away = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        return away.argmin(2), away.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(8):
            for e in range(books.shape[1]):
                mine = parts[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code, away = nearest()
    by = Counter()
    for (_, _, label), a in zip(kept, away, strict=True):
        by[label] += a.sum()
    text = ",".join(str(x) for x in books.ravel())
    import hashlib

    digest = hashlib.sha256(text.encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in row), int(a.sum()), int(by[label]), digest) for (i, _, label), row, a in zip(kept, code.tolist(), away, strict=True)]


def vectors(spark, rows):
    extra = [c for c in CLASH if c != "label"] + ["at", "value", "v", "code", "error"]
    schema = "vec_id long, embedding array<float>, label int" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], schema).repartition(3)


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_VALUES", 64 * 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02, 64)).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(700)]
    rows += [(i, rows[5][1], 4) for i in range(1000, 1200)]                       # one common vector
    rows += [(i, (np.round(rng.normal(0, 0.001, 64), 3)).tolist(), 5) for i in range(1300, 1400)]   # ties
    rows += [rows[0], rows[0], (2000, None, 1), (2001, [None] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [float("inf")] + [0.0] * 63, 1),
             (None, rows[3][1], None), (2004, [0.0] * 64, None)]
    got = vector_codes.vector_codes(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]), key=repr)


def test_few_vectors(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).collect() == []
    rows = [(5, [0.5] * 8, 1), (4, [0.25] * 8, 1), (3, [0.25] * 8, None)]
    got = vector_codes.vector_codes(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows))
    coded, books = vector_codes.compress(vectors(spark, [(1, [1.0] * 3, 1), (2, [], 1), (3, [3e38] * 12, 1)]))
    assert coded.count() == 3 and books.shape == (8, 3, 2) and books.max() == vector_codes.MOST


def test_balls_are_owned():
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.integers(-50, 50, (800, 8)) + c for c in (0, 4000, -9000)])
    tree = vector_codes.Tree(rows)
    entries = np.stack([rows[0], rows[900], rows[1700], rows[1]])
    seen = sum(len(at) for at, _, exact in tree.owned(entries) if exact is not None)
    code, error = tree.codes(entries)
    away = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (code == away.argmin(1)).all() and (error == away.min(1)).all() and seen < len(rows) / 2
    assert (tree.totals(entries)[:, 0] == np.bincount(away.argmin(1), minlength=4)).all()
