"""Line frequency, exact and substring deduplication, SimHash and personal data against plain readings of their rules."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import frame, odd_texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.llm import exact_dedup, line_frequency, pii, simhash, substring_dedup

ROWS = odd_texts()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lines(rows):
    lines_of = defaultdict(set)
    for _, text, host in {(t or "", t or "", h or "") for _, t, h in rows}:
        for line in text.split("\n"):
            if words(line):
                lines_of[host, re.sub("[0-9]+", "0", " ".join(words(line)).lower())].add(text)
    return {k for k, texts in lines_of.items() if len(texts) > line_frequency.MOST_DOCUMENTS}


def plain_quality(rows):
    frequent, out = plain_lines(rows), []
    for i, text, host in rows:
        text, host, w = text or "", host or "", words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        counts = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
        seen, again, gone = set(), 0, 0
        for line in text.split("\n"):
            n = len(words(line))
            if n:
                again += line in seen
                seen.add(line)
            if n and (host, re.sub("[0-9]+", "0", " ".join(words(line)).lower())) in frequent:
                gone += n
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(repeated), failed,
                    not failed and not len(w) - gone < 0.3 * len(w), gone))
    return out


QUALITY = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def test_line_frequency(spark):
    got = [tuple(r[c] for c in QUALITY) for r in line_frequency.judge(frame(spark, ROWS)).collect()]
    want = plain_quality(ROWS)
    assert Counter(got) == Counter(want)
    assert any(w[-1] and w[-2] for w in want) and any(w[-1] and not w[-2] and not w[-3] for w in want)


def test_cleaned_documents(spark):
    df = frame(spark, ROWS)
    got = Counter((r.doc_id, r.text) for r in line_frequency.clean_documents(df).collect())
    frequent = plain_lines(ROWS)
    want = Counter()
    for (i, text, host), verdict in zip(ROWS, plain_quality(ROWS), strict=True):
        if verdict[7]:
            want[i, "\n".join(x for x in text.split("\n") if (host or "", re.sub("[0-9]+", "0", " ".join(words(x)).lower())) not in frequent)] += 1
    assert got == want
    assert line_frequency.clean_documents(df).columns == df.columns


@pytest.mark.parametrize("length", [25, 26, 400])
def test_lines_of_any_length_are_frequent(spark, length):
    prose = lambda i, n: " ".join(f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))
    notice = " ".join(f"Notice{k}" for k in range(length))
    rows = [(i, f"{prose(i, 600)}\n{notice} {i}", "h") for i in range(11)] + [(20, f"{notice} 7\n{prose(20, 60)}\n{notice} 8", "h"), (21, f"{prose(21, 70)}\n{notice} 9", "g")]
    judged = {r.doc_id: (r.n_removed, r.kept) for r in line_frequency.judge(frame(spark, rows)).collect()}
    depleted = 60 < 0.3 * (60 + 2 * (length + 1))
    assert judged == {**{i: (length + 1, True) for i in range(11)}, 20: (2 * (length + 1), not depleted), 21: (0, True)}
    cleaned = {r.doc_id: r.text for r in line_frequency.clean_documents(frame(spark, rows)).collect()}
    assert cleaned == {**{i: prose(i, 600) for i in range(11)}, **({} if depleted else {20: prose(20, 60)}), 21: rows[-1][1]}


def test_a_large_host_has_the_same_limit(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, " ".join(f"{name(i)}{name(k)}" for k in range(60)), "h") for i in range(1500)]
    rows = [(i, t + ("\nAll rights reserved, 2024." if i < 11 else "\nIn ten documents." if i < 21 else ""), h) for i, t, h in rows]
    judged = line_frequency.judge(frame(spark, rows)).filter("n_removed > 0").collect()
    assert sorted((r.doc_id, r.n_removed) for r in judged) == [(i, 4) for i in range(11)]


def plain_exact(rows):
    groups = defaultdict(list)
    for n, (i, text, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, n))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, sha(norm)))
    return Counter(out)


@pytest.mark.parametrize("old", ["doc_id % 2 = 0", "true", "false"])
def test_exact_dedup(spark, old):
    got = exact_dedup.deduplicate(frame(spark, ROWS), F.expr(old)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == plain_exact(ROWS)


def test_exact_keeps_one_row_of_each_text(spark):
    df = frame(spark, ROWS)
    got = exact_dedup.keep_first(df, F.col("doc_id") % 2 == 0)
    assert got.columns == df.columns
    want = Counter(k[:1] for k, n in plain_exact(ROWS).items() if k[3])
    assert Counter((r.doc_id,) for r in got.collect()) == want


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys, strangers):
    keys = np.array(sorted(keys), np.uint64)
    made = exact_dedup.PerfectHash.of(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert all(-1 <= s < len(keys) for s in made.slots(np.array(strangers, np.uint64)).tolist())


def plain_repeats(rows, window=20):
    first = {}
    for i, text, _ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            place = (i is None, i or 0, k)
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, place), place)
    out = []
    for i, text, _ in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (i is None, i or 0, k) for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def passages_of_many(seed=5):
    """Shared passages that overlap, repeat within a document and stand next to each other."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool)[rng.randint(0, 10) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
                 for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 1000), " ".join(w for p in parts for w in p), "s"))
    return [*rows, (2000, "z " * 90, "s"), (2001, "z " * 70 + "y " * 30, "s"), (2002, "a b " * 40, "s")]


@pytest.mark.parametrize("rows", [ROWS, passages_of_many()], ids=["odd", "passages"])
@pytest.mark.parametrize("hot", [substring_dedup.HOT, 3])
def test_substring_dedup(spark, monkeypatch, rows, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == plain_repeats(rows)


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.integers(0, 3), max_size=15))
@settings(max_examples=150, deadline=None)
def test_matching_statistics(held, stream):
    automaton = substring_dedup.SuffixAutomaton()
    for words_ in held:
        automaton.add(words_)
    stands = {tuple(h[a:b]) for h in held for a in range(len(h)) for b in range(a + 1, len(h) + 1)}
    want = [max((n for n in range(1, e + 1) if tuple(stream[e - n : e]) in stands), default=0) for e in range(1, len(stream) + 1)]
    assert automaton.matching(stream) == want


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    rows = [r for r in ROWS if r[0] != 155]
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    label = plain_components(prints)
    least = {}
    for (i, _, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, p, least.get(c)) for (i, _, _), p, c in zip(rows, prints, label, strict=True))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


@pytest.mark.parametrize("dense", [simhash.DENSE, 2])
def test_links_connect_what_all_links_connect(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres[:6]:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(k, p - 2**64 if p >> 63 else p) for k, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp % 2**64: r.component_id for r in simhash.classes(df).collect()}
    label = plain_components(prints)
    least = {c: min(k for k in range(len(prints)) if label[k] == c) for c in set(label)}
    assert got == {p: least[c] for p, c in zip(prints, label, strict=True)}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


PIECES = ["a@b.co", "@", ".", "x.y-z@q", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "0" * 16, "+1 (555) 010-9999",
          "+", " ", "-", "7", "call 555 123 4567", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "amex card 378282246310005", "é", "\n", "_", "%", "(", "12.34"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)
    found = pii.find(text)
    assert found[: len(plain_spans(text))] == plain_spans(text)


def test_added_spans():
    kinds = lambda text: [(k, text[s:e]) for k, s, e in pii.find(text)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("my amex card 378282246310005") == [("short_card", "378282246310005")] and kinds("number 378282246310005") == []
    assert kinds("ssn: 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("call 555 123 4567") == [("local_phone", "555 123 4567")] and kinds("sums 555 123 4567") == []


def test_personal_data_rows_and_time(spark):
    rows = [*ROWS, (500, "a" * 400_000 + "@", "s"), (501, "1" * 300_000, "s"), (502, "1." * 150_000, "s"), (503, "+1" * 100_000, "s"), (504, "1 " * 150_000, "s")]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    assert Counter((r.doc_id, len(r.spans)) for r in got) == Counter((i, len(pii.find(t or ""))) for i, t, _ in rows)
    hidden = pii.hide_personal_data(frame(spark, [(1, "to a@b.co or 1.2.3.4", "s")])).first()
    assert hidden.text == "to <email> or <ip>"


def test_empty_tables(spark):
    none = frame(spark, ROWS).limit(0)
    assert line_frequency.judge(none).count() == line_frequency.clean_documents(none).count() == 0
    assert exact_dedup.deduplicate(none, F.lit(True)).count() == exact_dedup.keep_first(none, F.lit(True)).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
