"""Packing, main text, mixing, chat formatting, components and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import frame, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wardlight.llm import chat, html_content, mixing, near_texts, tier_packing, token_packing
from wardlight.llm.components import connected, forest
from wardlight.llm.tokens import WordTokenizer

ROWS = odd_texts()
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain_tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_word_tokenizer_equals_the_tokenizer(plain_tokenizer):
    rng = random.Random(2)
    texts = ["", "  ", "<|endoftext|> a<|startoftext|>b", "don't'S ǅ İstanbul! ΣΑΣ. ß́ é x\x1cq z", "ﬁ x² ½ Ⅳ aͅb", "日本語 text，ok", "A" * 3000]
    texts += ["".join(rng.choice("aB é!'śİΣ <|>9²\n\x1ć,.") for _ in range(60)) for _ in range(300)]
    ids, counts = WordTokenizer(PATH).encode([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids, text
        at += n


def check_pieces(rows, ids, longest=4096):
    """Every id in exactly one piece; sequences without gaps, in windows of the tiers; few padding tokens."""
    sequences, covered = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append(r)
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    want = Counter((i, k) for i, one in ids for k in range(len(one)))
    assert covered == want
    known = {(i, len(one)): one for i, one in ids if i is not None}
    for r in rows:
        if r.doc_id is not None:
            piece = np.array(known[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    padding = 0
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *[r.length for r in held]]).tolist()[:-1]
        filled, window = sum(r.length for r in held), held[0].window
        assert filled <= window <= longest and window in tier_packing.TIERS
        padding += window - filled
    return padding


def test_tier_packing(spark, plain_tokenizer):
    rows = tier_packing.pack_documents(frame(spark, ROWS), PATH, 2).collect()
    ids = [(i, ids_of(plain_tokenizer, t, 2)) for i, t, _ in ROWS]
    padding = check_pieces(rows, ids)
    assert padding <= 3 * 512 + sum(len(x) for _, x in ids) / 64
    steps = defaultdict(int)
    for s, w in {(r.step_group, (r.sequence_id, r.window)) for r in rows}:
        steps[s] += w[1]
    assert tier_packing.pack_documents(frame(spark, ROWS).limit(0), PATH, 2).count() == 0


@given(st.lists(st.integers(1, 9000), max_size=120))
@settings(max_examples=120, deadline=None)
def test_pack_holds_every_token_once(sizes):
    packed = tier_packing.pack(sizes)
    cover = Counter()
    for window, held in packed:
        assert sum(n for _, _, n in held) <= window
        for doc, start, n in held:
            cover[doc] += n
            assert n > 0 and 0 <= start and start + n <= sizes[doc]
    assert cover == Counter(dict(enumerate(sizes)))
    pieces = sorted((doc, start, n) for _, held in packed for doc, start, n in held)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
    windows = [w for w, _ in packed]
    loads = Counter()
    for w, s in zip(windows, tier_packing.step_groups(windows, 4096), strict=True):
        loads[s] += w
    assert not loads or max(loads.values()) - min(loads.values()) <= 4096 or len(loads) == 1


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=150, deadline=None)
def test_best_fit_equals_a_plain_search(sizes):
    got = token_packing.best_fit(np.array(sizes, np.int64), 64)
    rooms, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        rooms.append(room - sizes[i])
        want[i] = room
    loads = Counter()
    for i, b in enumerate(got.tolist()):
        loads[b] += sizes[i]
    assert sorted(64 - x for x in loads.values()) == sorted(rooms)


def test_token_matrix_round_trip(spark, plain_tokenizer):
    rows = token_packing.pack_matrix(frame(spark, ROWS), PATH, 49407, length=256).collect()
    parts = defaultdict(Counter)
    for r in rows:
        row = token_packing.matrix_of([r.ids])[0]
        assert len(row) == 256 and r.segment_ends[-1] == r.n_tokens <= 256 and r.position_resets == [0, *r.segment_ends[:-1]]
        assert set(row[r.n_tokens :].tolist()) <= {49407}
        for i, s, a, b, n in zip(r.doc_ids, r.starts, r.position_resets, r.segment_ends, r.doc_tokens, strict=True):
            parts[i][s, n, tuple(row[a:b].tolist())] += 1
    want = defaultdict(Counter)
    for i, t, _ in ROWS:
        ids = ids_of(plain_tokenizer, t, 49407)
        for s in range(0, len(ids), 256):
            want[i][s, len(ids), tuple(ids[s : s + 256])] += 1
    assert parts == want
    assert token_packing.pack_matrix(frame(spark, ROWS).limit(0), PATH, 2).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header>Site name</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really, we do.</div><!-- <p>hidden</p> --><script>var t="</p><p>no</p>";</script>
<article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> text.<p>Second &lt;paragraph&gt;, a bit longer; it has marks.<br>
<ul><li>one item, <a href=x>linked</a></li><li>two</li></ul><form><input name=q><button>Send</button></form>
<aside>Related</aside><div class="ad">Buy now, buy, buy.</div><p>Last&nbsp;one.</p>
<section id="comments"><p>A reader, who says a lot of things, here, and there.</p></section></article>
<div id="sidebar">More</div><footer>&copy; us, forever.</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\nFirst paragraph, with bold text.\nSecond <paragraph>, a bit longer; it has marks.\none item, linked\ntwo\nLast one."
    assert html_content.main_text(PAGE) == want
    plain = "<div id=menu><a href=1>A</a></div><div><p>Some text, long enough. It goes on.</p><p>And more, of it.</p></div>"
    assert html_content.main_text(plain) == "Some text, long enough. It goes on.\nAnd more, of it."
    assert html_content.main_text("<article><p>cut off &am") == "cut off &am" and html_content.main_text("a < b <p") == "a < b"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", "<nav>menu</nav>", "x"), (4, "u", "<nav>menu</nav>", "x"),
            (5, "u", "<div>" * 20_000 + "deep", "x"), (6, "u", "<p>" + "word " * 100_000, "x"), (7, "u", "<a \"" * 20_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.url, r.text) for r in html_content.extract_main_text(df).collect() if r.page_id not in (5, 6, 7))
    assert got == Counter([(1, "u", want), (2, None, ""), (None, "u", ""), (4, "u", ""), (4, "u", "")])
    assert html_content.extract_main_text(df.limit(0)).count() == 0


def test_no_part_of_the_main_text_is_lost():
    told = ["Some text, long enough to count. It goes on, and on, with marks. " * 6 + f"Part {i}." for i in range(12)]
    long = "".join(f"<p>{t}</p>" for t in told)
    menu, end = "<div id=menu><a href=/>Home</a></div>", "<footer>Us</footer>"
    short = "A short one, of a few words. It ends here, soon, with marks."
    pages = [(f"{menu}<div class=page><h1>The title</h1><p>A lead, of one line.</p><div class=text>{long}</div></div>{end}",
              ["The title", "A lead, of one line.", *told]),
             (f"{menu}<div class=text>{long}</div><div class=end><p>{short * 3}</p></div>{end}", [*told, short * 3]),
             (f"{menu}<div><article>{long}</article><article><h2>Second</h2><p>{short}</p></article></div>{end}", [*told, "Second", short])]
    for page, want in pages:
        assert html_content.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)


STORY = [f"Paragraph {i} of the story, which is long enough to count. It goes on, with marks, and says a thing or two." for i in range(5)]
STORY_HTML = "".join(f"<p>{p}</p>" for p in STORY)


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar"><article>{STORY_HTML}</article></div>', f'<div class="app header-fixed"><main>{STORY_HTML}</main></div>',
    f'<article class="post share-enabled">{STORY_HTML}</article>', f'<form id="all"><div class="sidebar"><div>{STORY_HTML}</div></div></form>',
    f'<div class="comments-off"><article>{STORY_HTML}<div class="zz9"><a href="/x">Buy this now!</a></div></article></div>',
    f'<article>{STORY_HTML}<section class="comments"><p>A reader, who says things, at length. {STORY[0]}</p></section></article>'])
def test_names_are_evidence_only(page):
    assert html_content.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>Us</footer></body>") == "\n".join(STORY)


def test_listed_words_inside_an_article():
    parts = f'<article>{STORY_HTML}<blockquote class="reply">Quoted, said and done.</blockquote><section id="tracking-results"><p>Results, in short.</p></section></article>'
    more = f'{STORY_HTML}<div class="search-help"><p>{STORY[0]}</p></div>'
    assert html_content.main_text(parts).split("\n") == [*STORY, "Quoted, said and done.", "Results, in short."]
    assert html_content.main_text(f"<article>{more}</article>").split("\n") == [*STORY, STORY[0]]
    two = f"<body><article class=related-x>{STORY_HTML}</article><aside>No</aside><article>{STORY_HTML}</article></body>"
    assert html_content.main_text(two).split("\n") == STORY * 2


def test_path_scores_equal_a_plain_reading():
    page = f"<body><div><h1>Title</h1>{STORY_HTML}<ul><li>one, <a href=1>two</a></li><li>three.</li></ul><p>End.</p></div><div><a href=2>x</a></div></body>"
    live = [x for x in html_content.text_nodes(page)[0] if x[2].strip()]
    paths = [x[0].block.path for x in live]
    chars = [0 if e.link else len(t) for e, _, t in live]
    marks = [0 if e.link else sum(c in ".,;:!?" for c in t) for e, _, t in live]
    mean = lambda values: [np.mean([v for v, q in zip(values, paths, strict=True) if q == p]) for p in paths]

    def smooth(values):
        weight = [[np.exp(-(i - j) ** 2 / 2) * (abs(i - j) < 3) for j in range(len(values))] for i in range(len(values))]
        return np.array([np.dot(w, values) / np.sum(w) for w in weight])

    fused = smooth(mean(chars)) * (smooth(mean(marks)) + 0.1)
    got, threshold = html_content.path_scores(live)
    for p in set(paths):
        assert got[p] == pytest.approx(np.mean([f for f, q in zip(fused, paths, strict=True) if q == p]))
    assert threshold == pytest.approx(min(fused.std(), max(got.values()) / 2))


@pytest.mark.parametrize("page,text", [("<div>word " * 60_000, "word"), ("<table><tr><td><p>" + "<span>x</b></i>" * 60_000, "x"), ("<p><table><tr><td>" * 20_000 + "deep", "deep")])
def test_badly_nested_pages_take_time_in_proportion(page, text):
    import time

    start = time.process_time()
    assert text in html_content.main_text(page)
    assert time.process_time() - start < 15


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in turns), "".join(x for _, _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), said, loss)
    return out


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "[NEXT]", "<\\/s>", "<\\\\s>[\\INST]", "", None, "\\", "<", "[", "plain é 😀", "<s>[INST]user[/INST]x</s>", "$1 \\n"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "[/INST]"]), "".join(rng.choice(odd) or "" for _ in range(3)) if t % 5 else None)
            for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (None, 0, "user", "a"), (None, None, "assistant", "b"), (99, 1, "assistant", "long " * 20_000), (99, 2, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                                               chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: (len(r.turns), "".join(f"{t.role}\n{t.text}\n" for t in r.turns), r.loss) for r in out.collect()}
    assert got == plain_chat(rows)
    merged = chat.format_conversations(spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string"))
    assert merged.first().formatted == "<s>[INST]user[/INST]a[NEXT]b</s><s>[INST]assistant[/INST]c</s>"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_roots(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4300)]
    want = plain_roots(pairs)
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want
    u, v = forest(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == want
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def labelled(spark, n=360):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("abcdefgh") * rng.randint(2, 4) + str(rng.randint(0, 30)) for _ in range(60)]
        kind = rng.choice([0, 0, 0, 1, 2])
        if kind == 2:
            for k in rng.sample(range(60), 4):
                w[k] = rng.choice(["nasty", "horrid", "vile"])
        if kind == 1:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(kind != 1), int(kind == 2), kind))
    return rows, labels


def test_mixing(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, [*rows, (None, None, None), (5000, "", "s"), rows[0], (5001, "nasty " * 300, "s"), (5002, labelled(spark, 1)[0][0][1] + " " + "aa1 bb2 " * 30_000, "s")])
    known = spark.createDataFrame([(i, q, t) for i, q, t, _ in labels[:240]] + [(None, 1, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, known).collect()
    kinds = {i: k for i, _, _, k in labels}
    held = [r for r in out if r.doc_id in kinds and r.doc_id >= 240]
    right = sum(max(range(3), key=lambda k: r[mixing.DOMAINS[k]]) == kinds[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    assert all(abs(sum(r[d] for d in mixing.DOMAINS) - 1) < 1e-9 and r.rate >= 0 for r in out)
    good = sum(r.n_tokens * r.good for r in out)
    shares = [sum(r.n_tokens * r.rate * r[d] for r in out) / good for d in mixing.DOMAINS]
    want = [mixing.WEIGHTS[d] / mixing.WEIGHTS["good"] for d in mixing.DOMAINS]
    assert all(abs(a - b) < 0.05 for a, b in zip(shares, want, strict=True)), (shares, want)
    assert all(r.copies == 1 for r in out if r.doc_id in kinds and kinds[r.doc_id] == 0 and r.good > 0.95)
    mixed = mixing.mixed_documents(docs, known)
    assert mixed.columns == docs.columns
    drawn = Counter(r.doc_id for r in mixed.collect())
    assert drawn == +Counter({i: sum(r.copies for r in out if r.doc_id == i) for i in {r.doc_id for r in out}})
    for bare in (known.limit(0), known):
        assert mixing.mix(docs.limit(0), bare).count() == 0
    assert {round(r.good, 6) for r in mixing.mix(docs, known.limit(0)).collect()} == {0.333333}


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4] * 3, 300)
    n = rng.integers(1, 400, 300)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(n, p, strict=True)], "n_tokens long, good double, poor double, toxic double")
    residuals = mixing.fit_rates(df)
    rate = mixing.descend(p, residuals)[0]
    share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    a = n[:, None] * p / n.sum()
    target = share / share[0] * a.sum(0)[0]
    slope = p @ (rate @ a - target) + mixing.NEARNESS * (rate - 1)   # per document; zero, or upward where the rate is zero
    assert np.all(np.abs(slope[rate > 0]) < 1e-3) and np.all(slope[rate == 0] > -1e-3)


def test_rates_are_the_best_to_the_tolerance(spark):
    rng = np.random.default_rng(5)
    for softness in (0.02, 0.4, 3.0):
        p = rng.dirichlet([softness] * 3, 400)
        n = rng.integers(1, 4000, 400)
        df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(n, p, strict=True)], "n_tokens long, good double, poor double, toxic double")
        rate = mixing.descend(p, mixing.fit_rates(df))[0]
        share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
        a = n[:, None] * p / n.sum()
        slope = p @ (rate @ a - share / share[0] * a.sum(0)[0]) + mixing.NEARNESS * (rate - 1)
        assert np.all(np.abs(slope[rate > 0]) < 2e-3 * mixing.NEARNESS) and np.all(slope[rate == 0] > -2e-3 * mixing.NEARNESS)


def test_a_long_toxic_text_does_not_hide_the_target(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, [*rows, (5001, "nasty " * 30_000, "s")])
    out = mixing.mix(docs, spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int")).collect()
    good = sum(r.n_tokens * r.good for r in out)
    for d in mixing.DOMAINS:
        want = mixing.WEIGHTS[d] / mixing.WEIGHTS["good"] * good
        assert abs(sum(r.n_tokens * r.rate * r[d] for r in out) / want - 1) < 0.03, d


def test_copies_have_the_target_totals(spark):
    rows, labels = labelled(spark, 4000)
    docs = frame(spark, rows, clash=False)
    out = mixing.mix(docs, spark.createDataFrame([x[:3] for x in labels[:1000]], "doc_id long, quality int, toxic int")).collect()
    good = sum(r.n_tokens * r.good for r in out)
    for d in mixing.DOMAINS:
        want = mixing.WEIGHTS[d] / mixing.WEIGHTS["good"] * good
        assert abs(sum(r.n_tokens * r.rate * r[d] for r in out) / want - 1) < 0.02, d
        assert abs(sum(r.n_tokens * r.copies * r[d] for r in out) / want - 1) < 0.1, d
    kinds = {i: k for i, _, _, k in labels}
    assert sum(r.copies for r in out if kinds[r.doc_id] == 2) > 0
    assert all(r.copies == 1 for r in out if kinds[r.doc_id] == 0 and r.good > 0.95)


def plain_groups(texts):
    """For each text the number of its group: similarity of five-word shingles of 0.8 or more, by comparing all pairs."""
    from test_new_operators import shingle_set

    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("dense", [256, 3])
def test_near_copies_are_found(spark, monkeypatch, dense):
    """At least nine of ten near copies go, and nothing else does."""
    monkeypatch.setattr(near_texts, "DENSE", dense)
    rng = random.Random(11)
    rows = [*ROWS]
    for base in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for copy in range(rng.randint(1, 4)):
            now = list(text)
            for _ in range(rng.randint(0, len(text) // 50)):
                now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
            rows.append((10_000 + 10 * base + copy, " ".join(now), "s"))
    label = plain_groups([t for _, t, _ in rows])
    kept = Counter((r.doc_id, r.text) for r in near_texts.keep_one(frame(spark, rows)).collect())
    groups = defaultdict(list)
    for (i, t, _), c in zip(rows, label, strict=True):
        groups[c].append((i, t))
    gone = Counter((i, t) for i, t, _ in rows)
    gone.subtract(kept)
    assert min(gone.values()) >= 0
    wanted = sum(len(g) - 1 for g in groups.values())
    assert 0.9 * wanted <= sum(gone.values()) <= wanted and wanted > 40
    for g in groups.values():
        assert any(kept[x] for x in g)
    assert near_texts.keep_one(frame(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    rows, labels = labelled(spark, 200)
    odd = [(i if i is None else i + 10_000, t, h) for i, t, h in ROWS]
    docs = frame(spark, [*rows, *odd], clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    from test_text_operators import plain_exact, plain_lines, plain_quality
    import re

    held, now = docs, [*rows, *odd]
    for name, stage in corpus_pipeline.STAGES[:3]:
        held = stage(spark, held, str(tmp_path)).persist()
        assert held.columns == docs.columns
        if name == "quality_rules":
            frequent, kept = plain_lines(now), []
            for (i, t, h), v in zip(now, plain_quality(now), strict=True):
                if v[7]:
                    kept.append((i, "\n".join(x for x in t.split("\n") if (h or "", re.sub("[0-9]+", "0", " ".join(x.split(" ")).lower())) not in frequent), h))
            now = kept
        elif name == "exact_dedup":
            winners, seen, kept = {(k[0], k[4]) for k in plain_exact(now) if k[3]}, set(), []
            for r in now:
                digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r[1] or "").encode()).hexdigest()
                if (r[0], digest) in winners and digest not in seen:
                    seen.add(digest)
                    kept.append(r)
            now = kept
        else:
            label = plain_groups([t for _, t, _ in now])
            now = [min((r for r, d in zip(now, label, strict=True) if d == c), key=lambda r: (r[0] is None, r[0] or 0)) for c in set(label)]
        assert sorted(Counter((r.doc_id, r.text) for r in held.collect()).items(), key=repr) == sorted(Counter((i, t) for i, t, _ in now).items(), key=repr)
    mixed = corpus_pipeline.mix_domains(spark, held, str(tmp_path)).persist()
    good = {i for i, _, _, k in labels if k == 0}
    left = Counter(r.doc_id for r in mixed.collect())
    before = {r.doc_id for r in held.collect()}
    assert mixed.columns == docs.columns and all(left[i] >= 1 for i in good & before)
    toxic = {i for i, _, _, k in labels if k == 2} & before
    assert sum(left[i] for i in toxic) < 0.5 * len(toxic)
    last = corpus_pipeline.pack_tiers(spark, mixed, str(tmp_path))
    assert Counter(r.doc_id for r in last.filter("start = 0").collect()) == left
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0").count() == sum(left.values())
