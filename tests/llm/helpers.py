"""Documents with every odd case, and plain readings of the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import Row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["row", "key", "fp", "digest", "n_words", "kept", "shard", "host", "label", "node", "root", "copies", "rate", "hash", "_1"]


def words(text):
    return WORD.findall(text or "")


def odd_texts(seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): copies, near copies, shared passages and lines, nulls, empty, junk, one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    menu = [f"{c}{c}a {c}{c}b {c}{c}c" for c in "bcdfghijklmnopqrstuv"]
    base, passage, line = prose(120), prose(45), "Common line, number 12."
    rows = [(i, prose(rng.randint(3, 150)), f"s{i % 2}") for i in range(30)]
    rows += [(40 + i, base.replace(" ", "  ", i), "s0") for i in range(5)]                    # equal without white space
    rows += [(60 + i, base.replace(base.split()[50 + i], f"new{i}", 1), "s1") for i in range(4)]
    rows += [(80 + i, f"{prose(30)} {passage} {prose(30)}", "s0") for i in range(6)]          # a shared passage
    rows += [(100 + i, f"{line}\n{prose(70)}\n{line}", "s0") for i in range(14)]               # a frequent line
    rows += [(120 + i, "\n".join([line, *menu]), "s0") for i in range(13)]
    rows += [(130 + i, "\n".join([line, *menu, f"end {i} " + prose(3)]), "s0") for i in range(13)]
    rows += [(150, None, None), (151, "", "s0"), (152, " \t\n ", "s1"), (153, "one", None), (154, "same " * 300, "s0"), (None, prose(60), "s0"),
             (None, None, None), (155, prose(20_000), "s1"), (156, "x" * 50_000, "s0"), (157, prose(19), "s0"), (158, prose(20), "s0"),
             (159, "a b   c\x1cd ÀÉ ǅ İ " + prose(60), "s1")]
    rows += [rows[7], rows[40], (None, None, None)]                                          # repeated rows
    return rows


def frame(spark, rows, clash: bool = True):
    extra = {c: None for c in CLASH} if clash else {}
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    data = [(i, t, "en", s, len(t or "")) + ("z",) * len(extra) for i, t, s in rows]
    return spark.createDataFrame(data, schema).repartition(3)


def collect(df) -> list[Row]:
    return df.collect()


def key(row, *names):
    return tuple(row[n] for n in names)
