"""What the sender wants: request, warning, report, quote or info, and the sentence that shows it.

Sentences stay an array inside the row, so the same expressions serve batch and streams and no message
is ever shuffled. The text is cut once: a mark (a code point that no text may contain) is set after every
sentence end, quoted speech is blanked around the marks, and both forms are split at them, so raw and
masked sentences always line up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import ANY_SPACE, SPACE, bind, count_matches, one_of
from wardlight.functions.phrases import PHRASES, bit, found, found_in_either, screen_pattern, screens, without
from wardlight.functions.staging import stage, stage_fields
from wardlight.functions.text import evidence_snippet, normalize, squeeze, strip, to_latin

KINDS = ["quote", "request", "warning", "report", "info"]
_MARK = "\ufdd0"
# White space after the end of a sentence, or the ends of lines. Begins with a character, so that others fail at once.
_SENTENCE_END = rf"{ANY_SPACE}(?:(?<=[.!?…]{ANY_SPACE}){ANY_SPACE}*+|(?<=\n)\n*+)"
# Single quotes clash with o' and g', so they only count when a quoting verb follows. Apostrophes inside words are
# set aside first (unless a verb follows at once): what is left needs no nested repetition, which would recurse once
# per apostrophe and overflow the stack on hostile texts.
_ASIDE = "\ufdd1"
_LONE, _OPENING = "\ufdd2\ufdd3\ufdd4", "«“„"
_GAP = r"[\s\x1c-\x1f" + _MARK + "]*+"
_INNER_APOSTROPHE = rf"(?iU)(?<=\w)'(?=\w)(?!(?:{V.SINGLE_QUOTE_VERBS})\b)"
_QUOTED = (
    r"(?iU)\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]"
    r"|(?<!\w)'[^'\n]++'(?=" + _GAP + ",?+" + _GAP + "(?:" + V.SINGLE_QUOTE_VERBS + r")\b)"
)
_QUOTE_MARKS = "[\"«“„']"
_LAST_QUOTING_WORD = rf"(?sU)^.*\b(?:{V.QUOTING_WORDS})\b"


def mark_sentences(text: Column) -> Column:
    reserved = _MARK + _ASIDE + _LONE
    clean = F.when(text.rlike(f"[{reserved}]"), F.translate(text, reserved, " " * len(reserved))).otherwise(text)
    return F.regexp_replace(clean, _SENTENCE_END, "$0" + _MARK)


def _after_last(text: Column, closing: str, hide: Callable[[Column], Column]) -> Column:
    """The text with `hide` applied to what follows the last of the closing marks."""
    tail = F.length(F.substring_index(F.translate(text, closing, closing[0] * len(closing)), closing[0], -1))
    return F.concat(F.left(text, F.length(text) - tail), hide(F.right(text, tail)))


def _hide_lone(text: Column) -> Column:
    """Opening marks that nothing closes are set aside: for each, a search for its end would run to the text's end.

    Those are the marks after the last closing one. A “ may also close a „: in the tail after the last ”, that is the
    first “ after each „.
    """
    lone = dict(zip(_OPENING, _LONE, strict=True))

    def rest(tail: Column) -> Column:
        return F.array_join(F.transform(F.split(tail, "„", -1), lambda piece, i: bind(F.split(piece, "“", -1), lambda p: F.when(
            i == 0, F.array_join(p, lone["“"])).when(F.size(p) < 3, piece).otherwise(
                F.concat(p[0], F.lit("“"), F.array_join(F.slice(p, 2, F.size(p)), lone["“"]))))), "„")

    steps = [("«", "»", lambda t: F.translate(t, "«", lone["«"])), ("“", "”", rest), ("„", "“”", lambda t: F.translate(t, "„", lone["„"]))]

    def step(opening: str, closing: str, hide: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: F.when(t.contains(opening), _after_last(t, closing, hide)).otherwise(t)

    def hidden(t: Column) -> Column:
        return reduce(lambda found, parts: bind(found, step(*parts)), steps, t)

    return bind(text, lambda t: F.when(t.rlike(f"[{_OPENING}]"), hidden(t)).otherwise(t))


def blank_quoted(text: Column) -> Column:
    """Quoted speech becomes spaces of the same length (sentence marks inside it stay)."""
    aside = _hide_lone(F.regexp_replace(text, _INNER_APOSTROPHE, _ASIDE))

    def blanked(t: Column) -> Column:
        between, quoted = F.split(t, _QUOTED, -1), F.regexp_extract_all(t, F.lit(_QUOTED), F.lit(0))
        return bind(quoted, lambda spans: F.array_join(F.transform(between, lambda piece, i: F.concat(
            piece, F.regexp_replace(F.coalesce(F.get(spans, i), F.lit("")), f"[^{_MARK}]", " "))), ""))

    return F.when(text.rlike(_QUOTE_MARKS), F.translate(bind(aside, blanked), _ASIDE + _LONE, "'" + _OPENING)).otherwise(text)


def _pieces(marked: Column) -> Column:
    return F.transform(F.split(marked, _MARK, -1), F.trim)


def sentence_forms(raw: Column, norm: Column, latin: Column, masked: Column, masked_latin: Column) -> Column:
    """array<struct<raw, norm, latin, masked, masked_latin>> of the non-blank sentences; inputs are marked.

    Where all forms are equal, as they mostly are, one is cut.
    """
    names = ["norm", "latin", "masked", "masked_latin"]
    raws = F.split(raw, _MARK, -1)
    zipped = F.arrays_zip(raws.alias("raw"), *[_pieces(form).alias(n) for form, n in zip((norm, latin, masked, masked_latin), names, strict=True)])
    once = F.transform(F.arrays_zip(raws.alias("raw"), _pieces(norm).alias("norm")), lambda s: F.struct(
        s["raw"].alias("raw"), *[s["norm"].alias(n) for n in names]))
    same = (latin == norm) & (masked == norm) & (masked_latin == norm)
    return F.filter(F.when(same, once).otherwise(zipped), lambda s: s["norm"] != "")


# Which phrase lists can occur in a sentence at all; a list that cannot is not looked for.
Possible = Callable[[str], Column]


def always(_: str) -> Column:
    return F.lit(True)


def _asks_one(sentence: Column, context: Column, possible: Possible, around: Possible) -> Column:
    """struct<asks, money> for one spelling: outside quoted speech and safe advice, is something risky asked for?"""

    def after_quotes(cleaned: Column) -> Column:
        quoting = possible("QUOTING_WORD") & found(cleaned, "QUOTING_WORD")
        return F.when(quoting, F.regexp_replace(cleaned, _LAST_QUOTING_WORD, "")).otherwise(cleaned)

    def judged(tail: Column) -> Column:
        need = possible("NEED") & found(tail, "NEED")
        ask = need | (around("RISKY_OBJECT") & found(context, "RISKY_OBJECT") & found(tail, "ASK_VERB"))
        return F.struct(need.alias("need"), ask.alias("asks"))

    def with_money(a: Column) -> Column:
        return F.struct(a["asks"].alias("asks"), (a["asks"] & (a["need"] | found(context, "MONEY"))).alias("money"))

    cleaned = F.when(possible("SAFE_ACTION"), without(sentence, "SAFE_ACTION")).otherwise(sentence)
    return bind(cleaned, lambda c: bind(after_quotes(c), lambda tail: bind(judged(tail), with_money)))


def _no_ask() -> Column:
    return F.struct(F.lit(False).alias("asks"), F.lit(False).alias("money"))


def sentence_asks(norm: Column, latin: Column, before: Column, before_latin: Column,
                  possible: Possible = always, around: Possible = always) -> Column:
    """struct<asks, money>; the object may sit in the previous sentence. The first spelling that asks decides.

    `possible` tells what can occur in the sentence, `around` what can in the two together.
    """
    context = lambda prev, cur: F.trim(F.concat(prev, F.lit(" "), cur))
    first = _asks_one(norm, context(before, norm), possible, around)
    second = F.when(latin != norm, _asks_one(latin, context(before_latin, latin), possible, around))
    asked = bind(first, lambda a: F.when(a["asks"], a).otherwise(F.coalesce(second, _no_ask())))
    return F.when(possible("NEED") | around("RISKY_OBJECT"), asked).otherwise(_no_ask())


def sentence_warns(norm: Column, latin: Column, possible: Possible = always) -> Column:
    return (possible("WARNING") & found_in_either(norm, latin, "WARNING")) | (
        possible("TELL_NOT") & found_in_either(norm, latin, "TELL_NOT") & found_in_either(norm, latin, "SECRET"))


def sentence_reports(norm: Column, latin: Column, possible: Possible = always) -> Column:
    return possible("WHO") & found_in_either(norm, latin, "WHO") & found_in_either(norm, latin, "PAST")


def sentence_quotes(norm: Column, latin: Column, possible: Possible = always) -> Column:
    return possible("QUOTE") & found_in_either(norm, latin, "QUOTE")


_SENTENCE_PHRASES = ["QUOTE", "NEED", "RISKY_OBJECT", "SAFE_ACTION", "QUOTING_WORD", "WARNING", "TELL_NOT", "WHO"]


def _in(mask: Column) -> Possible:
    return lambda name: bit(mask, _SENTENCE_PHRASES.index(name))


def sentence_screens(sentences: Column) -> Column:
    """Which phrase lists may occur in each sentence, in either spelling. What blanking leaves of a sentence has no others."""
    return screens(F.concat(F.transform(sentences, lambda s: s["norm"]),
                            F.transform(sentences, lambda s: F.when(s["latin"] != s["norm"], s["latin"]))), [screen_pattern(n) for n in _SENTENCE_PHRASES])


def judge_sentences(sentences: Column, screened: Column) -> Column:
    """The four judgements of every sentence, with its text."""
    may = lambda i: F.get(screened, i).bitwiseOR(F.get(screened, i + F.size(sentences)))

    def judged(s: Column, i: Column) -> Column:
        before = F.get(sentences, i - 1)
        blank = F.lit("")
        possible = _in(may(i))
        around = lambda name: possible(name) | ((i > 0) & _in(may(i - 1))(name))
        return F.struct(
            s["raw"].alias("raw"),
            sentence_quotes(s["norm"], s["latin"], possible).alias("quote"),
            sentence_asks(s["masked"], s["masked_latin"], F.coalesce(before["masked"], blank),
                          F.coalesce(before["masked_latin"], blank), possible, around).alias("request"),
            sentence_warns(s["norm"], s["latin"], possible).alias("warning"),
            sentence_reports(s["masked"], s["masked_latin"], possible).alias("report"),
        )

    return F.transform(sentences, judged)


def quoted_asks(sentences: Column, screened: Column) -> Column:
    """Does a sentence ask for money, its quoted speech included?"""
    def asks(s: Column, i: Column) -> Column:
        possible = _in(F.get(screened, i).bitwiseOR(F.get(screened, i + F.size(sentences))))
        return sentence_asks(s["norm"], s["latin"], F.lit(""), F.lit(""), possible, possible)["money"]

    return F.exists(F.transform(sentences, asks), lambda money: money)


def past_verbs(norm: Column, latin: Column) -> Column:
    """Past-tense verbs in the unquoted text, in the spelling that shows more of them."""
    pattern = one_of(PHRASES["PAST"])
    return F.greatest(count_matches(norm, pattern),
                      F.when(latin != norm, count_matches(latin, pattern)).otherwise(F.lit(0)))


def decide_intent(judged: Column, narrative_verbs: Column, quoted_money: Column) -> Column:
    """struct<_kind, _evidence, _asks_money>: quote > request > warning > report > info."""
    first = lambda condition: F.get(F.filter(judged, condition), F.lit(0))

    def from_firsts(f: Column) -> Column:
        # Verbs are counted only where nothing that comes first decides.
        story = F.when(narrative_verbs >= V.NARRATIVE_PAST_VERBS, F.coalesce(F.get(judged, F.lit(0))["raw"], F.lit("")))
        unclear = f["quote"].isNull() & f["request"].isNull() & f["warning"].isNull()
        return bind(F.when(unclear, F.coalesce(f["report"], story)), lambda told: decided(f, told))

    def decided(f: Column, told: Column) -> Column:
        kind = (F.when(f["quote"].isNotNull(), "quote").when(f["request"].isNotNull(), "request")
                .when(f["warning"].isNotNull(), "warning").when(told.isNotNull(), "report").otherwise("info"))
        evidence = F.coalesce(f["quote"], f["request"]["raw"], f["warning"], told, F.lit(""))
        money = (F.when(f["quote"].isNotNull(), quoted_money)
                 .when(f["request"].isNotNull(), f["request"]["request"]["money"]).otherwise(False))
        return F.struct(kind.alias("_kind"), evidence_snippet(evidence).alias("_evidence"), money.alias("_asks_money"))

    return bind(F.struct(
        first(lambda s: s["quote"])["raw"].alias("quote"),
        first(lambda s: s["request"]["asks"]).alias("request"),
        first(lambda s: s["warning"])["raw"].alias("warning"),
        first(lambda s: s["report"])["raw"].alias("report"),
    ), from_firsts)


def stage_forms(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the marked forms every later step reads. Each form is its own column, so it is computed once."""
    raw = stage(messages, {"_raw": mark_sentences(F.coalesce(F.col(text), F.lit("")))})
    blank = stage(raw, {"_blank": blank_quoted(F.col("_raw")), "_norm": normalize(F.col("_raw"))})
    same = F.col("_blank") == F.col("_raw")
    masked = stage(blank, {
        "_masked": F.when(same, F.col("_norm")).otherwise(normalize(F.col("_blank"))), "_latin": to_latin(F.col("_norm"))})
    return stage(masked, {"_masked_latin": F.when(same, F.col("_latin")).otherwise(to_latin(F.col("_masked")))})


def unmarked(form: Column) -> Column:
    """The normalised text itself, without sentence marks."""
    return bind(F.replace(form, F.lit(_MARK), F.lit("")), lambda t: F.when(t.contains("  "), squeeze(t)).otherwise(F.trim(t)))


def judge_staged(staged: DataFrame) -> DataFrame:
    """Adds _kind, _evidence, _asks_money. A phrase list is looked for only in sentences where it could match at all."""
    forms = [F.col(c) for c in ("_raw", "_norm", "_latin", "_masked", "_masked_latin")]
    sentences = stage(staged, {"_sentences": sentence_forms(*forms)})
    screened = sentences.withColumn("_screens", sentence_screens(F.col("_sentences")))
    judged = stage(screened, {"_judged": judge_sentences(F.col("_sentences"), F.col("_screens"))})
    verbs = past_verbs(*[F.replace(F.col(c), F.lit(_MARK), F.lit(" ")) for c in ("_masked", "_masked_latin")])
    return stage_fields(judged, decide_intent(F.col("_judged"), verbs, quoted_asks(F.col("_sentences"), F.col("_screens")))).drop("_sentences", "_screens", "_judged")


def intent_struct() -> Column:
    return F.struct(F.col("_kind").alias("kind"), F.col("_evidence").alias("evidence"), F.col("_asks_money").alias("asks_money"))


def detect_intent(messages: DataFrame, text: str = "text", out: str = "intent") -> DataFrame:
    """Adds struct<kind, evidence, asks_money>."""
    return judge_staged(stage_forms(messages, text)).select(*messages.columns, intent_struct().alias(out))


def split_sentences(messages: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row per non-blank sentence: keys, pos, start offset (0-based), sentence."""

    def with_start(pieces: Column) -> Column:
        return F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,sentence:string>>").alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p)).alias("at"),
                F.when(strip(p) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                    acc["at"].alias("start"), F.regexp_replace(p, f"(?U){SPACE}+$", "").alias("sentence")))))
                .alias("out")),
            lambda acc: acc["out"])

    pieces = F.split(mark_sentences(F.col(text)), _MARK, -1)
    return messages.select(*keys, F.posexplode(with_start(pieces)).alias("pos", "s")).select(*keys, "pos", "s.*")
