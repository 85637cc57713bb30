"""Text normalisation, transliteration, masking, fingerprints and language guesses."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import ANY_SPACE, SPACE, count_matches, quick_class

_CYRILLIC = "[\u0400-\u04ff]"   # one range: the cheapest test that covers every letter of the table


# Every run of white space but a single plain space.
_SPACE_RUN = f"{ANY_SPACE}(?:(?<! )|{ANY_SPACE}){ANY_SPACE}*+"


def squeeze(text: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def normalize(text: Column) -> Column:
    """Lower case, one apostrophe, single spaces."""
    return squeeze(F.lower(F.regexp_replace(text, quick_class(V.APOSTROPHES), "'")))


def to_latin(text: Column) -> Column:
    """Uzbek Cyrillic letters to Latin; everything else stays. Rows without Cyrillic skip the work."""
    out = text
    for letter, latin in V.CYRILLIC_TO_LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in V.CYRILLIC_TO_LATIN.items() if len(v) == 1}
    dropped = "".join(k for k, v in V.CYRILLIC_TO_LATIN.items() if not v)
    out = F.translate(out, "".join(single) + dropped, "".join(single.values()))
    return F.when(text.rlike(_CYRILLIC), out).otherwise(text)


def variants(text: Column) -> Column:
    """The normalised text, and its Latin form when that differs."""
    norm = normalize(text)
    return F.array_distinct(F.array(norm, to_latin(norm)))


# The address pattern may only start where a run of address characters starts (or where the previous match
# ended): the same matches as a plain search, in linear time on long runs.
_EMAIL_FAST = r"(?U)(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+\.[\w.]+"


def mask_private(text: Column) -> Column:
    """Cards, then e-mail addresses, then phone numbers; the order matters."""
    out = F.regexp_replace(text, "(?U)" + V.CARD, "<CARD>")
    out = F.regexp_replace(out, _EMAIL_FAST, "<EMAIL>")
    return F.regexp_replace(out, "(?U)" + V.PHONE, "<PHONE>")


def mask_for_dataset(text: Column) -> Column:
    """Also hides account names; links stay because they are evidence, not personal data."""
    return strip(F.regexp_replace(mask_private(text), "(?U)" + V.USERNAME, "<USER>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def content_key(text: Column) -> Column:
    """What is left of a message when script, case, spacing and punctuation are ignored."""
    return F.regexp_replace(to_latin(normalize(text)), r"[^\p{L}\p{N}_<>]", "")


def content_fingerprint(text: Column) -> Column:
    return F.sha2(content_key(text), 256)


def holdout_split(fingerprint: Column) -> Column:
    """'holdout' for a fixed fifth of all fingerprints, else 'train'; the same text always lands together."""
    bucket = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < V.HOLDOUT_PERCENT, "holdout").otherwise("train")


def salted_fingerprint(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 32)


def indicator_fingerprint(kind: Column, value: Column, salt: str) -> Column:
    return salted_fingerprint(F.concat(kind, F.lit(":"), value), salt)


def guess_lang(text: Column) -> Column:
    """uz, ru or en by counting each language's typical letters, short words and endings."""
    points = {
        lang: sum((count_matches(text, "(?iU)" + p) for p in patterns), F.lit(0))
        for lang, patterns in V.LANGUAGE_SIGNS.items()
    }
    cyrillic = count_matches(text, "[а-яА-ЯёЁўқғҳЎҚҒҲ]")
    return (
        F.when(
            cyrillic > F.length(text) * V.CYRILLIC_SHARE,
            F.when(points["ru"] > points["uz_cyr"], "ru").otherwise("uz"),
        )
        .when(points["en"] > points["uz_lat"], "en")
        .otherwise("uz")
    )


def detect_script(text: Column) -> Column:
    low = F.lower(text)
    cyrillic, latin = low.rlike("[а-яёўқғҳ]"), low.rlike("[a-z]")
    return (
        F.when(cyrillic & ~latin, F.when(low.rlike("[ўқғҳ]"), "cyrl").otherwise("ru"))
        .when(cyrillic, "mixed")
        .otherwise("latn")
    )


def mask_preview(value: Column, start: int, end: int = 0) -> Column:
    """First `start` and last `end` characters with *** between; short values stay as they are."""
    tail = F.right(value, F.lit(end)) if end else F.lit("")
    return F.when(F.length(value) <= start + end, value).otherwise(
        F.concat(F.left(value, F.lit(start)), F.lit("***"), tail)
    )


def defang(domain: Column) -> Column:
    return F.replace(domain, F.lit("."), F.lit("[.]"))


def defang_text(text: Column) -> Column:
    """Every dot inside a host name becomes [.], so no notice carries a link one can tap."""
    host = r"(?iU)\b(?:[\w-]+\.){1,126}[a-z]{2,}\b"   # a host name has at most 127 labels
    between = F.split(text, host, -1)
    hosts = F.regexp_extract_all(text, F.lit(host), F.lit(0))
    pieces = F.transform(between, lambda piece, i: F.concat(piece, defang(F.coalesce(F.get(hosts, i), F.lit("")))))
    return F.when(text.rlike(host), F.array_join(pieces, "")).otherwise(text)


def evidence_snippet(sentence: Column, limit: int = V.EVIDENCE_CHARS) -> Column:
    """A masked, squeezed sentence of at most `limit` characters."""
    clean = squeeze(mask_private(sentence))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.rtrim(F.left(clean, F.lit(limit - 1))), F.lit("…"))
    )


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: References that may stand without a semicolon, the longer of two with the same start first.
_LOOSE = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\xa0", "#39;": "'"}
_REPLACED = 0xFFFD


def windows_character(code: int) -> str:
    """What numbers 128 to 159 mean in pages: the characters of the Windows code page, where it has any."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _numbered(name: Column) -> Column:
    """The character of a numeric reference: out of range and surrogates as U+FFFD, numbers that are no characters as nothing."""
    digits = F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    sixteen = name.rlike("^#[xX]")
    read = F.coalesce(F.when(sixteen, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0))
    code = F.when(F.length(digits) > 7, _REPLACED).when((read == 0) | (read > 0x10FFFF) | read.between(0xD800, 0xDFFF), _REPLACED).otherwise(read)
    windows = F.create_map(*[F.lit(x) for c in range(128, 160) for x in (c, windows_character(c))])
    nothing = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
               | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return F.when(code.between(128, 159), F.try_element_at(windows, code.cast("int"))).when(code == 13, "\r").when(nothing, "").otherwise(
        F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _named(name: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    loose = F.regexp_extract(name, "^(?:" + "|".join(_LOOSE) + ")", 0)
    known = F.try_element_at(table, name)
    prefix = F.when(loose != "", F.concat(F.try_element_at(table, loose), F.substr(name, F.length(loose) + 1)))
    return F.coalesce(known, prefix, F.concat(F.lit("&"), name))


def unescape_entities(text: Column) -> Column:
    """Character references, numeric and named, as browsers read them. No reference can make a row fail."""
    between = F.split(text, _REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))

    def decoded(reference: Column) -> Column:
        name = F.substr(reference, F.lit(2))
        common = reduce(lambda c, item: c.when(name == item[0], item[1]), list(_COMMON.items())[1:], F.when(name == "amp;", "&"))
        return common.when(name.startswith("#"), _numbered(name)).otherwise(_named(name))

    pieces = F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.when(F.get(found, i).isNotNull(), decoded(F.get(found, i))), F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def strip_tags(html: Column) -> Column:
    return strip(unescape_entities(F.regexp_replace(html, "<[^>]+>", "")))


def encoder_text(text: Column, chars: int | None = None) -> Column:
    """Input of a sentence encoder: masked and squeezed; only the first `chars` characters where an encoder takes no more."""
    clean = squeeze(mask_private(text))
    return clean if chars is None else F.substring(clean, 1, chars)


def clean_ocr_text(text: Column) -> Column:
    """Rejoin words wrapped at a hyphen; drop lines without at least three word characters."""
    joined = F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1-$2")
    lines = F.transform(F.split(joined, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    return F.array_join(F.filter(lines, lambda line: word_chars(line) >= 3), "\n")


def word_chars(text: Column) -> Column:
    return count_matches(text, r"[\p{L}\p{N}_]")


def has_min_content(text: Column, n: int = V.MIN_CONTENT_CHARS) -> Column:
    return word_chars(text) >= n
