"""Named phrase lists, searched cheaply.

Testing dozens of alternatives at every position of a long text is what scoring spends its time on. Every
list therefore has a screen: a wider pattern for Arrow's linear-time engine, which tests a text in one pass
of some nanoseconds a character. The regular expression that decides only runs on texts (or sentences) that
the screen lets through. Screens never change a result (`tests/test_phrases.py`, `tests/test_screens.py`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import one_of

_OPEN_RUN = re.compile(r"(\(\?:[^()]*\)|[^\\()\s]+)\\S\*(.*)", re.S)
#: Heads whose search may start later than they say: the rest of them is enough.
_SHORTER = {r"(?:sms[ -]?kod|kod)": "kod"}


def linear(alternative: str) -> str:
    """An equal search for `head\\S*rest` that does not try every head of a run of characters.

    If a match starts at some head in a run, one starts at the run's first head. The atomic group settles on that one.
    """
    m = _OPEN_RUN.fullmatch(alternative)
    head = m and _SHORTER.get(m[1], m[1])
    if not m or " " in head:
        return alternative
    greedy = r"\S*+" if m[2].startswith((" ", r"\s")) else r"\S*"
    return rf"(?<!\S)(?>\S*?{head}){greedy}{m[2]}"


#: Equal searches that do not begin a match at every word: only what ends it, and the letters before that, are looked at.
_BY_END = {
    r"\b\w+(?:ib|b) ": r"(?<=\w)b ",
    r"\b[\w-]+\.": r"\w-*+\.",
    r"\b\w{2,}(?:di|": r"(?=[dig])(?<=\w\w)(?:di|",
    r"\b\w{2,}(?:ла|": r"(?=[алиея])(?<=\w\w)(?:ла|",
}


def by_end(alternative: str) -> str:
    for start, other in _BY_END.items():
        if alternative.startswith(start):
            return other + alternative[len(start):]
    return alternative


_RULES = {name for name, *_ in V.RULES}
#: The lists as they are written.
LISTS = {
    **{name: alternatives for name, _, _, alternatives in V.RULES},
    "NEED": V.NEED, "ASK_VERB": V.ASK_VERB, "RISKY_OBJECT": V.RISKY_OBJECT, "MONEY": V.MONEY,
    "SAFE_ACTION": V.SAFE_ACTION, "WARNING": V.WARNING, "TELL_NOT": V.TELL_NOT, "SECRET": V.SECRET,
    "WHO": V.WHO, "PAST": V.PAST, "QUOTE": V.QUOTE,
    "QUOTING_WORD": [rf"\b(?:{V.QUOTING_WORDS})\b"],
}
#: The same searches as they are run.
PHRASES = {name: [(linear if name in _RULES else by_end)(a) for a in alternatives] for name, alternatives in LISTS.items()}

GATES = {
    "secret_code": ["kod", "cvv", "amal qilish", "kartangiz", "karta ", "код", "карты", "code", "otp", "pin", "card "],
    "prize": ["yut", "g'olib", "sovrin", "sovg'a", "bonus", "выигр", "победител", "приз", "won", "winner",
              "claim your", "lottery"],
    "urgency": ["shoshiling", "zudlik", "tezda", "faqat bugun", " ichida", "oxirgi", "kechiktir", "срочно",
                "немедленно", "в течение", "только сегодня", "последний", "urgent", "immediately", "within ",
                "last chance", "act now"],
    "blocked_account": ["karta", "hisob", "shubhali", "карта з", "счёт", "счет", "аккаунт", "подозрительн",
                        "account", "card ", "suspicious"],
    "bank_impersonation": ["xavfsizlik", "markaziy", "служба без", "сотрудник", "центральн", "bank security"],
    "advance_fee": ["oldin", "komissiya", "avval", "yetkazib", "sug'urta", "предоплат", "оплат", "страхов", "pay ",
                    "processing fee", "yig'im", "uchun", " a $", "jo'natma", "posilka", "посылк"],
    "marketplace": ["xavfsiz ", "pulni", "to'lovni", "olx", "dostavka", "безопасн", "получить", "деньги", "receive ",
                    "safe deal"],
    "easy_money": ["kuniga", "oyiga", "passiv", "oson pul", "uyda", "layk", "investitsiya", "kripto", "x2",
                   "ikki barobar", "пассивн", "заработ", "за лайки", "крипт", "инвести", "удво", "earn ",
                   "work from home", "double your", "%", "kafolatlangan", "гарантир", "guaranteed", "invest now"],
    "apk_file": [".apk"],
    "install_app": ["ilova", "dastur", "rasm", "foto ko'r", "установите", "скачайте", "посмотри", "install ",
                    "download "],
    "relative_in_trouble": ["raqam", "bu men", "jon", "muammoga", "hech kimga", "это я", "новый номер", "попал в",
                            "никому не", "it's me", "its me", "my new number", "tell anyone", "telefonim", "телефон",
                            "номера"],
    "threat_payment": ["jarima", "to'lamasangiz", "sud ishi", "hibsga", "musodara", "arest", "muzlatiladi", "штраф",
                       "иначе", "возбуждено", "арест", "pay the fine", "will be", "legal action"],
    "fake_admission": ["kafolatla", "a'zosiman", "гарантирую", "член", "guarantee", "admission"],
    "gov_impersonation": ["soliq", "davlat", "kompensatsiya", "subsidiya", "jarima", "налогов", "компенсаци", "штраф",
                          "tax refund", "government"],
    "NEED": ["pul ", "pulga", "kerak", "деньги", "нужн", "need "],
    "RISKY_OBJECT": ["kod", "sms", "parol", "pin", "cvv", "karta", "pul", "to'lov", "so'm", "mln", "ming", "dollar",
                     "$", "usdt", "ssilka", "link", "havola", "sayt", ".apk", "fayl", "ilova", "ma'lumot", "dannil",
                     "http", ".uz", ".com", ".top", ".xyz", ".online", ".site", ".ru", ".net", ".org", "код", "смс",
                     "пароль", "карт", "деньг", "рубл", "сум", "ссылк", "сайт", "файл", "приложени", "данны", "code",
                     "otp", "password", "card", "money", "payment", "file", "app", "details"],
    "SAFE_ACTION": ["xabar", "murojaat", "qo'ng'iroq", "blok", "o'chir", "tekshir", "позвоните", "обратитесь",
                    "сообщите", "call ", "report "],
    "WARNING": ["mang", "maslik", "masin", "hech qachon", "maydi", "maymiz", "bo'ling", "firibgar", "aldamchi", "desa",
                "deyi", "degan", "deb ", "не ", "осторожно", "мошенни", "это ", "never", "not ", "don't", "beware",
                "scam", "fraud", "trap"],
    "TELL_NOT": ["aytma", "не ", "tell"],
    "WHO": ["menga", "mendan", "meni", "bizga", "bizni", "guruh", "kimdir", "kecha", "vchera", "bugun ertalab",
            "o'tgan hafta", "onam", "otam", "dadam", "buvim", "bobom", "opam", "akam", "ukam", "singlim", "jiyanim",
            "do'stim", "dugonam", "qo'shnim", "hamkasbim", "kollegam", "tanishim", "o'rtog'im", "мне", "меня", "нам",
            "вчера", "мам", "папе", "бабушк", "дедушк", "коллег", "подруг", "друг", "сосед", "сестр", "брат"],
    "QUOTE": ["rostmi", "haqiq", "firibgarlikmi", "aldovmi", "to'g'rimi", "shunday xabar", "xabar keldi",
              "shu tashlandi", "kimdir biladimi", "ladimi", "aymi", "ayinmi", "это правда", "это развод", "is this ",
              "i got this"],
    "QUOTING_WORD": ["desa", "deyi", "degan", "deb", "dedi", "deyd", "deya"],
}


def core(stem: str) -> str:
    """The longest part of a stem without spaces.

    Blanking quoted speech and leaving out advice put spaces into a text, so a stem with a space may come about that
    way; a part without spaces that is found afterwards was there before.
    """
    return max(stem.split(), key=len)


#: Lists looked for in texts that lost something (quoted speech, advice), so that only cores can be told beforehand.
_MASKED = {"NEED", "RISKY_OBJECT", "SAFE_ACTION", "WHO", "QUOTING_WORD"}


def _wider(alternative: str) -> str:
    """A pattern without conditions on its surroundings that matches wherever the alternative does in a normalised text."""
    plain = re.sub(r"\(\?<?!(?:[^()]*)\)", "", alternative.replace(r"\b", ""))
    for java, wide in ((r"[\w-]", "[^ ]"), (r"\w", "[^ ]"), (r"\S", "[^ ]"), (r"\s", " "), (r"\d", r"\p{Nd}")):
        plain = plain.replace(java, wide)
    return plain


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def same_everywhere(alternative: str) -> bool:
    """Does the alternative mean the same to both engines, so that what the screen finds needs no second look?"""
    return not re.search(r"\\[bwd]|\(\?<?[!=]", alternative)


def screen_pattern(name: str) -> str:
    if name in _MASKED:
        return "|".join(dict.fromkeys(_literal(core(s)) for s in GATES[name]))
    return _widened(LISTS[name])


def _widened(alternatives: Iterable[str]) -> str:
    return "|".join(f"(?:{_wider(a)})" for a in alternatives)


def sure_pattern(name: str) -> str:
    return _widened(a for a in LISTS[name] if same_everywhere(a))


def unsure_pattern(name: str) -> str:
    return _widened(a for a in LISTS[name] if not same_everywhere(a))


def screens(texts: Column, patterns: list[str]) -> Column:
    """For each of an array's texts a number: bit i is set where the i-th pattern occurs. Nothing is found in a null.

    Texts are normalised. An empty pattern occurs nowhere.
    """

    def masks(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten()
        bits = pa.array([0], pa.int32()).take(pa.nulls(len(flat), pa.int32()).fill_null(0))
        for i, pattern in enumerate(patterns):
            if not pattern:
                continue
            hit = pc.match_substring_regex(flat, pattern).fill_null(False)
            bits = pc.bit_wise_or(bits, pc.shift_left(hit.cast(pa.int32()), pa.scalar(i, pa.int32())))
        # A slice's offsets need not begin at 0, a null array has no length: counted anew.
        sizes = pc.list_value_length(arrays).fill_null(0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
        return pa.ListArray.from_arrays(offsets, bits)

    return F.arrow_udf(masks, "array<int>")(texts)


def bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def found(text: Column, name: str, unsure: bool = False) -> Column:
    """Does the (normalised) text contain one of the phrases, or of those that a screen is not sure of?"""
    return text.rlike(one_of(a for a, plain in zip(PHRASES[name], LISTS[name], strict=True) if not unsure or not same_everywhere(plain)))


def found_in_either(norm: Column, latin: Column, name: str, unsure: bool = False) -> Column:
    """Does one of the two spellings contain one of the phrases?"""
    return found(norm, name, unsure) | ((latin != norm) & found(latin, name, unsure))


def without(text: Column, name: str) -> Column:
    """The text with every phrase replaced by a space."""
    return F.regexp_replace(text, one_of(PHRASES[name]), " ")
