"""Host names: parsing, registrable domains, official sites and brand look-alikes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import bind

_OFFICIAL = sorted({d for ds in V.OFFICIAL_DOMAINS.values() for d in ds} | set(V.TRUSTED_DOMAINS))
_IPV4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = (
    rf"^(?:{_IPV4}\.){{3}}{_IPV4}$"
    r"|^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
    rf"|^(?=[^:]*(?::[^:]+)*::?)(?!.*::.*::)(?!(?:[^:]*:){{9}})(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}})*)?::"
    rf"(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}})*)?(?::?(?:{_IPV4}\.){{3}}{_IPV4})?$"
)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dots; '' when there is none.

    `parse_url` is not usable here: it gives NULL for hosts with non-ASCII letters, which is what
    look-alike hosts are made of.
    """
    rest = F.regexp_replace(url, "^(?i)https?://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.when(
        place.contains("[") | place.contains("]"), F.regexp_extract(place, r"\[([^\]]*)\]", 1)
    ).otherwise(F.substring_index(place, ":", 1))
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def is_ip(host: Column) -> Column:
    # no address literal is longer; longer hosts never reach the pattern, whose groups repeat per colon
    return (F.length(host) <= 47) & F.regexp_replace(host, r"^\[|\]$", "").rlike(_IP)


def _domain(host: Column, second_level: list[str]) -> Column:
    last_two = F.substring_index(host, ".", -2)
    three = (dots(host) >= 2) & F.substring_index(last_two, ".", 1).isin(second_level)
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(last_two)


def dots(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))


def registered_domain(host: Column) -> Column:
    """Rough registrable domain: two labels, three under co/com/gov/org/net/edu."""
    return _domain(host, V.SECOND_LEVEL_LABELS)


def lookup_domain(host: Column) -> Column:
    """The domain asked about at registries: a wider second-level list, no www."""
    return _domain(without_www(F.trim(F.lower(host), F.lit("."))), V.LOOKUP_SECOND_LEVEL_LABELS)


def public_url(url: Column) -> Column:
    """Scheme, host and path only: queries and fragments can carry personal tokens."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    bare = F.regexp_replace(full, "[?#].*$", "")
    scheme = F.lower(F.substring_index(bare, "://", 1))
    rest = F.regexp_extract(bare, r"^.*?://(.*)$", 1)
    with_path = F.when(rest.contains("/"), rest).otherwise(F.concat(rest, F.lit("/")))
    return F.concat(scheme, F.lit("://"), with_path)


def top_level(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def is_official(host: Column) -> Column:
    """The host or a parent domain is on the official or trusted list, or under the government suffix."""
    listed = F.lit(False)
    for labels in sorted({d.count(".") + 1 for d in _OFFICIAL}):
        listed = listed | F.substring_index(host, ".", -labels).isin(
            [d for d in _OFFICIAL if d.count(".") + 1 == labels])
    return listed | (F.substring_index(host, ".", -2) == V.TRUSTED_PARENT)


def is_shortener(host: Column) -> Column:
    return host.isin(V.SHORTENERS)


def is_brand_abroad(host: Column) -> Column:
    """An international brand's own site in another country, or one of its service domains."""
    domain = registered_domain(host)
    return domain.isin(V.BRAND_SERVICE_DOMAINS) | (
        F.substring_index(domain, ".", 1).isin(V.INTERNATIONAL_BRANDS) & ~top_level(domain).isin(V.SUSPICIOUS_TLDS)
    )


def never_listed(host: Column) -> Column:
    return is_official(host) | is_shortener(host) | is_brand_abroad(host)


def host_words(host: Column) -> Column:
    """Words a reader sees: hyphen parts of every label, and neighbouring parts joined."""
    folded = F.replace(F.translate(host, "".join(V.HOMOGLYPHS), "".join(V.HOMOGLYPHS.values())), F.lit("rn"), F.lit("m"))

    def of_label(label: Column) -> Column:
        parts = F.filter(F.split(label, "-"), lambda p: p != "")
        pairs = lambda ps: F.concat(ps, F.filter(
            F.transform(ps, lambda p, i: F.concat(p, F.get(ps, i + 1))), lambda p: p.isNotNull()))
        return bind(parts, pairs)

    return F.flatten(F.transform(F.split(folded, r"\."), of_label))


def _imitates(words: Column, joined: Column, brand: str) -> Column:
    """A word is the brand, a one-letter slip of it, or the brand with bait words glued on."""
    bait = "(?:" + "|".join(V.BAIT_AFFIXES) + "){0," + str(V.MAX_BAIT_PER_SIDE) + "}"
    glued = joined.contains(brand) & joined.rlike(f" {bait}{brand}{bait} ")
    if len(brand) < 5:
        return glued
    near = F.exists(words, lambda w: F.length(w).between(len(brand) - 1, len(brand) + 1)
                    & (F.levenshtein(w, F.lit(brand), 1) == 1))
    return glued | near


def imitated_brand(host: Column) -> Column:
    """The first brand (in list order) the host imitates, NULL if none."""

    def first_match(words: Column) -> Column:
        def pick(joined: Column) -> Column:
            found = F.lit(None).cast("string")
            for brand in reversed(list(V.OFFICIAL_DOMAINS)):
                found = F.when(_imitates(words, joined, brand), brand).otherwise(found)
            return found
        return bind(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), pick)

    return F.when(~is_brand_abroad(host), bind(host_words(host), first_match))
