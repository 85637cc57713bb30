"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import each_batch

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*+)"""
    r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"'()«»“”„-]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noembed noframes".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
                    "small span strike strong sub sup time tt u var wbr").split())
CONTAINERS = frozenset("article main section div td body html".split())
#: Elements and the words of class, id or role that are no part of an article.
OUTSIDE = frozenset("nav header footer aside form button dialog menu head fieldset".split())
OUTSIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr notice "
    "notices alert popup modal overlay dialog nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget "
    "footer header masthead contentinfo comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager toolbar skip copyright tracking").split())
#: Of these words, those that also name parts of articles: running text outweighs them.
WEAK_WORDS = frozenset("alert complementary header login reply replies respond search signup skip toolbar tracking widget".split())
#: Words before a listed one, or after it, by which a name tells the state of an element and not what it is.
STATE_BEFORE = frozenset("has with is no not without hide show js".split())
STATE_AFTER = frozenset(("enabled disabled fixed sticky results open closed free visible hidden active ready on off layout page theme "
                         "style padding margin offset height width size").split())
#: Elements that hold a text of their own whatever they are called.
TEXTS = frozenset("article main html body blockquote q figure figcaption table pre p h1 h2 h3 h4 h5 h6 li dd dt".split())
#: A start tag that ends an open element of these names, up to the nearest of the bounds.
CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
          "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
          "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
          "option": (frozenset(["option"]), frozenset(["select"]))}
_PARAGRAPH = (frozenset(["p"]), frozenset(["td", "th", "table", "button", "object"]))

#: Blocks beside the content root that belong to it.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Steps of the smoothing kernel to either side, in text nodes.
SMOOTH = 2


#: The rules by which a start tag ends an open element, by number.
RULES = [*dict.fromkeys(CLOSES.values()), _PARAGRAPH]
#: Non-link characters, and characters a mark at most, of running text.
RUNNING_CHARS, RUNNING_MARK = 80, 100


def said_words(attributes: str) -> tuple[list[str], frozenset[str]]:
    """(all words of class, id and role; those listed ones that say what the element is)."""
    words, listed = [], set()
    for names in _NAMES.findall(attributes) if "=" in attributes else ():
        for name in names.strip("\"'").split():
            parts = _WORD.findall(_CAMEL.sub(" ", name).lower())
            words += parts
            for i, part in enumerate(parts):
                after = parts[i + 1] if i + 1 < len(parts) else ""
                if part in OUTSIDE_WORDS and after not in STATE_AFTER and not (i and parts[i - 1] in STATE_BEFORE):
                    listed.add(part)
    return words, frozenset(listed)


class Element:
    """An open or closed element. `near` leads, for each rule, to the nearest element that the rule ends or stops at."""

    __slots__ = ("name", "up", "path", "mark", "link", "block", "within", "near", "text", "marks", "links", "holds", "out", "live")

    def __init__(self, name: str, up: Element | None, paths: dict, attributes: str = ""):
        self.name, self.up = name, up
        words, listed = said_words(attributes)
        self.within = name in ("article", "main") or up is not None and up.within
        self.link = name == "a" or up is not None and up.link
        self.path = paths.setdefault((up.path if up else -1, name, *sorted(set(words))), len(paths))
        self.block = self if name not in INLINE or up is None else up.block
        self.near = tuple(self if name in n or name in limits else up.near[i] if up else self for i, (n, limits) in enumerate(RULES))
        self.mark = ""
        if attributes and _HIDDEN.search(attributes) and name not in ("html", "body"):
            self.mark = "hidden"
        elif name in OUTSIDE and not (name == "header" and self.within):
            self.mark = "kind"
        elif listed and name not in TEXTS:
            self.mark = "name" if listed - WEAK_WORDS or not self.within else "weak"
        self.text = self.marks = self.links = self.live = 0
        self.holds = name in ("article", "main")
        self.out = False


def text_nodes(page: str) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """((element, block number, raw text) in page order, all elements in page order). A block ends at tags that are not inline.

    Each tag costs the elements that it closes, and no walk up the open ones.
    """
    paths: dict = {}
    root = here = Element("", None, paths)
    found, elements, block, at, open_ = [], [root], 0, 0, {"": 1}

    def enter(name: str, attributes: str = "") -> Element:
        e = Element(name, here, paths, attributes)
        elements.append(e)
        open_[name] = open_.get(name, 0) + 1
        return e

    def leave(last: Element) -> Element:
        e = here
        while True:
            open_[e.name] -= 1
            if e is last:
                return e.up
            e = e.up

    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            found.append((here, block, page[at:end]))
        if not m:
            return found, elements
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            e = here if open_.get(name) else root
            while e is not root and e.name != name:
                if name in INLINE and e.name not in INLINE:   # an inline end tag does not close blocks
                    e = root
                    break
                e = e.up
            if e is not root:
                here = leave(e)
            continue
        if name == "br":
            found.append((here, block, " "))
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = close.start() if close else len(page)
            if close:
                here = enter(name)
            continue
        if name not in INLINE:
            for rule in {CLOSES.get(name, _PARAGRAPH), _PARAGRAPH}:
                e = here.near[RULES.index(rule)]
                if e.name in rule[0]:
                    here = leave(e)
        if not m[3].endswith("/") or name not in ("path", "g", "use"):
            here = enter(name, m[3])


def mark_outside(nodes: list[tuple[Element, int, str]], elements: list[Element]) -> None:
    """Which elements are no part of an article.

    What an element is called is evidence. It does not count for one that holds an article, or most of the page's text, and a
    word that also names parts of articles does not count for running text with few links.
    """
    for e, _, text in nodes:
        n = len(text) - text.count(" ") - text.count("\n")
        if e.link:
            e.links += n
        else:
            e.text += n
            e.marks += len(_PUNCTUATION.findall(text))
    for e in reversed(elements[1:]):
        e.up.text, e.up.marks, e.up.links, e.up.holds = e.up.text + e.text, e.up.marks + e.marks, e.up.links + e.links, e.up.holds or e.holds
    most = elements[0].text / 2
    for e in elements:
        out = bool(e.mark)
        if e.mark in ("kind", "name", "weak") and (e.holds or e.text > most and e.text >= RUNNING_CHARS and e.name not in ("nav", "footer")):
            out = False
        if e.mark == "weak" and e.text >= RUNNING_CHARS and e.marks * RUNNING_MARK >= e.text and e.links <= e.text / 2:
            out = False
        e.out = out or e.up is not None and e.up.out


def path_scores(live: list[tuple[Element, int, str]]) -> tuple[dict[int, float], float]:
    """(mean fused ratio of each tag path, threshold).

    Per tag path: text length and punctuation per node, links left out. Both ratios, smoothed over neighbouring nodes by a
    Gaussian kernel, are multiplied. The threshold is the standard deviation of the nodes' products, or half the greatest
    mean where that is less.
    """
    sums: dict[int, list[float]] = {}
    for e, _, text in live:
        s = sums.setdefault(e.block.path, [0, 0, 0])
        s[0] += 1
        s[1] += 0 if e.link else len(text)
        s[2] += 0 if e.link else len(_PUNCTUATION.findall(text))
    length, marks = ([sums[e.block.path][k] / sums[e.block.path][0] for e, _, _ in live] for k in (1, 2))
    kernel = [math.exp(-(d * d) / 2) for d in range(-SMOOTH, SMOOTH + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(kernel[d + SMOOTH], values[i + d]) for d in range(-SMOOTH, SMOOTH + 1) if 0 <= i + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [a * (b + 0.1) for a, b in zip(smooth(length), smooth(marks), strict=True)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    by_path: dict[int, list[float]] = {}
    for (e, _, _), f in zip(live, fused, strict=True):
        by_path.setdefault(e.block.path, []).append(f)
    means = {p: sum(v) / len(v) for p, v in by_path.items()}
    return means, min(deviation, max(means.values()) / 2)


def select(nodes: list[tuple[Element, int, str]], elements: list[Element]) -> list[bool]:
    """Which text nodes belong to the main text.

    Paths whose mean fused ratio reaches the threshold are content paths. The content root is the lowest container with all
    their text, or the article or main element around it, or else the highest element around it that adds only headings and
    paragraphs, as a title or lead beside the text. Everything under it belongs to the text but what is marked as no part of
    an article, and blocks of nothing but links on other paths: outside of article elements any, inside those that are a
    division of their own.
    """
    mark_outside(nodes, elements)
    live = [x for x in nodes if not x[0].out and x[2] and not x[2].isspace()]
    if not live:
        return [False] * len(nodes)
    means, threshold = path_scores(live)
    content = {p for p, v in means.items() if v >= threshold}
    worded = {e.block.path for e, _, _ in live if not e.link}
    total = 0
    for e, _, text in live:
        if e.block.path in content:
            e.live += len(text)
            total += len(text)
    for e in reversed(elements[1:]):
        e.up.live += e.live
    root = elements[0]
    for e in elements:   # the last in page order of those with all the content is the lowest
        if e.live == total and (e.name in CONTAINERS or e.up is None):
            root = e
    e = root
    while e:
        if e.name in ("article", "main"):
            root = e
        e = e.up
    article = root.name in ("article", "main")
    if not article:
        root = widened(root, [e for e, _, _ in live])
    inside: dict[Element, bool] = {}
    for e in elements:
        inside[e] = e is root or e.up is not None and inside[e.up]
    said = {block for e, block, text in nodes if not e.link and not text.isspace()}
    spoken = content & worded
    return [inside[e] and not e.out and (block in said or e.block.path in spoken or article and e.block.name not in ("div", "section"))
            for e, block, _ in nodes]


def widened(root: Element, elements: list[Element]) -> Element:
    """The highest element around the root that adds only headings and paragraphs, which are not links."""
    around, e = {root}, root
    while e.up:
        e = e.up
        around.add(e)
    bounds, seen = set(), set()
    for element in elements:
        if element.link or element.block.name not in BESIDE:
            e = element
            while e not in around and e not in seen:
                seen.add(e)
                e = e.up
            if e in around:
                bounds.add(e)
    while root.up and root.up not in bounds:
        root = root.up
    return root


def main_text(page: str) -> str:
    """The selected blocks in page order, white space in a block as one space, one line feed between blocks."""
    nodes, elements = text_nodes(page)
    blocks: dict[int, list[str]] = {}
    for (_, block, text), keep in zip(nodes, select(nodes, elements), strict=True):
        if keep:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page, from its whole html.

    Null or empty html, and pages without an article: empty text. Null page_id and url stay null. Pages that break off
    in a tag or reference are read as far as they go. Repeated rows give repeated rows. An empty table gives no rows.
    Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return each_batch(rows, "page_id long, url string, text string", _extract)
