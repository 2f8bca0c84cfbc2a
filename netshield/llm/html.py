"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of block elements from the root to it. Elements
that hold no text for readers (scripts, styles, controls, hidden parts) go while reading. Others look
like furniture, by element, role, or a class or id token that consists of such words (adverts,
notices, sidebars, comments); they go unless they surround the page: an element that holds most
text, or a main or article element, stays, and where a page's only first-level headings lie in such an
element, those stay. Headers leave their headings.

For every path of the rest, text length and punctuation per block are aggregated; the ratios of the
paths, in page order, are smoothed with their neighbours and fused, and paths at or above ``LEVEL``
standard deviations hold content. Paths that consist of links never do. Content lies in the deepest
element around all blocks of those paths, or the article or main element around it. Its blocks are
kept, so that headings, short paragraphs and lists of links between them stay. Outside of article and
main elements, link blocks below the level go before the first content or heading, and after the last
content unless a heading stands above them. On a page whose only long texts are links, and that marks
no article, there are no lists of links in the result.
"""

from __future__ import annotations

import html as references
import math
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import text_or_empty

#: Standard deviations of the fused ratios that a content path reaches.
LEVEL = 0.6
#: Share of links of a menu.
LINKS = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot select menu article section div".split())
_NEVER = frozenset("head title script style noscript template button select textarea "
                   "iframe object svg canvas audio video map datalist xmp noembed noframes input".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("article main".split())
#: Kinds of elements that look like furniture.
_PLAIN, _BESIDE, _HEADER, _FORM, _COMMENTS = range(5)
_KIND_OF_TAG = {"nav": _BESIDE, "footer": _BESIDE, "aside": _BESIDE, "menu": _BESIDE, "dialog": _BESIDE, "header": _HEADER, "form": _FORM}
_KIND_OF_WORD = {
    **dict.fromkeys(
        "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored promo "
        "promotion promoted sidebar sidebars aside nav navbar navigation topnav sidenav menu menus submenu breadcrumb "
        "breadcrumbs footer topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter "
        "subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
        "pagination pager copyright alert disclaimer skip paywall".split(), _BESIDE),
    **dict.fromkeys("header masthead banner banners".split(), _HEADER),
    **dict.fromkeys("comment comments commentlist reply replies respond responses disqus discussion".split(), _COMMENTS)}
#: Words that don't change what the others of a token say.
_NEUTRAL = frozenset(
    "box wrap wrapper container bar list block inner outer section area slot unit top bottom left right main primary secondary "
    "global site fixed sticky mobile desktop item items row col column group title text body content link links form thread "
    "info law trail posts articles stories button buttons icon icons panel danger warning success dismissible".split())
_ROLES = {**dict.fromkeys("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist note".split(),
                          _BESIDE), "banner": _HEADER, "form": _FORM}
#: How many times the text outside an element around the page fits into it, at least.
_AROUND = 10
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _kind_of_token(token: str) -> int:
    """The kind that a class or id says, if all its words do or are neutral."""
    words = [w.lower() for w in _NAME.findall(token)]
    kinds = [_KIND_OF_WORD[w] for w in words if w in _KIND_OF_WORD]
    if not kinds or any(w not in _KIND_OF_WORD and w not in _NEUTRAL for w in words):
        return _PLAIN
    return max(kinds)


def _judged(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element's text is never read, and what kind of furniture it looks like."""
    if tag in _NEVER:
        return True, _PLAIN
    kind = _KIND_OF_TAG.get(tag, _PLAIN)
    if not attributes or tag in ("html", "body", "main"):
        return False, kind
    for name, double, single, bare, flag in _ATTRIBUTE.findall(attributes):
        name, value = (name or flag).lower(), double or single or bare
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, kind
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, kind
        if name == "role":
            kind = max(kind, _ROLES.get(value.strip().lower(), _PLAIN))
        if name in ("class", "id"):
            kind = max([kind, *map(_kind_of_token, value.split())])
    return False, kind


class Page:
    """Text blocks of a page: text, path, and the elements that hold them."""

    def __init__(self, page: str):
        self.parents = [-1]  # element number to the number of the element around it
        self.tags = [""]
        self.kinds = [_PLAIN]
        self.paths: dict[tuple[int, str], int] = {}  # (path around, tag) to path
        self.blocks: list[tuple[str, int, int, int]] = []  # text, path, element, characters in links
        self._words: list[str] = []
        self._linked = 0
        # open elements: tag, path, element, dropped, inside a link
        self._open = [("", 0, 0, False, False)]
        self._held: dict[str, int] = {}
        self._read(page)
        self._end_block()

    def _read(self, page: str) -> None:
        at = 0
        while True:
            next_tag = page.find("<", at)
            self._text(page[at:] if next_tag < 0 else page[at:next_tag])
            if next_tag < 0:
                return
            if page.startswith("<!--", next_tag):
                end = page.find("-->", next_tag + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), next_tag):
                end = page.find(">", next_tag)
                at = len(page) if end < 0 else end + 1
                continue
            found = _TAG.match(page, next_tag)
            if not found:
                if re.match(r"</?[A-Za-z]", page[next_tag:next_tag + 3]):  # a broken tag
                    end = page.find(">", next_tag)
                    at = len(page) if end < 0 else end + 1
                else:
                    self._text("<")
                    at = next_tag + 1
                continue
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
            elif tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = len(page) if not end else max(end.end(), page.find(">", end.end()) + 1)
                self._end_block()
            else:
                self._start(tag, found[3])

    def _text(self, text: str) -> None:
        if text and not self._open[-1][3]:
            self._words.append(text)
            if self._open[-1][4]:
                self._linked += len(text)

    def _end_block(self) -> None:
        if self._words:
            text = " ".join(references.unescape("".join(self._words)).split())
            if text:
                holder = next(x for x in reversed(self._open) if x[0] not in _INLINE)
                self.blocks.append((text, holder[1], holder[2], self._linked))
        self._words, self._linked = [], 0

    def _pop(self, depth: int) -> None:
        for tag, *_ in self._open[depth:]:
            self._held[tag] -= 1
        del self._open[depth:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag not in _INLINE:
            self._end_block()
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            depth = len(self._open) - 1
            while self._open[depth][0] in _INLINE:
                depth -= 1
            if self._open[depth][0] == "p":
                self._pop(depth)
        peers = _PEERS.get(tag)
        if peers:
            depth = len(self._open) - 1
            while depth and self._open[depth][0] not in _HOLDS:
                if self._open[depth][0] in peers:
                    self._pop(depth)
                depth -= 1
        _, path, element, dropped, linked = self._open[-1]
        never, kind = _judged(tag, attributes)
        dropped = dropped or never
        if tag in _INLINE:
            dropped = dropped or kind != _PLAIN
            self._open.append((tag, path, element, dropped, linked or tag == "a"))
        else:
            self.parents.append(element)
            self.tags.append(tag)
            self.kinds.append(kind)
            path = self.paths.setdefault((path, tag), len(self.paths) + 1)
            self._open.append((tag, path, len(self.parents) - 1, dropped, linked))
        self._held[tag] = self._held.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if not self._held.get(tag):
            if tag == "p":
                self._end_block()
            return
        if tag not in _INLINE:
            self._end_block()
        depth = len(self._open) - 1
        while self._open[depth][0] != tag:
            if tag in _INLINE and self._open[depth][0] not in _INLINE:
                return  # an inline end tag doesn't close blocks
            depth -= 1
        self._pop(depth)


def _smooth(values: list[float]) -> list[float]:
    weights = {-2: 0.06, -1: 0.24, 0: 0.4, 1: 0.24, 2: 0.06}
    out = []
    for k in range(len(values)):
        near = [(w, values[k + d]) for d, w in weights.items() if 0 <= k + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _kept_blocks(read: Page) -> list[tuple[str, int, int, int]]:
    """The blocks that lie in no element that looks like furniture and doesn't surround the page.

    Elements are numbered in page order, so what is around an element is settled before it.
    """
    size = len(read.parents)
    own, whole = [0] * size, [0] * size  # characters outside links: by nearest flagged element, and in all
    nearest = [0] * size  # itself or the nearest flagged element around it
    for e in range(1, size):
        nearest[e] = e if read.kinds[e] else nearest[read.parents[e]]
    for text, _, element, linked in read.blocks:
        plain = max(0, len(text) - linked)
        own[nearest[element]] += plain
        whole[element] += plain
    around_main = [False] * size  # holds a main or article element that isn't furniture itself
    for e in range(size - 1, 0, -1):
        whole[read.parents[e]] += whole[e]
        around_main[e] |= read.tags[e] in _MAIN and (read.tags[e] == "main" or not read.kinds[e])
        around_main[read.parents[e]] |= around_main[e]
    outside = own[0]
    gone = [_PLAIN] * size  # the kind of the element that drops it
    for e in range(1, size):
        gone[e] = gone[read.parents[e]]
        kind = read.kinds[e]
        if gone[e] or not kind:
            continue
        most = 2 * whole[e] >= whole[0] and (outside == 0 if kind == _COMMENTS else _AROUND * outside < whole[e])
        if most and whole[e] or around_main[e] and kind != _COMMENTS:
            outside += own[e]
        else:
            gone[e] = kind
    first_level = {k for k, block in enumerate(read.blocks) if read.tags[block[2]] == "h1"}
    # a page's first-level headings stay where all of them lie in dropped elements
    only = first_level if all(gone[read.blocks[k][2]] for k in first_level) else frozenset()
    return [block for k, block in enumerate(read.blocks) if not gone[block[2]]
            or gone[block[2]] == _HEADER and read.tags[block[2]] in _HEADINGS
            or k in only and gone[block[2]] != _COMMENTS and read.tags[block[2]] == "h1"]


def main_text(page: str) -> str:
    """The blocks of the article in page order, one on a line."""
    read = Page(page)
    blocks = _kept_blocks(read)
    if not blocks:
        return ""
    seen: dict[int, list[float]] = {}
    for text, path, _, linked in blocks:
        entry = seen.setdefault(path, [0, 0, 0, 0])
        for k, value in enumerate((len(text), len(_PUNCTUATION.findall(text)), 1, min(linked, len(text)))):
            entry[k] += value
    length = _smooth([t * (1 - link / t) / n for t, _, n, link in seen.values()])
    marks = _smooth([p / n for _, p, n, _ in seen.values()])
    fused = {path: size * math.log(2 + mark) for path, size, mark in zip(seen, length, marks)}
    mean = sum(fused.values()) / len(fused)
    level = LEVEL * math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / len(fused))
    menus = {path for path, (t, _, _, link) in seen.items() if link > LINKS * t}
    content = {path for path, x in fused.items() if x >= level and path not in menus}
    only_links = not content
    if only_links:
        content = set(seen)
    # the deepest element that holds all blocks of the content paths
    held = [0] * len(read.parents)
    for _, path, element, _ in blocks:
        held[element] += path in content
    for element in range(len(held) - 1, 0, -1):
        held[read.parents[element]] += held[element]
    spread = _branching(read, blocks)
    whole = max(e for e, n in enumerate(held) if n == held[0] and (spread[e] > 1 or e == 0))
    around, marked = whole, False
    while around > 0:
        if read.tags[around] in _MAIN:
            whole, only_links, marked = around, False, True
        around = read.parents[around]
    inside = [False] * len(held)
    for element in range(len(held)):
        inside[element] = element == whole or element > 0 and inside[read.parents[element]]
    found = [block for block in blocks if inside[block[2]]]
    if not marked:
        found = _without_lists(read, found, content, menus, only_links)
    return "\n".join(block[0] for block in found)


def _without_lists(read: Page, blocks: list[tuple[str, int, int, int]], content: set[int], menus: set[int], only_links: bool
                   ) -> list[tuple[str, int, int, int]]:
    """Blocks less the link blocks at the edges of the content, or all of them where only links are long."""
    heading = [read.tags[block[2]] in _HEADINGS for block in blocks]
    link = [block[1] in menus and not h for block, h in zip(blocks, heading)]
    if only_links:
        return [block for block, is_link in zip(blocks, link) if not is_link]
    holds = [k for k, block in enumerate(blocks) if block[1] in content]
    first = next(k for k, block in enumerate(blocks) if heading[k] or block[1] in content)
    out, headed = [], True
    for k, block in enumerate(blocks):
        if k > holds[-1]:
            headed = heading[k] or headed and link[k] and k > holds[-1] + 1
        if not link[k] or first < k < holds[-1] or k > holds[-1] and headed:
            out.append(block)
    return out


def _branching(read: Page, blocks: list[tuple[str, int, int, int]]) -> list[int]:
    """How many elements with text stand directly in each element; its own text counts as one."""
    holds = [False] * len(read.parents)
    out = [0] * len(read.parents)
    for _, _, element, _ in blocks:
        out[element] = 1
        holds[element] = True
    for element in range(len(out) - 1, 0, -1):
        if holds[element]:
            holds[read.parents[element]] = True
            out[read.parents[element]] += 1
    return out


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points.

    Character references are decoded, white space inside a block becomes one space, and blocks
    follow each other in page order, one on a line. A null or empty page, and one without article
    text, has an empty text. Rows, repeated ones too, and all other columns stay; input columns
    named ``text`` or ``n_chars`` are replaced.
    """

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    return df.withColumn("text", texts(text_or_empty(html))).withColumn("n_chars", F.length("text").cast("bigint"))
