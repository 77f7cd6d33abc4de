"""Main text of web pages: blocks labelled by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.schema import require_columns

# Fixed: elements of HTML by what they do to text.
RAW = frozenset("script style title textarea noscript template iframe svg select annotation annotation-xml canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("br td th img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset(("html", "body", "button"))
BOILERPLATE_TAGS = frozenset("nav aside footer form menu button dialog fieldset address".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies copyright disclaimer disqus footer form login masthead menu modal nav navbar navigation newsletter notice"
    " notices notification pager pagination popup promo promotion related reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe tags toolbar toc warning widget alert gdpr paywall reader responses feedback".split()
)
# What a name is made of besides says where or how an element stands, not what it holds.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box center col column container content group holder id inner item items left list main outer page"
    " panel post right row section site slot text the top unit user wrap wrapper".split()
)
CONTENT_WORDS = frozenset("article content entry main post prose story".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# Comments and the like as a whole; of a tag only its start, its attributes are read by TagEnds.
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
STOPS = re.compile("[>\"']")
HINTS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
WORD_PARTS = re.compile(r"[a-z]+")

# Weights of the block classifier: log-odds of being content, set by hand. What HTML itself declares to be no main
# text (menus, forms, hidden parts) outweighs all else together. A name does so only if it says nothing else, as
# "comments" does; half a name, as in "reader-view", weighs less than one long paragraph says by itself.
WEIGHTS = {
    "bias": 0.4, "paragraph": 1.0, "heading": 0.2, "list_item": -0.2, "link_share": -4.0, "words": 2.0,
    "sentence": 0.6, "punctuation": 0.5, "content_container": 1.5, "name": -7.0, "declared": -9.0,
}
FULL_WORDS = 30  # words from which on more words say nothing more
FULL_MARKS = 3  # the same for punctuation inside a block
LONG_TEXT, ENOUGH_TEXT = 60, 40  # words: an element this long may be the article; what an article has at least elsewhere
ADJACENT, SIBLING, FAR = 0.6, 0.8, 0.1
SCALE = 1000  # capacities are whole numbers, so that flows are exact


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    link_share: float
    container: int  # the nearest structural element, by number
    depth: int
    content: bool
    declared: bool  # inside an element that HTML declares to hold no main text
    named: int = 0  # the innermost element around it whose name speaks against it, by place in Page.named

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


@dataclass(slots=True)
class Named:
    """An element whose class or id speaks against it: how strongly (0 to 1), and the next such element around it."""

    strength: float
    around: int


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    named: list[Named]  # the first stands for the page


class TagEnds:
    """Where tags end: at the first > outside quotes. A quote that never closes is a plain character.

    Once a tag has no such > up to the end of the page, it and later ones end at their first >, so that broken
    markup is read in linear time.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.broken = page, {c: page.rfind(c) for c in ">\"'"}, False

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes start at ``at``; -1 without one."""
        if at > self.last[">"]:
            return -1
        place = at
        while not self.broken:
            found = STOPS.search(self.page, place)
            if found is None:
                self.broken = True
            elif found[0] == ">":
                return found.start()
            elif found.start() < self.last[found[0]]:
                place = self.page.find(found[0], found.end()) + 1
            else:
                place = found.end()
        return self.page.find(">", at)


def hints_of(attributes: str) -> Iterator[tuple[str, str]]:
    for found in HINTS.finditer(attributes):
        yield found[1].lower(), (found[2] or found[3] or found[4] or "").lower()


def is_declared(tag: str, attributes: str) -> bool:
    """Whether an element's tag, role or visibility says that it holds no main text."""
    if tag in BOILERPLATE_TAGS:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(
        name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in BOILERPLATE_ROLES)
        or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
        for name, value in hints_of(attributes)
    )


def name_evidence(tag: str, attributes: str) -> tuple[float, bool]:
    """How strongly an element's names speak against main text (0 to 1), and whether one speaks for it.

    Of each name counts which share of its words, neutral ones aside, stands for boilerplate.
    """
    against, favour = 0.0, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return against, favour
    for name, value in hints_of(attributes):
        if name in ("class", "id"):
            for token in value.split():
                words = WORD_PARTS.findall(token)
                bad = sum(w in BOILERPLATE_WORDS for w in words)
                if bad:
                    against = max(against, bad / sum(w not in NEUTRAL_WORDS for w in words))
                favour = favour or (len(words) == 1 and words[0] in CONTENT_WORDS)
    return against, favour


def page_of(page: str) -> Page:
    """The page's text blocks in order, with character references decoded and white space single."""
    blocks: list[Block] = []
    named = [Named(0.0, 0)]
    # open structural elements: tag, number, content, declared, named
    stack: list[tuple[str, int, bool, bool, int]] = [("html", 0, False, False, 0)]
    parts: list[str] = []
    linked, in_link, number, at = 0, False, 0, 0
    tag_of_text = "html"

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, container, content, declared, name_at = stack[-1]
                blocks.append(Block(text, tag_of_text, min(1.0, linked / len(text)), container, len(stack), content, declared, name_at))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    length, ends = len(page), TagEnds(page)
    while at < length:
        found = TAG.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at: found.start()])
        at = found.end()
        closing, name = found[1], found[2]
        if not name:
            continue
        end = ends.end(at)
        if end < 0:
            add(found[0])
            continue
        attributes, at = page[at:end], end + 1
        name = name.lower()
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if end is not None:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title"):
                    break  # as in browsers, the rest of the page belongs to it
            add(" ")
            continue
        if name == "a":
            in_link = not closing
        elif name in SPACED and name not in BLOCK:
            parts.append(" ")
        elif name in BLOCK:
            if closing and name not in (s[0] for s in stack):
                flush()
                continue
            flush()
            in_link = False
            if closing:
                while stack[-1][0] != name:
                    stack.pop()
                if len(stack) > 1:
                    stack.pop()
                tag_of_text = stack[-1][0]
                continue
            if name in CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            if name in ("li", "dd", "dt", "tr", "td", "th") and stack[-1][0] == name:
                stack.pop()
            if name not in VOID:
                number += 1
                _, _, content, declared, name_at = stack[-1]
                # A page's own header is boilerplate, an article's is not.
                header = name == "header" and not content
                against, favour = name_evidence(name, attributes)
                if against:
                    named.append(Named(against, name_at))
                    name_at = len(named) - 1
                declared = declared or header or is_declared(name, attributes)
                stack.append((name, number, content or favour or name in CONTENT_TAGS, declared, name_at))
                tag_of_text = name
    flush()
    return Page(blocks, named)


def name_weights(page: Page) -> list[float]:
    """For every named element how much its own and the outer names say against its text, 0 to 1.

    An element with more than half of the page's text is no addition to it: while less than ``ENOUGH_TEXT`` words lie
    outside, its name counts in proportion to them. This goes from the outermost such element inwards.
    """
    own = [0] * len(page.named)
    for b in page.blocks:
        if not b.declared and b.link_share < 0.5:
            own[b.named] += b.words
    inside = own[:]
    largest = [0] * len(own)
    for k in range(len(own) - 1, 0, -1):  # an element comes after those around it
        around = page.named[k].around
        inside[around] += inside[k]
        if not largest[around] or inside[k] >= inside[largest[around]]:
            largest[around] = k
    strength = [n.strength for n in page.named]
    outside, at = own[0], largest[0]
    while at and outside < ENOUGH_TEXT and inside[at] >= LONG_TEXT and 2 * inside[at] > inside[0]:
        strength[at] *= outside / ENOUGH_TEXT
        outside += own[at]
        at = largest[at]
    for k in range(1, len(strength)):
        strength[k] = min(1.0, strength[k] + strength[page.named[k].around])
    return strength


def log_odds(block: Block, name_weight: float) -> float:
    """The classifier: how much more likely content than boilerplate, from the block and its elements alone."""
    w = WEIGHTS
    marks = sum(block.text.count(c) for c in ",.;:!?")
    return (
        w["bias"] + w["words"] * min(block.words, FULL_WORDS) / FULL_WORDS + w["link_share"] * block.link_share
        + w["paragraph"] * (block.tag in ("p", "blockquote", "pre")) + w["heading"] * (block.tag in HEADINGS)
        + w["list_item"] * (block.tag == "li") + w["sentence"] * (block.text[-1] in ".!?:;\"')”»…")
        + w["punctuation"] * min(marks, FULL_MARKS) / FULL_MARKS + w["content_container"] * block.content
        + w["name"] * name_weight + w["declared"] * block.declared
    )


def content_blocks(page: Page) -> list[bool]:
    """The labelling of least cost.

    A block's classifier costs are its terminal capacities. Smoothness edges join neighbours in page
    order, weaker across containers, and consecutive blocks of one parent's parent (DOM proximity).
    """
    blocks, against = page.blocks, name_weights(page)
    odds = [log_odds(b, against[b.named]) for b in blocks]
    as_content = [round(SCALE * math.log1p(math.exp(min(30.0, x)))) for x in odds]  # cost of saying boilerplate
    as_boilerplate = [round(SCALE * math.log1p(math.exp(min(30.0, -x)))) for x in odds]
    edges: list[tuple[int, int, int]] = []
    last_in_place: dict[tuple[int, bool, bool, int], int] = {}
    for k, b in enumerate(blocks):
        place = (b.depth, b.content, b.declared, b.named)
        if k:
            a = blocks[k - 1]
            alike = (a.content, a.declared, a.named) == place[1:]
            edges.append((k - 1, k, round(SCALE * (ADJACENT if alike else FAR))))
        before = last_in_place.get(place)
        if before is not None:
            edges.append((before, k, round(SCALE * SIBLING / (1 + 0.1 * (k - before)))))
        last_in_place[place] = k
    return source_side(as_content, as_boilerplate, edges)


def source_side(from_source: list[int], to_sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source; maximum flow by blocking flows on level graphs.

    What a node can pass from source to sink directly is sent at once, so flow is only looked for
    between nodes of opposite leaning.
    """
    size = len(from_source)
    spare = [s - t for s, t in zip(from_source, to_sink)]
    heads: list[int] = []
    room: list[int] = []
    links: list[list[int]] = [[] for _ in range(size)]
    for a, b, capacity in edges:
        links[a].append(len(heads))
        heads.append(b)
        room.append(capacity)
        links[b].append(len(heads))
        heads.append(a)
        room.append(capacity)

    def levels() -> list[int]:
        level = [-1] * size
        queue = deque(v for v in range(size) if spare[v] > 0)
        for v in queue:
            level[v] = 0
        while queue:
            v = queue.popleft()
            for e in links[v]:
                if room[e] > 0 and level[heads[e]] < 0:
                    level[heads[e]] = level[v] + 1
                    queue.append(heads[e])
        return level

    while True:
        level = levels()
        if not any(level[v] >= 0 and spare[v] < 0 for v in range(size)):
            return [x >= 0 for x in level]
        arc = [0] * size
        for start in range(size):
            while spare[start] > 0:
                path, v = [], start
                while spare[v] >= 0:
                    while arc[v] < len(links[v]):
                        e = links[v][arc[v]]
                        if room[e] > 0 and level[heads[e]] == level[v] + 1:
                            break
                        arc[v] += 1
                    if arc[v] < len(links[v]):
                        path.append(e)
                        v = heads[e]
                    elif path:
                        v = heads[path.pop() ^ 1]
                        arc[v] += 1
                    else:
                        break
                if not path:
                    break
                amount = min(spare[start], -spare[v], min(room[e] for e in path))
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                spare[start] -= amount
                spare[v] += amount


def main_text(page: str) -> str:
    """The content blocks of a page joined by one space."""
    read = page_of(page)
    return " ".join(b.text for b, keep in zip(read.blocks, content_blocks(read)) if keep)


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """``id, url, text, n_chars`` of every page: the article without what surrounds it.

    The library's posts hold no HTML, so this takes any table with an id, a url and a page. A page
    becomes text blocks with character references decoded and white space single; a classifier gives each
    block its cost as content and as boilerplate, and a minimum cut labels all blocks of the page at
    once. An element's class and id are one bounded feature among those of the text, so that long prose
    stays under any name. Content blocks are joined in order by one space; nothing else is dropped, whatever the length.

    Null or empty pages, and pages without content: empty text, 0 characters. Unclosed tags, comments and
    scripts are read as browsers do. Null ids and repeated rows stay; other columns are not read; an
    empty table gives an empty result. One pass, no shuffle.
    """
    require_columns(pages, [id_column, url_column, html_column], "pages")

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py() or "") for page in batch], pa.string())

    extracted = pages.select(
        F.col(id_column).alias(id_column), F.col(url_column).alias(url_column),
        extract(F.col(html_column).cast("string")).alias("text"),
    )
    return extracted.withColumn("n_chars", F.length("text").cast("bigint"))
