"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its words and link
density, those of the blocks before and after it, and where it stands (inside an article, inside
navigation, a footer, a form and so on; names of classes and ids give hints). A decision tree,
trained on a small table of labelled blocks (LABELLED, below), says which blocks are main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import col

# elements whose content is no text at all; the first two end at their own end tag whatever stands between
_RAW = frozenset("script style".split())
_HIDDEN = _RAW | frozenset(
    "noscript template svg math iframe object canvas select textarea button audio video title".split()
)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDING = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# tags that stay open around blocks; others never count as surroundings
HOLDERS = BLOCK_TAGS - frozenset("p li dt dd option tr td th h1 h2 h3 h4 h5 h6 hr".split())
CHROME_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu "
    "breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar comment comments discussion "
    "replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended recommendations more widget pagination pager tags tag copyright "
    "legal disclaimer search form feedback complementary contentinfo navigation skip".split()
)
ARTICLE_WORDS = frozenset("article content post entry story body text main".split())

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_chrome", "hint_chrome",
    "hint_article", "heading", "page_has_article",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_chrome: bool
    hint_chrome: bool
    hint_article: bool
    heading: bool


class Scanner:
    """Text and tags of a page, in one pass from left to right.

    Every position is looked at a bounded number of times: what does not occur any more further on (a
    tag's end, a closing quote, an end tag) is remembered.
    """

    def __init__(self, page: str):
        self.page = page
        # where lower() keeps every place, end tags are found in any case
        low = page.lower()
        self.low = low if len(low) == len(page) else page
        self.quotes = True
        self.last: dict[str, int] = {}

    def _find(self, what: str, start: int) -> int:
        last = self.last.get(what)
        if last is None:
            last = self.last[what] = self.low.rfind(what)
        return self.low.find(what, start) if start <= last else -1

    def _tag_end(self, start: int) -> int:
        """Place of the > that ends the tag, quoted values left out; -1 if there is none."""
        at = start
        while self.quotes:
            if self._find(">", at) < 0:
                return -1
            stop = _STOP.search(self.page, at)
            mark = stop.group()
            if mark == ">":
                return stop.start()
            at = self._find(mark, stop.end()) + 1
            if not at:  # a quote that never ends: from here on quotes mean nothing
                self.quotes = False
        end, following = self._find(">", start), self._find("<", start)
        return end if end >= 0 and not 0 <= following < end else -1

    def _past(self, name: str, start: int) -> int:
        """Place after the end tag of that name, -1 if there is none."""
        at = start
        while (at := self._find(f"</{name}", at)) >= 0:
            after = at + len(name) + 2
            if after >= len(self.page) or self.page[after] in " \t\r\n\f/>":
                end = self._find(">", after)
                return len(self.page) if end < 0 else end + 1
            at = after
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, tag name or empty, whether it is an end tag, attributes); the last one has no tag."""
        page, at, text = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                yield page[text:at], "", False, ""
                end = self._find("-->", at + 4)
                at = text = len(page) if end < 0 else end + 3
                continue
            closing = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + closing)
            if not name:
                end = self._find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") else -1
                if end < 0:
                    at += 1
                else:
                    yield page[text:at], "", False, ""
                    at = text = end + 1
                continue
            end = self._tag_end(name.end())
            if end < 0:
                at += 1
                continue
            tag, attrs, before = name.group().lower(), page[name.end() : end], page[text:at]
            at = text = end + 1
            if tag in _HIDDEN and not closing:
                yield before, "", False, ""
                past = -1 if attrs.endswith("/") and tag not in _RAW else self._past(tag, at)
                if past >= 0:
                    at = text = past
                elif tag in _RAW:
                    at = text = len(page)
                continue
            yield before, tag, closing, attrs
        yield page[text:], "", False, ""


# what holds inside an open element: the element itself and all that surround it
@dataclass(frozen=True, slots=True)
class _Around:
    tag: str
    in_article: bool
    in_chrome: bool
    hint_chrome: bool
    hint_article: bool
    hidden: bool


_NOTHING = _Around("", False, False, False, False, False)


def _inside(around: _Around, tag: str, attrs: str) -> _Around:
    """What holds inside a new element; what surrounds the innermost article says nothing about its inside."""
    chrome_hint, article_hint, hidden = _hints(attrs)
    article = tag in ARTICLE_TAGS or tag != "#" and 'role="main"' in attrs
    chrome = tag in CHROME_TAGS or tag == "header" and not around.in_article
    hint_article, hidden = around.hint_article or article_hint, around.hidden or hidden
    if article:
        return _Around(tag, True, False, False, hint_article, hidden)
    return _Around(
        tag, around.in_article, around.in_chrome or chrome, around.hint_chrome or chrome_hint, hint_article, hidden
    )


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks of a page in order; character references decoded, white space made single."""
    out: list[Block] = []
    stack: list[_Around] = [_NOTHING]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = heading = in_head = False

    def flush() -> None:
        nonlocal parts, link_parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            around = stack[-1]
            if text and not around.hidden and not in_head:
                linked = len(html.unescape(" ".join(link_parts)).split())
                out.append(Block(
                    text, len(text.split()), linked, around.in_article, around.in_chrome, around.hint_chrome, around.hint_article, heading
                ))
        parts, link_parts = [], []

    def leave_paragraph() -> None:
        while stack[-1].tag == "#":
            stack.pop()

    for before, name, closing, attrs in Scanner(page or ""):
        if before:
            parts.append(before)
            if in_link:
                link_parts.append(before)
        if not name:
            continue
        if name == "head":
            flush()
            in_head = not closing
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        if name not in BLOCK_TAGS:
            continue
        flush()
        in_link = False
        if not closing and name != "html":
            in_head = False  # its end tag may be left out
        heading = not closing and len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if name not in HOLDERS:
            if not closing and name not in VOID_TAGS:
                # hints on a paragraph or list item hold until the next block tag
                leave_paragraph()
                if attrs:
                    stack.append(_inside(stack[-1], "#", attrs))
            elif closing and stack[-1].tag == "#":
                stack.pop()
            continue
        leave_paragraph()
        if closing:
            if open_tags.get(name):
                while (left := stack.pop().tag) != name:
                    open_tags[left] -= left != "#"
                open_tags[name] -= 1
        elif not attrs.endswith("/"):
            stack.append(_inside(stack[-1], name, attrs))
            open_tags[name] = open_tags.get(name, 0) + 1
    flush()
    return out


def _hints(attrs: str) -> tuple[bool, bool, bool]:
    """Hint of chrome, hint of article, hidden.

    In a name of several words the last one says what it is, so article-footer is a footer, but any word
    may say that it belongs to the surroundings. Names that contradict each other say nothing.
    """
    if not attrs:
        return False, False, False
    chrome = article = False
    for m in _NAMES.finditer(attrs):
        for token in next(g for g in m.groups() if g is not None).lower().split():
            words = [w for w in _SPLIT.split(token) if w]
            if not words or words == ["header"]:  # the header may be that of the article
                chrome = chrome or bool(words) and not article
            elif words[-1] in ARTICLE_WORDS and not (set(words) - {"header"}) & CHROME_WORDS:
                article = True
            elif set(words) & CHROME_WORDS:
                chrome = True
    return chrome and not article, article, bool(_HIDING.search(attrs))


def describe(blocks: list[Block]) -> np.ndarray:
    """FEATURES of every block; neighbours beyond the page have no words."""
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in blocks], float)
        links = np.array([b.linked / max(1, b.words) for b in blocks])
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
        x[:, 11] = any(b.in_article for b in blocks)
        x[:, 6:11] = [(b.in_article, b.in_chrome, b.hint_chrome, b.hint_article, b.heading) for b in blocks]
    return x


@dataclass
class Tree:
    """A binary decision tree: ``feature`` <= ``cut`` goes left; a leaf has its answer."""

    answer: bool
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.answer)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4) -> Tree:
    """CART with the Gini index; ties go to the first feature and the lowest cut."""
    node = Tree(bool(2 * y.sum() > len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None or best[0] >= len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-12:
        return node
    low = x[:, best[1]] <= best[2]
    return Tree(node.answer, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def _fill(count: int, seed: int) -> str:
    """Filler words for the labelled pages; only their number matters."""
    return " ".join(f"w{(seed * 31 + i * 7) % 97}" for i in range(count))


def labelled_pages() -> list[str]:
    """The labelled table: small pages in common layouts. A block whose text starts with '+' is
    main text, one that starts with '-' is not."""
    pages = []
    menus = (
        "<nav><ul><li><a href=/>- home</a></li><li><a href=/n>- news</a></li><li><a href=/a>- about us</a></li></ul></nav>",
        "<div class='nav-menu'><a href=/>- home</a> <a href=/n>news</a> <a href=/c>contact</a></div>",
        "<header><p>- site name</p><ul><li><a href=/>- start</a></li><li><a href=/x>- topics</a></li></ul></header>",
        "<div><ul><li><a href=/>- first</a></li><li><a href=/x>- second of them</a></li><li><a href=/y>- third</a></li></ul></div>",
    )
    sides = (
        "<aside><h3>- read next</h3><p>- {a}</p></aside>",
        "<div class='sidebar'><h3>- popular</h3><p>- {a}</p><p><a href=/p>- {b}</a></p></div>",
        "<div class='ad'>- {b}</div>",
        "<div id='cookie-notice'>- {a}</div>",
        "<form><label>- your mail</label><p>- {b}</p></form>",
        "<div class='ads banner'><p>- {c}</p></div>",
        "<nav><a href=/1>- part one</a> <a href=/2>part two</a></nav>",
        "<div class='share-bar'><a href=/s>- share</a></div>",
        "<div class='newsletter-signup'><p>- {b}</p></div>",
        "<div role='complementary'><p>- {a}</p></div>",
        "<section id='reader-comments'><h3>- what readers say</h3><p>- {c}</p></section>",
        "<footer><p>- {b}</p></footer>",
    )
    ends = (
        "<footer>- all rights reserved {b}</footer>",
        "<section class='comments'><h2>- comments</h2><p>- {c}</p><p>- {a}</p></section><footer><p>- {b}</p></footer>",
        "<div class='footer'><a href=/i>- imprint</a> {b}</div>",
        "<div id='related-posts'><h3>- related</h3><p><a href=/r>- {b}</a></p><p>- {a}</p></div>",
        "<div><p>- {b}</p><p><a href=/t>- terms of use</a></p></div>",
        "<div><p>- {b}</p></div>",
    )
    holders = (
        ("<article><h1>+ {b}</h1>", "</article>"),
        ("<main><article><header><h1>+ {b}</h1></header>", "</article></main>"),
        ("<div class='post-content'><h1>+ {b}</h1>", "</div>"),
        ("<div><h1>+ {b}</h1>", "</div>"),
    )
    rng = random.Random(7)
    for i in range(240):
        menu, side, end = menus[i // 3 % 4], sides[i % 12], ends[i % 6]
        first, last = holders[(i // 2) % 4]
        # without an article element or a telling name only longer paragraphs can be told from the rest
        plain = first.startswith("<div><h1>")
        sizes = (25, 40, 60, 120) if plain else (1, 2, 3, 5, 8, 13, 25, 40, 60, 120)
        body = "".join(f"<p>+ {_fill(rng.choice(sizes), i + k)}</p>" for k in range(rng.randrange(1, 5)))
        if not plain:
            body += rng.choice((
                # links side by side are no main text, one among prose is
                "<ul><li><a href=/m>- {b}</a></li><li><a href=/n>- {b} again</a></li><li><a href=/o>- one more</a></li></ul><p>+ {c} end</p>",
                "", "", "<ul><li>+ a <a href=/q>point</a> or two</li><li>+ three</li></ul>", "<p><a href=/z>+ a line that is a link</a></p>",
                "<h2>+ a part</h2><p>+ its words</p>",
            ))
        # what is no main text stands inside the article as well
        inner = "" if plain or i % 4 == 0 else sides[(i // 8) % 12]
        page = f"<body>{menu}{side}{first}{inner}{body}{last}{sides[(i + 5) % 12]}{end}</body>"
        small, any_size = (2, 3, 5, 8), (2, 3, 5, 8, 13, 20, 35, 60)
        pages.append(
            page.replace("{a}", _fill(rng.choice(any_size), i)).replace("{b}", _fill(rng.choice(small), i))
            .replace("{c}", _fill(rng.choice(any_size), i))
        )
    return pages


def train_tree(pages: list[str] | None = None) -> Tree:
    """The tree of the labelled table."""
    xs, ys = [], []
    for page in labelled_pages() if pages is None else pages:
        blocks = blocks_of(page)
        xs.append(describe(blocks))
        ys += [b.text.startswith("+") for b in blocks]
    return grow(np.vstack(xs), np.array(ys))


def main_text(page: str | None, tree: Tree) -> str:
    """Main text blocks in page order, joined by a line break. If the tree finds none, all blocks that are
    not marked as surroundings and are not mostly links."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    chosen = [b.text for b, ok in zip(blocks, tree.predict(describe(blocks))) if ok]
    if not chosen:  # a page of short paragraphs in a layout that says nothing
        chosen = [b.text for b in blocks if not (b.in_chrome or b.hint_chrome) and 3 * b.linked < b.words]
    return "\n".join(chosen)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    A null or empty page, and one without main text, gives an empty text. Ids and urls are passed
    on as they are, nulls and repeats included. An empty table gives none. Other columns are not
    read. Broken markup is read as far as it goes, in time proportional to the page; an unclosed comment,
    script or style hides the rest, other elements that are never closed hide nothing.
    """
    tree = train_tree()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(t, tree) for t in texts], dtype=object)

    out = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), run(col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
