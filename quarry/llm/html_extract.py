"""Main text of web pages: flat text blocks and a small decision tree.

A page is cut into a flat sequence of text blocks at block-level tags. Each
block is described by its word count and link density, the same of the blocks
before and behind it, whether it ends like a sentence, and facts about the
elements around it, each a number of its own: the share of its article or main
element in the largest one's words, whether the page has such an element, a
menu, footer, aside or form around it, a class name that says as much, heading,
list item. A decision tree (Gini impurity, trained here on the blocks of the
labelled pages below) says which blocks are main text. In pages without an
article element, word counts and link densities of a block and its neighbours
decide; within one, they part lists of links from paragraphs with links.

Class names are weak: those of html, body and of every element around the main
part (the largest article or main element, else the first h1, else half of all
words) never count, nor do names that tell of a state or a category
(``no-sidebar``, ``has-comments``, ``tag-social``).

Scale: a page is read on its own, so there is one pass without a shuffle; the
tree is a few dozen numbers. Work grows with the length of the page, whatever
is left open in it.

Cases: null or empty html gives an empty text; tags that are not closed end
with their parents, and silent elements whose parents are not closed either are empty (but scripts and styles, which go to the end); broken tags and comments never reach the text; a very long
page may be a single line; equal blocks each stay; rows that repeat count each;
null keys stay null; other columns, whatever their names, are not read; a table
without rows gives none.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks
from quarry.session import table

# The elements of HTML by how they bear on text.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style noscript template svg math iframe object canvas audio video textarea title select datalist noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav footer aside form menu button dialog fieldset search".split())
MAIN = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark what is not main text.
MARKS = set(
    "ad ads adbox adsense advert adverts advertisement advertising alert archive author banner bio bottombar breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus feedback footer footnote form gdpr hidden legal links login masthead menu menubar meta modal nav navbar navigation newsletter notice notification opinions outbrain overlay pager pagination paywall "
    "popup privacy promo promoted promotion reaction reactions reader related replies reply respond responses search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar trending warning widget widgets".split()
)
# Marks of the page's own head, harmless within the main part, and first words of names that mark no element.
HEAD_MARKS = set("header masthead banner author byline meta".split())
STATES = set("no not has have with without is page single category tag type status format lang post".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks_of(attrs: str) -> int:
    """What class, id or role call an element: 0 nothing, 1 a head, 2 something other than main text, 3 hidden."""
    found = 0
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return 3
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in PART.findall(word)]
                if parts and not (parts[0] in STATES and len(parts) > 1):
                    found = max([found, *(1 if p in HEAD_MARKS else 2 for p in parts if p in MARKS or p in HEAD_MARKS)])
    return found


class Element:
    """A block element: what it is called, what is around it, and how many words outside links are in it."""

    __slots__ = ("apart", "hidden", "marks", "name", "named", "parent", "root", "words", "wraps")

    def __init__(self, name: str, parent: Element | None, marks: int = 0):
        self.name, self.parent, self.marks, self.words, self.wraps = name, parent, marks, 0, False
        self.root = (parent.root if parent else None) or (self if name in MAIN and not (parent and parent.apart) else None)
        self.apart = bool(parent and parent.apart) or name in ASIDE or (name == "header" and not self.root)


class Block:
    __slots__ = ("element", "heading", "item", "linked", "text", "words")

    def __init__(self, text: str, words: int, linked: int, element: Element, heading: bool, item: bool):
        self.text, self.words, self.linked, self.element, self.heading, self.item = text, words, min(linked, words), element, heading, item


def _marked(element: Element | None) -> bool:
    """Whether a name on the way up, below body, says that an element is not main text."""
    while element and element.name not in ("html", "body"):
        if element.marks > 1:
            return True
        element = element.parent
    return False


def settle(elements: list[Element], found: list[Block]) -> list[Block]:
    """Words of every element, which ones are around the main part, and whose names count; the blocks that are not hidden.

    elements: parents before their children.
    """
    for b in found:
        b.element.words += b.words - b.linked
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
    roots = [e for e in elements if e.root is e]
    if len(roots) > 1:
        # several articles beside more text than the largest of them: they are teasers, and the text is outside
        outside = sum(b.words - b.linked for b in found if not b.element.root and not b.element.apart and not _marked(b.element))
        if outside > max(e.words for e in roots):
            for e in elements:
                e.apart, e.root = e.apart or e.root is not None, None
            roots = []
    first = max(roots, key=lambda e: e.words) if roots else next((b.element for b in found if b.element.name == "h1"), None)
    while first and not first.wraps:
        first.wraps, first = True, first.parent
    half = elements[0].words / 2 if elements else 0
    for e in elements:
        around = e.wraps or e.name in ("html", "body") or (not any(r.wraps for r in roots) and e.words > half)
        up = e.parent
        e.hidden = bool(up and up.hidden) or (e.marks == 3 and not around)
        e.named = bool(up and up.named) or (e.marks == 2 and not around) or (e.marks == 1 and not e.root and not around)
    return [b for b in found if not b.element.hidden]


def text_blocks(page: str) -> list[Block]:
    """The page's flat sequence of blocks that have words."""
    out: list[Block] = []
    page_root = Element("", None)
    elements = [page_root]
    stack: list[Element] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0
    at = 0

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                names = [e.name for e in stack[-2:]]
                out.append(Block(text, text.count(" ") + 1, len(references.unescape(" ".join(linked)).split()), stack[-1] if stack else page_root, any(n in HEADINGS for n in names), any(n in ("li", "td", "dt", "dd") for n in names)))
        pieces, linked = [], []

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                linked.append(text)

    n = len(page)
    closings: dict[str, re.Match | None] = {}  # by silent element the closing tag last found, None if there is none further on

    def parent_end(stop: int) -> int:
        """Where the innermost block element that is closed before ``stop`` ends, or ``stop``."""
        for parent in dict.fromkeys(e.name for e in reversed(stack) if e.name not in ("html", "body")):
            depth = 1
            for m in re.compile(rf"<(/?){re.escape(parent)}(?=[\s/>])[^>]*>", re.I).finditer(page, at, stop):
                depth += -1 if m[1] else 1
                if not depth:
                    return m.start()
        return stop

    def silent_end(name: str) -> int:
        """Behind the silent element's closing tag; one without its own ends where its parent does."""
        tag = re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I)
        end = closings.get(name)
        if name not in closings or (end and end.start() < at):
            end = closings[name] = next((m for m in tag.finditer(page, at) if m[1]), None)
        if end is None:
            # no closing tag at all: up to where the parent is closed; where it is not, or is the page itself, nothing is inside
            own = n if name in ("script", "style") else parent_end(n)
            return own if own < n or name in ("script", "style") else at
        if name not in ("script", "style") and (other := tag.search(page, at, end.start())):
            # the closing tag may be that of a later element of the same name
            own = parent_end(other.start())
            if own < other.start():
                return own
        return end.end()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            say(m["data"].replace("&", "&amp;"))
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            pieces.append(" ")
        elif name in SILENT:
            if not closing and not attrs.rstrip().endswith("/"):
                at = silent_end(name)
        elif name in BLOCK:
            end_block()
            links = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                    if stack[k].name in ("article", "main", "section", "div", "td", "body") and name in ("p", "li", *HEADINGS):
                        break
            elif name not in VOID:
                while stack and (stack[-1].name in ("p", *HEADINGS) or (name == "li" == stack[-1].name)):
                    stack.pop()
                stack.append(Element(name, stack[-1] if stack else page_root, marks_of(attrs) if attrs else 0))
                elements.append(stack[-1])
        elif attrs and not closing and name not in VOID and marks_of(attrs) == 3:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else at
    end_block()
    return settle(elements, out)


FEATURES = ("words", "link", "words_before", "link_before", "words_behind", "link_behind", "sentence", "main", "page_main", "apart", "named", "heading", "item")
STOPS = tuple(".!?:;\u2026\"'\u201d\u2019\u00bb)")


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    link = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    back, ahead = np.append(0, words[:-1])[:n], np.append(words[1:], 0)[:n]
    link_back, link_ahead = np.append(0, link[:-1])[:n], np.append(link[1:], 0)[:n]
    largest = max((b.element.root.words for b in found if b.element.root), default=0)
    main = np.array([b.element.root.words / max(largest, 1) if b.element.root else 0 for b in found], float)
    flag = lambda values: np.array([bool(v) for v in values], float)
    sentence = flag(b.text.endswith(STOPS) for b in found)
    apart, named = flag(b.element.apart for b in found), flag(b.element.named for b in found)
    return np.stack([words, link, back, link_back, ahead, link_ahead, sentence, main, np.full(n, float(largest > 0)), apart, named, flag(b.heading for b in found), flag(b.item for b in found)], axis=1)


#: The labelled pages, one block a line: path of its elements (! after a name that class, id or role mark as
#: something else), words, words in links, whether it ends like a sentence (. or -), whether it is main text (+ or -).
LABELLED = """
body/nav/ul/li 1 1 - -
body/nav/ul/li 2 2 - -
body/div! 9 0 . -
body/article/h1 8 0 - +
body/article/p 45 2 . +
body/article/p 2 0 . +
body/article/h2 3 0 - +
body/article/p 120 6 . +
body/article/p 1 0 - +
body/article/ul/li 6 0 - +
body/article/ul/li 14 3 . +
body/article/p 6 6 - +
body/article/p 60 0 . +
body/article/section!/p 30 0 . -
body/article/section!/p 4 0 - -
body/article/section!/p 80 0 . -
body/aside/p 25 2 . -
body/footer 12 2 . -

body/header/h1 3 3 - -
body/header/nav/a 2 2 - -
body/main/h1 9 0 . +
body/main/p 1 0 . +
body/main/p 70 0 . +
body/main/blockquote 15 0 . +
body/main/p 7 5 . +
body/main/p 33 0 . +
body/main/ul/li 6 6 - -
body/main/ul/li 8 8 - -
body/main/ul/li 5 5 - -
body/main/form 12 0 - -
body/div! 40 0 . -
body/div 30 2 . -
body/footer/p 9 1 . -

body/div/ul/li 1 1 - -
body/div/ul/li 2 2 - -
body/div/ul/li 1 1 - -
body/div/h1 7 0 - +
body/div/p 55 2 . +
body/div/p 4 0 . +
body/div/p 80 0 . +
body/div/h2 3 0 - +
body/div/p 35 1 . +
body/div/p 6 0 . +
body/div/p 18 0 . +
body/div! 45 0 . -
body/div! 5 0 - -
body/div 3 3 - -
body/div 6 2 - -

body/div 4 4 - -
body/div 3 2 - -
body/div 5 0 - -
body/table/td 90 3 . +
body/table/td 150 0 . +
body/table/td 12 0 . +
body/table/td 60 0 . +
body/table/td 2 2 - -
body/table/td 3 3 - -
body/div 8 0 - -

body/p 25 0 . +
body/p 40 0 . +
body/p 3 0 . +
body/p 200 10 . +
body/p 22 16 - -
body/p 2 2 - -
body/p 4 0 - -

body/div! 12 0 . -
body/article/div/p 300 0 . +
body/article/div/p 3 0 . +
body/article/div/p 10 0 . +
body/article/footer/p 12 1 . -
body/article/aside/p 40 0 . -
body/article/div!/ul/li 7 7 - -
body/article/div!/ul/li 9 9 - -
body/div/article/p 14 2 . -
body/div/article/p 9 9 - -

body/div/p 70 3 . -
body/article/p 20 1 . +
body/article/p 240 1 . +
body/article/h3 2 0 . +
body/article/p 30 0 . +
body/section/p 90 0 . -
body/section/p 3 0 . -
body/div/p 1 0 . -
body/nav/p 60 4 . -
body/footer/p 80 0 . -

body/article/h1 10 0 . +
body/article/p 12 0 - +
body/article/p 5 0 - +
body/article/p 90 0 - +
body/article/p 3 3 . +
body/article/p 75 0 . +
body/article/div!/p 25 0 . -
body/article/div!/div/p 3 2 - -
body/article/div!/div/p 60 0 . -
body/div!/p 90 0 . -
body/div!/p 1 0 . -
body/aside/p 150 0 . -

body/article/h1 6 0 - +
body/article/p 50 0 . +
body/article/p 2 0 . +
body/article/p 30 9 . +
body/article/p 4 4 - +
body/article/p 44 20 . +

body/article/p 16 0 . +
body/article/p 1 0 . +

body/h1 5 0 - +
body/p 60 2 . +
body/p 2 0 . +
body/p 45 0 . +

body/p 18 0 . +
body/p 9 0 . +

body/div 3 3 - -
body/p 50 0 . +
body/p 7 0 . +
body/p 65 14 . +
body/p 1 0 . +
body/p 30 0 . +
body/div 2 0 - -

body/ul/li 2 2 - -
body/ul/li 1 1 - -
body/p 35 0 . +
body/ul/li 9 0 . +
body/ul/li 24 4 . +
body/p 80 0 . +

body/div! 3 3 - -
body/div! 14 0 . -
body/main/h1 4 0 - +
body/main/p 28 5 . +
body/main/ul/li 3 0 - +
body/main/ul/li 2 0 - +
body/main/p 9 3 . +
body/main/p 15 0 . +

body/article/p 100 0 . +
body/article/aside/p 9 0 . -
body/article/p 8 0 . +
body/article/div! 3 0 - -
body/article/p 5 0 . +
body/aside/p 4 0 - -
body/p 5 0 - -

body/article/h1 2 0 - +
body/article/p 3 0 . +
body/article/p 7 0 . +
body/article/p 1 0 . +
body/article/p 5 0 . +
body/article/p 26 0 . +
body/article/p 4 0 - +
body/article/p 2 0 . +
body/article/p 6 0 . +
body/footer 7 0 . -

body/div! 6 0 . -
body/main/h1 12 0 . +
body/main/p 12 0 . +
body/main/p 4 0 . +
body/main/p 90 0 . +
body/main/p 8 0 . +
body/main/p 3 0 . +
body/footer 10 0 . -

body/div 10 0 . -
body/article/p 6 0 . +
body/article/p 5 0 . +
body/div 45 0 . -
body/footer 3 0 - -

body/p 60 0 - +

body/div 3 3 - -
body/div/p 40 0 - +
body/div/p 25 1 - +
body/div/p 90 0 - +
body/div/p 16 0 - +
body/div 5 5 - -
body/div 2 0 - -

body/div 2 0 - -
body/div 3 0 - -
body/h1 6 0 - +
body/p 45 0 . +
body/p 3 0 . +
body/p 30 0 . +
body/div 4 0 - -
body/div 2 0 - -
body/div 3 0 - -

body/div 5 5 - -
body/div 4 4 - -
body/div/h1 5 0 - +
body/div/p 70 0 . +
body/div/h2 2 0 - +
body/div/p 33 0 . +
body/div 3 0 - -
body/div 5 0 - -
body/div 4 0 - -
"""


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of the blocks of all labelled pages, and whether they are main text."""
    x, y = [], []
    for page in LABELLED.strip().split("\n\n"):
        elements, by_path, found = [Element("", None)], {}, []
        for line in page.split("\n"):
            path, words, linked, stop, label = line.split()
            element, names = elements[0], path.split("/")
            for k, name in enumerate(names):
                key = tuple(names[: k + 1])
                if key not in by_path:
                    by_path[key] = Element(name.rstrip("!"), element, 2 * name.endswith("!"))
                    elements.append(by_path[key])
                element = by_path[key]
            found.append(Block(stop.strip("-"), int(words), int(linked), element, element.name in HEADINGS, element.name in ("li", "td")))
            y.append(label == "+")
        x.append(features(settle(elements, found)))
    return np.concatenate(x), np.array(y, float)


class Tree:
    """A binary decision tree: splits until leaves are pure, or no split helps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 1):
        self.share = float(y.mean())
        self.column = -1
        best = (1e-12, -1, 0.0)
        impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, c] <= cut
                gain = impurity(y) - impurity(y[left]) - impurity(y[~left])
                if min(left.sum(), (~left).sum()) >= least and gain > best[0] + 1e-12:
                    best = (gain, c, float(cut))
        if best[1] >= 0:
            _, self.column, self.cut = best
            left = x[:, self.column] <= self.cut
            self.low, self.high = Tree(x[left], y[left], least), Tree(x[~left], y[~left], least)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.share)
        left = x[:, self.column] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.low(x[left]), self.high(x[~left])
        return out


@lru_cache
def trained() -> Tree:
    return Tree(*labelled_blocks(), least=3)


def main_text(page: str | None, tree: Tree | None = None) -> tuple[str, int, int]:
    """The main text, and how many blocks of how many it takes."""
    found = text_blocks(page or "")
    if not found:
        return "", 0, 0
    use = (tree or trained())(features(found)) >= 0.5
    chosen = [b.text for b, ok in zip(found, use, strict=True) if ok]
    return "\n".join(chosen), len(chosen), len(found)


def extracted(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Keys of every page with text, n_chars, n_main (blocks taken) and n_blocks."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            rows = [main_text(h, tree) for h in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keys, "text", "n_chars", "n_main", "n_blocks"])

    rows = pages.select(*keys, F.col("html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return arrow_map(rows, run, schema + ", text string, n_chars long, n_main long, n_blocks long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
