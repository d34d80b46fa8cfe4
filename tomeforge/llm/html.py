"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
length, stop-word density and link density; blocks in menus, footers, adverts and
the like are boilerplate, and what is short or in between stays open. The second
pass gives each open block the label of the nearest decided neighbours. An article
or main element takes part in it: where it holds most of the dense text, blocks
outside it are boilerplate and its ends count as decided text. Stop words count only
on pages that have some, so that texts in other languages go by length and links.
Forms, reader comments and hidden elements are boilerplate too, unless the page has
its text in them alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A comment, an element whose content is no text, a declaration, or a tag. A quoted value ends where a value may end; a
#: quote that never does is a character of its tag.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][\w:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>]|\Z)|[^>=]+|=)*)(?:>|\Z)",
    re.S | re.I,
)
#: What is left of a tag at the end of a page.
OPENED = re.compile(r"</?\Z")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold blocks of one subject: those in them take part in deciding each other.
CONTAINERS = frozenset("article blockquote center details dir div dl fieldset figure header main ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
OUTSIDE = frozenset("nav footer aside menu dialog head".split())
#: Why an element is boilerplate only if there is text elsewhere.
FORM, HIDDEN, COMMENT = 1, 2, 4
#: Words that mark an element by a class, id or role: the whole name, its last part, or its first before words for parts of a page.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
    "masthead newsletter popup modal pagination pager contentinfo complementary".split()
)
#: Words that mark it only as the whole name, or before a word for a part of a page.
WEAK_MARKS = frozenset("alert notice notices login search share social related recommended subscribe widget".split())
PARTS = frozenset(
    "area bar block body bottom box buttons col column container content count dialog feed form group holder icons inner item items left link links list logo message "
    "meta outer overlay panel reply respond right row section signup slot text thread threads title toggle top tree unit widget wrap wrapper".split()
)
SIZE = re.compile(r"\d+(?:x\d+)?")
#: Names of reader comments, alone or before words for parts, or after words for whose they are.
COMMENTS = frozenset("comment comments disqus replies".split())
OWNERS = frozenset("all article blog customer facebook fb guest latest new page post reader readers recent site story user users view visitor visitors wp".split())
#: Words before a name that say what an element is without.
NEGATIONS = frozenset("no not non without has with is".split())
#: An attribute with its value, if any; a quote that is not closed holds the rest of the tag.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for as with was on be by this are at from or an not have "
    "der die das und in zu den von mit ist im für auf ein eine nicht sich auch dem des "
    "le la les de des du et en un une est que qui dans pour pas sur au avec par "
    "el los las del y que un una es por con para se no su lo como al".split()
)
SHORT, LONG, LINKS_MOST, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.05, 0.15
SPACES, WORDS = re.compile(r"\s+"), re.compile(r"[^\W\d_]+")
#: Scripts that write more in a character: Chinese, Japanese, Korean.
DENSE_SCRIPTS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    soft: int
    marked: bool
    content: int
    heading: bool
    container: int
    stops: int = 0
    words: int = 0
    size: int = 0
    label: str = ""

    def measure(self) -> None:
        """Words, stop words, and characters, those of dense scripts threefold."""
        words = WORDS.findall(self.text.lower())
        self.words, self.stops = len(words), sum(map(STOP_WORDS.__contains__, words))
        self.size = len(self.text) if self.text.isascii() else len(self.text) + 2 * len(DENSE_SCRIPTS.findall(self.text))


def attributes_of(tag: str) -> dict[str, str]:
    """Values by lower-cased name, empty without a value; of repeated names the first."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), "".join(values))
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    """Whether an element says that it is not shown: by ``hidden``, ``aria-hidden`` or a ``display`` of none."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    rules = (rule.partition(":") for rule in attributes.get("style", "").lower().split(";"))
    return any(name.strip() == "display" and value.partition("!")[0].strip() == "none" for name, _, value in rules)


def marks(attributes: dict[str, str]) -> tuple[bool, bool]:
    """(whether names mark an element as boilerplate, whether as reader comments)."""
    marked = comments = False
    for name in " ".join(attributes.get(x, "") for x in ("class", "id", "role")).lower().split():
        first, *rest = parts = re.split(r"[-_]+", name.strip("-_"))
        if first in NEGATIONS:
            continue
        of_parts = all(x in PARTS or SIZE.fullmatch(x) for x in rest)
        comments |= first in COMMENTS and of_parts or parts[-1] in COMMENTS and OWNERS.issuperset(parts[:-1])
        marked |= parts[-1] in MARKS or first in MARKS and of_parts or name == "side-bar"
        marked |= first in WEAK_MARKS and (not rest or parts[-1] in PARTS)
    return marked, comments


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """Non-empty blocks in page order, and the container around each container.

    ``content`` numbers the article or main element that holds a block, 0 for none, and ``container`` the innermost
    container, 0 for the page.
    """
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int, int] | None] = []  # None: an inline element that was closed across a block
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    open_blocks: list[int] = []
    around, container = [0], 0
    parts: list[str] = []
    linked = links = content = opened = outside = marked = 0
    softly = {FORM: 0, HIDDEN: 0, COMMENT: 0}  # open elements of each kind
    heading = False

    def close_block() -> None:
        nonlocal linked
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        if text:
            # of the header of an article, its headings stay
            apart = outside > 0 or bool(opened and places["header"] and not heading)
            soft = sum(kind for kind, n in softly.items() if n)
            found.append(Block(text, linked, apart, soft, marked > 0, content if opened else 0, heading, container))
        parts.clear()
        linked = 0

    def leave(entry: tuple[str, bool, bool, bool, int, int]) -> None:
        nonlocal outside, opened, links, marked, container
        places[entry[0]].pop()
        outside -= entry[1]
        marked -= entry[2]
        opened -= entry[3]
        links -= entry[0] == "a"
        container = around[entry[4]] if entry[4] else container
        for kind in softly if entry[5] else ():
            softly[kind] -= entry[5] & kind > 0

    def drop() -> None:
        """Close the innermost element."""
        entry = stack.pop()
        if entry:
            if entry[0] in BLOCKS:
                open_blocks.pop()
            leave(entry)

    def end(name: str) -> None:
        """Close the innermost element of the name: a block with all inside it, another alone if blocks are open inside it."""
        k = places[name][-1]
        if name not in BLOCKS and open_blocks and open_blocks[-1] > k:
            leave(stack[k])
            stack[k] = None
            return
        while len(stack) > k:
            drop()

    at = 0
    for match in TAG.finditer(html):
        if match.start() > at and not places["button"]:
            piece = html[at : match.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = match.end()
        name = (match[3] or "").lower()
        if not name:
            parts.append(" " if match[1] else "")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            close_block()
        if match[2]:
            if places[name]:
                end(name)
            heading = heading and name not in BLOCKS
        elif name not in VOID and not match[4].rstrip().endswith("/"):
            while stack and not stack[-1]:
                stack.pop()
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
                drop()
            if name == "a" and places[name]:
                end(name)
            if places["button"] and (name in ("p", "article", "section") or name in HEADINGS):
                end("button")  # it was never closed
            attributes, main = attributes_of(match[4]) if match[4] else {}, name in ("article", "main")
            by_name, comments = marks(attributes) if attributes else (False, False)
            apart = name in OUTSIDE or name == "header" and not opened
            soft = FORM * (name == "form") + HIDDEN * is_hidden(attributes) + COMMENT * comments
            if name in ("html", "body", "article", "main"):
                soft, by_name = COMMENT * (comments and name == "article"), False
            elif opened and (name == "p" or name in HEADINGS):
                by_name = False
            if main and not opened:
                content += 1
            if name in CONTAINERS:
                around.append(container)
                container = len(around) - 1
            stack.append((name, apart, by_name, main, container if name in CONTAINERS else 0, soft))
            places[name].append(len(stack) - 1)
            if name in BLOCKS:
                open_blocks.append(len(stack) - 1)
            outside += apart
            for kind in softly if soft else ():
                softly[kind] += soft & kind > 0
            marked += by_name
            opened += main
            links += name == "a"
            if name in BLOCKS:
                heading = name in HEADINGS
    rest = OPENED.sub("", html[at:])
    parts.append(rest)
    if links:
        linked += len(rest.strip())
    close_block()
    return found, around


def decide(block: Block, density: bool) -> str:
    """First pass: good, bad, or open where length and density leave it so; ``density`` tells whether stop words count."""
    if block.linked > LINKS_MOST * len(block.text):
        return "bad"
    if block.heading or block.size < SHORT:
        return "open"
    if not density:
        return "good" if block.size > LONG else "open"
    stop = block.stops / max(1, block.words)
    if stop >= STOP_HIGH or stop >= STOP_LOW and block.size > LONG:
        return "good"
    return "open"


def first_pass(page: list[Block]) -> bool:
    """Label all blocks; whether an article or main element is trusted to hold the page's main text."""
    rest = [block for block in page if not block.outside]
    for block in rest:
        block.measure()
    density = sum(b.stops for b in rest) >= STOP_LOW * sum(b.words for b in rest)
    for block in rest:
        block.label = decide(block, density)

    def size(some, *labels: str) -> int:
        return sum(b.size for b in some if b.label in labels)

    # what a form, a hidden element or comments hold counts only where it is about all of the page's text
    for kind, share in ((FORM, 5), (HIDDEN, 0), (COMMENT, 0)):
        free = [block for block in rest if not block.soft and not block.marked]
        held = [block for block in rest if block.soft == kind and not block.marked]
        beside = size(free, "good")
        if size(held, "good") > share * beside and (share or not beside and not any(block.content for block in free)):
            for block in rest:
                block.soft &= ~kind
    rest = [block for block in rest if not block.soft]

    # names that would mark most of the text are those of the page, not of its boilerplate
    plain = [block for block in rest if not block.marked]
    if 5 * size(plain, "good", "open") < size((b for b in rest if b.marked), "good"):
        plain = rest
    inner = [block for block in plain if block.content]
    trusted = 2 * size(inner, "good", "open") >= max(1, size(plain, "good"))
    kept = set(map(id, inner if trusted else plain))
    for block in page:
        if id(block) not in kept:
            block.label, block.outside = "bad", True
    return trusted


def second_pass(page: list[Block], around: list[int], trusted: bool) -> list[bool]:
    """Whether each block is main text: open ones get the label of their nearest decided neighbours.

    Those are looked for in the innermost container that has any. In a trusted article
    its ends count as decided text; on the bare page blocks outside count as boilerplate.
    """
    n, m = len(page), len(around)
    lively, first, last = [False] * m, [n] * m, [-1] * m  # containers with a decided block, and the blocks inside each
    for k, block in enumerate(page):
        c = block.container
        lively[c] |= not block.outside and block.label != "open"
        first[c], last[c] = min(first[c], k), k
    for c in range(m - 1, 0, -1):  # a container's number is above that of the one around it
        p = around[c]
        lively[p] |= lively[c]
        first[p], last[p] = min(first[p], first[c]), max(last[p], last[c])
    home = [0] * m
    for c in range(1, m):
        home[c] = c if lively[c] else home[around[c]]

    def nearest(order: range) -> list[tuple[int, int, int]]:
        """Of each place: the nearest decided block on one side, the same among those not outside, and where the article's run of open blocks ends."""
        found, decided, inside, run = [(0, 0, 0)] * n, order.start - order.step, order.start - order.step, order.start - order.step
        for k in order:
            here = page[k]
            before = page[k - order.step] if 0 <= k - order.step < n else None
            if not before or before.content != here.content or before.label != "open":
                run = k - order.step
            found[k] = decided, inside, run
            if here.label != "open":
                decided = k
                inside = inside if here.outside else k
        return found

    left, right = nearest(range(n)), nearest(range(n - 1, -1, -1))
    any_good = any(block.label == "good" for block in page)

    def neighbour(k: int, places: tuple[int, int, int]) -> tuple[str | None, int]:
        block, c = page[k], home[page[k].container]
        if trusted and block.content:
            j = places[2]
            end = not 0 <= j < n or page[j].content != block.content or page[j].outside
            return "good" if end else page[j].label, abs(j - k)
        j = places[1] if c else places[0]
        if c and not first[c] <= j <= last[c]:
            return None, n
        return page[j].label if 0 <= j < n else "bad", abs(j - k)

    kept = []
    for k, block in enumerate(page):
        if block.label != "open":
            kept.append(block.label == "good")
            continue
        (before, up), (after, down) = neighbour(k, left[k]), neighbour(k, right[k])
        if not any_good and not trusted:
            kept.append(True)  # a page of short blocks alone
        elif block.heading:
            kept.append((after or before) == "good")  # a heading belongs to what it heads
        else:
            kept.append("good" == (before if up < down else after if down < up else "good" if "good" in (before, after) else "bad"))
    return kept


def main_text(html: str | None) -> str:
    """Main-text blocks in page order, joined by one line feed."""
    page, around = blocks(html or "")
    trusted = first_pass(page)
    return "\n".join(block.text for block, kept in zip(page, second_pass(page, around, trusted)) if kept)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of the whole page as ``out``.

    Null and empty pages, and pages without main text, give an empty text; broken or
    cut markup is read as far as it goes; equal pages give equal texts; a column
    already named like the output is replaced.
    """

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return df.withColumn(out, extracted.asNondeterministic()(F.col(f"`{html}`")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
