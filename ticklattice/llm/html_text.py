"""Operator 8, HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ticklattice.llm._util import map_text

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<(?=[a-zA-Z][\w:-]*[^<>]*\Z)[^<]*\Z", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# HTML's element kinds.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav footer aside form dialog menu button select search".split())
CONTAINER = frozenset("article main".split())
# What the names of such blocks are made of.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs masthead footer foot sidebar side aside rail ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recirc widget widgets"
    " comment comments commentlist respond reply replies disqus discussion pagination pager skip toolbar copyright legal disclaimer form search tags".split()
)
# Those of them that an article's own parts may have as well, so that they say nothing inside one.
OWN_NAMES = frozenset("foot side rail notice notices alert related legal disclaimer discussion copyright reply replies tags form search promotion widget widgets".split())
#: Closing one of these also ends open paragraphs and list items; an opening block ends an open paragraph.
IMPLIED = frozenset("p li dd dt option".split())


def _is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment by its tag or its names. Outside
    an article the first or last part of a name tells; inside one only a whole name that no part of an article has."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                if word.lower() in NAMES and not (inside and word.lower() in OWN_NAMES):
                    return True
                parts = [x.lower() for x in re.split(r"[-_]|(?<=[a-z])(?=[A-Z])", word)]
                if not inside and tag not in CONTAINER and (parts[0] in NAMES or parts[-1] in NAMES):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines, stripped of markup: text, its characters outside links, whether it lies in an article. A line ends at
    every block tag, so block tags without text between them leave empty lines, and boilerplate leaves nothing else; line
    distances are those of the page. Character references are decoded and white space is one space."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    buffer: list[str] = []
    linked = links = bad = inside = 0

    def flush() -> None:
        nonlocal linked
        text = "" if bad else " ".join(html.unescape("".join(buffer)).split())
        out.append((text, max(0, len(text) - linked), inside > 0))
        buffer.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal bad, inside
        for _, b, c in stack[i:]:
            bad, inside = bad - b, inside - c
        del stack[i:]

    at, n = 0, len(page)
    while m := TOKEN.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] != ">":
            continue
        closing, attributes = m[1], m[3]
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        block = tag in BLOCK
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if block or i is not None and stack[i][1]:
                flush()
            if i is not None and (block or all(t not in BLOCK for t, *_ in stack[i + 1 :])):
                pop_to(i)
        elif tag not in VOID and not attributes.endswith("/"):
            own = _is_boilerplate(tag, attributes, inside > 0)
            if block or own:
                flush()
                if block and stack and stack[-1][0] in IMPLIED and (stack[-1][0] == "p" or stack[-1][0] == tag):
                    pop_to(len(stack) - 1)
                holds = tag in CONTAINER or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes))
                stack.append((tag, own, holds))
                bad, inside = bad + own, inside + holds
        elif block:
            flush()
    if at < n:
        buffer.append(page[at:])
    flush()
    return out


def main_text(page: str, window: int = 3, share: float = 0.1) -> str:
    """The page's main text: its blocks, each on a line, from the surges to the dives of the line-block distribution.

    Sums of the characters outside links over windows of `window` lines are the distribution. It surges at a line of text
    before which it was nothing, and dives where a whole window is nothing; the lines between are a passage. If the page
    has an article or main element, lines outside such elements count nothing, links inside count like other text, and
    every passage is kept. Otherwise the passages are kept whose highest window reaches `share` of the page's highest,
    without lines that are links for the most part: menus and notices under unknown names are far below, and a page of
    one short text keeps it. Nothing else is dropped or cut.
    """
    lines = lines_of(page)
    inside = any(c and t for t, _, c in lines)
    size = [(len(t) if c else 0) if inside else plain * (2 * plain >= len(t)) for t, plain, c in lines]
    sums = [sum(size[i : i + window]) for i in range(len(size))]
    high = max(sums, default=0)
    kept: list[str] = []
    i = 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        j = i  # the surge
        while j < len(size) and sums[j]:
            j += 1  # the dive
        if inside or max(sums[i:j]) >= share * high:
            kept += [lines[x][0] for x in range(i, j) if size[x]]
        i = j
    return "\n".join(kept)


def extract_html(pages: DataFrame, *, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """`keep` columns with text (the main text of the whole html; empty if there is none or html is null) and n_chars.

    Repeated pages repeat their result; an empty table gives an empty one; truncated pages give what they hold, without
    an unfinished tag.
    """

    def factory():
        def run(texts: list[str]):
            got = [main_text(t) for t in texts]
            return got, [len(x) for x in got]

        return run

    return map_text(pages, html_col, keep, [("text", T.StringType()), ("n_chars", T.LongType())], factory)
