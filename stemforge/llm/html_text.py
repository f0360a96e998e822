"""Main text of web pages by tree scoring.

A page is parsed to a tree of blocks.  Every paragraph-like block earns points from its length and its commas, which
pass to its ancestors (all to the parent, half to the next, a third of that to those above) discounted by their link
density.  The container with the most points is the article; siblings that score well or read like running text are
kept with it.  Inside, blocks of navigation, forms, notices and the like are left out.

The page is read in one pass by the standard's rules for markup (quoted and unquoted attributes, comments, raw text, bogus
comments), each character a bounded number of times.  One departure: a quoted value without an end is read as an unquoted
one, so that it does not take the rest of the page with it.  Drawings (svg) are no text and end at the first element that
cannot be in one; formulas (math) are text without their annotations.  A header inside an article belongs to it.

Defined results: a null or empty page has an empty text; white space inside a block becomes one space, blocks are
trimmed and joined by one line feed in page order; character references are decoded once; unclosed and stray tags are
read as browsers do for blocks (a new paragraph ends an open one); a tag that the page ends in is no text; pages of any
size are read whole; where no container stands out, the whole body is read; of equal containers the first in page order
wins; repeated rows are each extracted; rows with a null page_id or url keep it; extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Elements by the HTML standard: fixed values.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select button legend svg foreignobject template annotation annotation-xml".split()
)
#: Elements that end a drawing they come in.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside nav footer header form figure a".split()
)
PARAGRAPH = frozenset("p pre blockquote td dd dt li h1 h2 h3 h4 h5 h6 figcaption div section article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold an article's own words.
OUT = frozenset("nav header footer aside form menu dialog button select option fieldset legend search svg template annotation annotation-xml".split())
#: Blocks that stand beside paragraphs in running text.
FLOW = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6".split())
#: Elements left out that stand within a line.
INLINE = frozenset("svg template annotation annotation-xml button select option dialog".split())
#: Elements that an open <p> ends before.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption", "option", "select", "button", "legend", "svg", "template", "annotation", "annotation-xml", "foreignobject"}
#: Elements that end an open one of their family, up to the family's container.
FAMILY = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
CONTAINER = frozenset("ul ol dl table html body menu select template foreignobject".split())
BAD = frozenset(
    "ad ads banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login comment comments commentlist replies respond disqus discussion sidebar widget related share sharing social breadcrumb breadcrumbs pagination pager nav navbar navigation menu masthead header footer toolbar copyright legal search hidden".split()
)
BAD_START = ("advert", "sponsor", "promo", "recommend")
#: Names that say the opposite, or whose header is the article's own.
NOT_BAD, OWN = frozenset("no has with without free".split()), frozenset("entry post article story content".split())
GOOD = frozenset("article body content entry main page post story text blog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
SPACE = re.compile(r"\s+")
#: Pieces of markup; each is matched where the one before it ended.
PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
GAP = re.compile(r"[\t\n\f\r /]*")
BLANK = re.compile(r"[\t\n\f\r ]*")
ATTRIBUTE = re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
UNQUOTED = re.compile(r"[^\t\n\f\r >]*")


def bad_names(names: str) -> bool:
    """Whether a class or id says that an element is not part of an article."""
    for name in names.lower().split():
        parts = set(re.split(r"[-_]+", name))
        if parts & NOT_BAD:
            continue
        bad = parts & BAD | {p for p in parts if p.startswith(BAD_START)}
        if "skip" in parts and "link" in parts or "side" in parts and "bar" in parts or bad - ({"header"} if parts & OWN else set()):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "out", "named", "hint", "kids", "score", "text", "links", "scope", "inside")

    def __init__(self, tag: str, parent, a: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.kids: list = []  # nodes, and text as (text, in a link)
        self.score, self.text, self.links = 0.0, 0, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.out, self.hint = tag in OUT and not (tag == "header" and self.inside), 0
        self.named = False  # out by its names alone
        if a and tag not in ("body", "html"):
            names = f"{a.get('class', '')} {a.get('id', '')}"
            if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                self.out = True
            elif not self.out and tag not in ("article", "main") and bad_names(names):
                self.out = self.named = True
            self.hint = 25 if GOOD & set(re.split(r"[\s_-]+", names.lower())) else 0
        # the nearest open element of each family, up to the family's container
        family = FAMILY.get(tag)
        self.scope = {} if parent is None or tag in CONTAINER else parent.scope
        if family:
            self.scope = self.scope | {family: self}


def tokens(page: str):
    """(text, tag, closing, attributes, self-closing) in order: text before each tag, and the tag ('' at the end and for what is no tag).

    The caller sends back the name of a raw element to have its content as the next text, marked by the tag '!', and to '' whether
    character data sections are text where it is."""
    pos, end = 0, len(page)
    missing: set[str] = set()  # what does not come again before the end of the page

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        i = page.find(what, at)
        if i < 0:
            missing.add(what)
        return i

    start = 0
    while pos < end:
        i = page.find("<", pos)
        if i < 0 or i + 1 >= end:
            break
        m = PLAIN.match(page, i)
        if m:
            pos, tag, closing, attributes, itself = m.end(), m[2].lower(), bool(m[1]), {}, False
        else:
            c = page[i + 1]
            at = i + 1 + (c == "/")
            m = NAME.match(page, at)
            if m is None:
                if c not in "!/?":  # a lone '<' is text
                    pos = i + 1
                    continue
                if page.startswith("<!--", i):
                    if page.startswith((">", "->"), i + 4):
                        pos = page.index(">", i + 4) + 1
                    else:
                        a, b = find("-->", i + 4), find("--!>", i + 4)
                        pos = min((x + n for x, n in ((a, 3), (b, 4)) if x >= 0), default=end)
                elif page.startswith("<![CDATA[", i):
                    shown = yield page[start:i], "", False, {}, False
                    stop = find("]]>" if shown else ">", i)
                    pos = end if stop < 0 else stop + (3 if shown else 1)
                    if shown:
                        yield page[i + 9 : end if stop < 0 else stop], "", False, {}, False
                    start = pos
                    continue
                else:
                    stop = find(">", i)
                    pos = end if stop < 0 else stop + 1
                yield page[start:i], "", False, {}, False
                start = pos
                continue
            tag, closing, attributes, itself = m[0].lower(), c == "/", {}, False
            at = m.end()
            while True:
                at = GAP.match(page, at).end()
                if at >= end or page[at] == ">":
                    break
                m = ATTRIBUTE.match(page, at)
                at, value = BLANK.match(page, m.end()).end(), ""
                if at < end and page[at] == "=":
                    at = BLANK.match(page, at + 1).end()
                    stop = find(page[at], at + 1) if at < end and page[at] in "\"'" else -1
                    if stop >= 0:
                        value, at = page[at + 1 : stop], stop + 1
                    else:
                        v = UNQUOTED.match(page, at)
                        value, at = v[0], v.end()
                attributes.setdefault(m[0].lower(), value)
            itself = page[at - 1] == "/"
            pos = min(at + 1, end)
            if at >= end:  # the page ends inside the tag
                tag = ""
        raw = yield page[start:i], tag, closing, attributes, itself
        start = pos
        if raw:
            stop, low = pos, None
            while "</" not in missing:  # the element's own end tag, in any case
                stop = find("</", stop)
                if stop < 0:
                    break
                low = page[stop + 2 : stop + 2 + len(raw)].lower()
                if low == raw and page[stop + 2 + len(raw) : stop + 3 + len(raw)] in ("", *"\t\n\f\r />"):
                    break
                stop += 2
            pos = end if stop < 0 or low != raw else stop
            yield page[start:pos], "!", False, {}, False
            start = pos
    if start < end:
        yield page[start:], "", False, {}, False


def parse(page: str) -> Node:
    """The tree of blocks; inline elements only mark text as linked."""
    root = node = Node("html", None, {})
    opened = {"html": 1}
    link = formula = False
    source, answer = tokens(page), None

    def leave(x: Node) -> Node:
        """Close all open blocks up to x, and x."""
        at = node
        while True:
            opened[at.tag] -= 1
            if at is x:
                return x.parent
            at = at.parent

    def enter(tag: str, attributes: dict[str, str]) -> Node:
        child = Node(tag, node, attributes)
        node.kids.append(child)
        opened[tag] = opened.get(tag, 0) + 1
        return child

    while True:
        try:
            text, tag, closing, attributes, itself = source.send(answer)
        except StopIteration:
            return root
        answer = None
        if text and tag != "!":
            node.kids.append((html.unescape(text) if "&" in text else text, link))
        if tag == "":
            answer = formula or opened.get("svg", 0) > 0
            continue
        if node.tag == "svg" and (tag in BREAKS_OUT if not closing else tag == "p"):
            node = leave(node)
        if tag in RAW:
            if not closing and node.tag != "svg":
                answer = tag
                shown, inner, *_ = source.send(answer)
                answer = None
                if tag == "xmp" and inner == "!":  # raw text that is shown
                    node = enter("pre", {})
                    node.kids.append((shown, link))
                    node = leave(node)
            continue
        if tag == "br":
            node.kids.append((" ", link))
        elif tag == "a":
            link = not closing
        elif tag == "math":
            formula = not closing
        elif tag == "hr":
            while node.tag == "p":
                node = leave(node)
            node.kids.append(Node("hr", node, {}))
        elif tag not in BLOCK:
            continue
        elif not closing:
            if tag in ENDS_P:
                while node.tag == "p" or node.tag in HEADING and tag in HEADING:
                    node = leave(node)
            if tag in ("html", "body") and opened.get("body" if tag == "body" else "html"):
                continue
            for family in {"tr": ("td", "tr")}.get(tag, (FAMILY[tag],) if tag in FAMILY else ()):
                x = node.scope.get(family)
                if x is not None:
                    node = leave(x)
            if link and tag in ("nav", "article", "main", "footer", "section"):
                link = False
            node = enter(tag, attributes)
            if itself and tag in ("svg", "annotation"):
                node = leave(node)
        elif tag not in ("html", "body") and opened.get(tag):
            x = node
            while x.tag != tag:
                x = x.parent
            node = leave(x)
            link = False


def _clean(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def _spare(root: Node) -> None:
    """A block that is out by its names alone is kept after all where it holds the main element, or a first heading and running text."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if isinstance(k, Node)]
    holds: dict[int, tuple[bool, bool, int]] = {}
    for x in reversed(order):  # (main, h1, long paragraphs) below x
        main, first, long = x.tag == "main", x.tag == "h1", 0
        own = 0
        for k in x.kids:
            if isinstance(k, Node):
                m, f, n = holds[id(k)]
                main, first, long = main or m, first or f, long + n
            else:
                own += len(k[0])
        long += x.tag == "p" and own > 80
        holds[id(x)] = main, first, long
        if x.named and (main or first and long > 1):
            x.out = False


def _measure(root: Node) -> list[Node]:
    """Sums of text and link characters from the leaves up, blocks left out; all nodes in page order."""
    _spare(root)
    nodes, stack = [], [root]
    while stack:
        x = stack.pop()
        nodes.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.out]
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, Node):
                if not k.out:
                    x.text += k.text
                    x.links += k.links
            else:
                n = len(_clean(k[0]))
                x.text += n
                x.links += n * k[1]
    return nodes


def _density(x: Node) -> float:
    return x.links / x.text if x.text else 0.0


def best(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order."""
    nodes = _measure(root)
    for x in nodes:
        if x.tag not in PARAGRAPH:
            continue
        own = _clean(" ".join(k[0] for k in x.kids if not isinstance(k, Node)))
        if not own or x.parent is None:
            continue
        points = 1.0 + own.count(",") + min(len(own) / 100, 3.0)
        share, up = 1.0, x.parent if x.tag not in ("div", "section", "article", "main") else x
        level = 0
        while up is not None and share > 1e-9:  # what passes further is nothing
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else share / 3 if level > 2 else 0.5 / 3
            up = up.parent
    top, most = root, -1.0
    for x in nodes:
        if x.score > 0:
            bonus = x.hint + {"article": 30, "main": 25, "section": 5, "div": 5, "blockquote": 3, "ul": -3, "ol": -3, "li": -5, "td": 2}.get(x.tag, 0)
            value = (x.score + bonus) * (1 - _density(x))
            if value > most:
                top, most = x, value
    if top.parent is None:
        return [top]
    limit = max(10.0, most * 0.2)
    keep = []
    for k in top.parent.kids:
        if not isinstance(k, Node) or k.out:
            continue
        if k is top or k.score * (1 - _density(k)) > limit and k.tag not in HEADING or k.tag == top.tag == "article":
            keep.append(k)
        elif k.text and (k.tag == "h1" or _density(k) < 0.25 and (k.tag == "p" and k.text > 80 or k.tag in FLOW and top.tag not in ("article", "main"))):
            keep.append(k)
    return keep


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node in page order."""
    out: list[str] = []
    open_text: list[str] = []

    def flush() -> None:
        text = _clean("".join(open_text))
        if text:
            out.append(text)
        open_text.clear()

    stack: list = [iter(node.kids)]
    while stack:
        for k in stack[-1]:
            if isinstance(k, Node):
                if k.out and k.tag in INLINE:
                    continue
                flush()
                if not k.out:
                    stack.append(iter(k.kids))
                    break
            else:
                open_text.append(k[0])
        else:
            stack.pop()
            flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for n in best(parse(page)) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def run(source):
        for batch in K.batches(source, "html"):
            text = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
