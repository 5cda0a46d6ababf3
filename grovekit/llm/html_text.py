"""Main-text extraction from HTML by composite text density.

A small tolerant parser builds the DOM. For every node the characters, the link characters, the tags and the link
tags below it are counted, and its density is the characters per tag, adjusted for links: a node whose text is mostly
links scores low. The density sum of a node is the sum over its children, its own text counting as one more child.
The node with the largest density sum, whatever its element, marks the body: the least density on the path from it to
the body element is the threshold. From the body down every node that reaches the threshold gives its maximum-sum
subtree, in page order; what falls below is left out with all that is in it. In a chosen subtree, too, what is mostly
link text goes if it falls below the threshold.

Elements, roles and names of menus, notices, adverts, forms, reader comments and the like are a prior: the text in them
counts as link text. So it makes no body, weighs against the nodes that hold it, and falls below the threshold wherever
there is other text; where there is none, names are not believed, and a form, an aside, a header or a role that holds nearly
all text of the page is not believed either. A name counts only if all its words are such words: a class "search-tips"
says nothing.

The logarithm in the composite density grows with the size of a node without links, so a smaller block would have to
be denser than the whole page that it is part of. A node also reaches the threshold if its characters outside links
per tag are no fewer than the least of those on the path.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import project

_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
#: What may stand in a tag behind its name, by the quotes that still come in pairs: a value in quotes may hold any character.
_REST = {q: re.compile("(?:[^>%s]%s)*+" % (q, "".join(f"|{c}[^{c}]*+{c}" for c in q))) for q in ("\"'", "\"", "'", "")}
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noframes")}
_MARKERS = ("id", "class", "role", "aria-label")
#: Elements without content, those whose content is never text of the page, and those around the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select button input xmp noframes datalist".split())
_AROUND = frozenset("nav footer aside menu form dialog".split())
#: Elements that end a block of text; an inline element does not.
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the first kind ends where one of the second kind begins.
_CLOSES = {"p": _BLOCK - {"br", "body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words in ids and classes of what surrounds an article; those of it only outside an article; and words beside them.
_BOILER = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb sidebar aside footer masthead topbar toolbar comment commentlist respond disqus reply replies cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendation widget pagination pager skip skiplink copyright form search tag tags tracking outbrain taboola".split())
_HEADER = frozenset("header head hero".split())
_PARTS = frozenset("area article bar block blog body bottom box button buttons card container content count foot google group header icon inline inner item items large left link links list main mobile outer page panel post reader right row section side site slot small story text thread title top unit user wrap wrapper".split())
_CORE = frozenset("article content main post entry story article-body article-content article-text post-body post-content entry-content entry-body main-content story-body page-content body-text".split())
_ROLES = frozenset("navigation complementary contentinfo search form alert alertdialog dialog banner".split())
#: Of the elements and roles around a text those that never hold it, and the share of the text of the page, outside links, from
#: which another one holds it.
_NEVER_TEXT, _NEARLY_ALL = frozenset("nav footer menu navigation contentinfo".split()), 0.9
#: Elements within a line: what ends an open paragraph or item ends these as well.
_INLINE = frozenset("b i em strong span a u font small big s code sub sup mark".split())
#: Elements that are pieces of a text, not its container.
_PIECES = frozenset("p span b i em strong a li td tr h1 h2 h3 h4 h5 h6 blockquote ul ol pre".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Elements that may be lists of links; a paragraph or a heading is none.
_LISTS = frozenset("ul ol dl div section table tbody tr td details center article".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "parent", "depth", "box", "own", "dropped", "boiler", "fixed", "named", "chars", "links", "tags", "link_tags", "linked", "density", "plain", "total", "peak")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, boiler: bool = False, fixed: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.children = tag, parent, dropped, []
        self.depth, self.own = parent.depth + 1 if parent is not None else 0, -1
        #: The nearest element from here upwards that is no piece of a text.
        self.box = parent.box if parent is not None and tag in _PIECES else self
        #: What surrounds a text, by its element or role (never holding one, if fixed), or by its names.
        self.boiler, self.fixed, self.named = boiler, fixed, named
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.plain = self.total = 0.0
        self.linked, self.peak = False, self


def _boiler_name(name: str, inside_article: bool) -> bool:
    """Whether a class or id is made of words for what surrounds a text, and of nothing else."""
    words = [w for w in re.split(r"[-_\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    if not inside_article and words and set(words) <= _HEADER | {"site", "page", "top", "main", "inner", "wrapper", "container"} and _HEADER.intersection(words):
        return True
    known = lambda w, some: w in some or (w.endswith("s") and w[:-1] in some)
    return any(known(w, _BOILER) for w in words) and all(known(w, _BOILER) or known(w, _PARTS) for w in words)


def _kind(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is never shown or no text; surrounds a text by its element or role; never holds one; surrounds it by
    its names. Only attributes of these meanings count, whatever words others hold."""
    if tag in _NEVER:
        return True, False, False, False
    around, fixed = tag in _AROUND or (tag == "header" and not inside_article), tag in _NEVER_TEXT
    if tag in ("html", "body", "article", "main") or not attrs:
        return False, around, fixed, False
    has = {}
    for m in _ATTRIBUTE.finditer(attrs):
        has.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(has.get("style", "")):
        return True, False, False, False
    named = False
    for marker in _MARKERS:
        if names := has.get(marker, "").split():
            around |= any(x in _ROLES for x in names)
            fixed |= any(x in _NEVER_TEXT for x in names)
            if not _CORE.intersection(x.lower() for x in names):
                named |= any(_boiler_name(x, inside_article) for x in names)
    return False, around, fixed, named


class _Open:
    """The open elements, from the root down, and of each name the depths at which it is open."""

    def __init__(self, root: Node):
        self.path, self.at = [root], {}
        self.solid = [0]  # depths of those that are not within a line
        self.articles = 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        if node.tag not in _INLINE:
            self.solid.append(len(self.path))
        self.articles += node.tag in ("article", "main")
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.at[node.tag].pop()
            if node.tag not in _INLINE:
                self.solid.pop()
            self.articles -= node.tag in ("article", "main")

    def deepest(self, tags) -> int:
        return max([self.at[t][-1] for t in tags if self.at.get(t)], default=0)

    def end(self, tag: str) -> bool:
        """Closes the nearest open element of a name, if there is one within its scope."""
        depth = self.at[tag][-1] if self.at.get(tag) else 0
        if not depth or (tag in _SCOPES and self.deepest(_SCOPES[tag]) > depth) or (tag not in _THROUGH_CELLS and self.deepest(("td", "th", "table")) > depth):
            return False
        self.cut(depth)
        return True

    def make_room(self, tag: str) -> None:
        """Closes what ends by itself where an element begins."""
        while True:
            depth = self.solid[-1]
            if not depth or tag not in _CLOSES.get(self.path[depth].tag, ()) or (tag == "a" and self.deepest(("a",)) > depth):
                break
            self.cut(depth)
        if tag == "a" and self.path[-1].tag == "a":
            self.cut(len(self.path) - 1)


#: End tags that reach out of a table's cell.
_THROUGH_CELLS = frozenset("td th tr tbody thead tfoot table body html div article section main".split())


def parse(page: str) -> Node:
    """The DOM of a page; its leaves are strings with character references decoded. Never fails, and takes time in proportion
    to the page, whatever is left open in it: an end tag looks its element up by name, and a quote that is never closed is
    a character like others, from there to the end of the page."""
    root = Node("html", None)
    open_, quotes, at = _Open(root), "\"'", 0
    node = root
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            mark = _ENDS[m[0]]
            end = page.find(mark, at)
            if m[0] == "<![CDATA[":
                node.children.append(page[at : end if end >= 0 else len(page)])
            at = end + len(mark) if end >= 0 else len(page)
            continue
        start = at
        while (at := _REST[quotes].match(page, start).end()) < len(page) and page[at] != ">":
            quotes = quotes.replace(page[at], "")  # there is no second one
        attrs, at = page[start:at], min(at + 1, len(page))
        tag = m[2].lower()
        if m[1]:
            if not open_.end(tag) and tag in ("p", "br"):
                node.children.append(Node("br", node))
            node = open_.path[-1]
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.tag == "head":
                open_.end("head")
                node = open_.path[-1]
            continue
        open_.make_room(tag)
        node = open_.path[-1]
        new = Node(tag, node, *_kind(tag, attrs, open_.articles > 0))
        node.children.append(new)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK and tag != "a"):
            open_.push(new)
            node = new
    if at < len(page):
        node.children.append(html.unescape(page[at:]))
    _believe(root)
    return root


def _believe(root: Node) -> None:
    """An element around a text, or a role, that holds nearly all text of the page that is no link, menu or footer, with all
    articles, holds the page's text: the whole page may be one form."""
    nodes = _post_order(root)
    if not any(n.boiler and not n.fixed for n in nodes):
        return
    held, articles = {}, {}
    for n in nodes:
        kids = [c for c in n.children if type(c) is Node and not c.dropped]
        size = _own(n) + sum([held[id(c)] for c in kids])
        held[id(n)] = 0 if n.tag == "a" or n.fixed else size
        articles[id(n)] = sum([articles[id(c)] for c in kids]) + (n.tag in ("article", "main") and size > 0)
    for n in nodes:
        if n.boiler and not n.fixed and held[id(n)] and held[id(n)] >= _NEARLY_ALL * held[id(root)] and articles[id(n)] == articles[id(root)]:
            n.boiler = False


def _own(n: Node) -> int:
    """Characters of a node's own text, white space as one space each."""
    if n.own < 0:
        n.own = sum([len(_SPACE.sub(" ", c).strip()) for c in n.children if type(c) is str])
    return n.own


def _post_order(root: Node) -> list[Node]:
    """Children before parents, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in n.children if type(c) is Node and not c.dropped]
    return out[::-1]


def _composite(chars: int, links: int, tags: int, link_tags: int, whole: float) -> float:
    base = math.log(chars * links / max(1, chars - links) + whole * chars + math.e)
    x = (chars / max(1, links)) * (max(1, tags) / max(1, link_tags))
    return chars / max(1, tags) * math.log(max(x, 1.0) + 1e-9) / max(base, 1e-9)


def measure(root: Node, names: bool = True) -> list[Node]:
    """Densities, density sum and the node of the largest sum in its subtree, of every node that is not dropped."""
    nodes = _post_order(root)
    for n in reversed(nodes):
        n.linked = n.tag == "a" or n.boiler or (names and n.named) or (n.parent is not None and n.parent.linked)
        n.chars = n.links = n.tags = n.link_tags = 0
        n.density = n.plain = n.total = 0.0
        n.peak = n
    for n in nodes:
        n.chars = _own(n)
        for c in n.children:
            if type(c) is Node and not c.dropped:
                n.chars += c.chars
                n.links += c.links
                n.tags += c.tags + 1
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.linked:
            n.links = n.chars
    whole = root.links / root.chars if root.chars else 0.0
    for n in nodes:
        if not n.chars:
            continue
        chars = n.own
        n.density = 0.0 if n.linked else _composite(n.chars, n.links, n.tags, n.link_tags, whole)
        n.plain = (n.chars - n.links) / max(1, n.tags)
        below = [c for c in n.children if type(c) is Node and not c.dropped]
        n.total = sum(c.density for c in below) + (_composite(chars, 0, 1, 0, whole) if chars and not n.linked else 0.0)
        for c in below:
            if _rank(c.peak) > _rank(n.peak):
                n.peak = c.peak
    return nodes


def _rank(n: Node) -> tuple[float, bool]:
    """By density sum; of equal ones an article comes first."""
    return n.total, n.tag in ("article", "main")


def _container(n: Node, top: Node) -> Node:
    """What a text's piece is in, up to ``top``."""
    return n.box if n.box.depth >= top.depth else top


def _chosen(root: Node, low: float, plain: float) -> tuple[set[int], set[int]]:
    """The maximum-sum subtrees of the nodes that reach the threshold, with the headings of the first one; and the nodes around them."""
    n = best = _container(root.peak, root)
    chosen, around, stack = {id(best)}, set(), [root]
    while n.parent is not None and n.tag not in ("article", "main"):  # headings before it, up to its article
        for c in n.parent.children:
            if c is n:
                break
            if type(c) is Node and c.tag in _HEADINGS and not 2 * c.links > c.chars:
                chosen.add(id(c))
        n = n.parent
    while stack:
        n = stack.pop()
        if id(n) not in chosen and n.chars and (n.density >= low or n.plain >= plain):
            chosen.add(id(_container(n.peak, n)))
            if id(n) not in chosen:
                around.add(id(n))
                stack += [c for c in n.children if type(c) is Node and not c.dropped]
    return chosen, around


def _runs(n: Node, least: float) -> set[int]:
    """Places of the children of a node that are its own text: runs of strings and inline elements of so many characters."""
    out, run, size = set(), [], 0
    for i, c in enumerate([*n.children, None]):
        if c is None or (type(c) is Node and c.tag in _BLOCK):
            if size >= least:
                out.update(run)
            run, size = [], 0
        elif type(c) is str or not c.dropped:
            run.append(i)
            size += len(_SPACE.sub(" ", c).strip()) if type(c) is str else c.chars - c.links
    return out


def _text(root: Node, chosen: set[int], around: set[int] = frozenset(), low: float = 0.0, plain: float = 0.0) -> str:
    """Blocks of the chosen subtrees in page order, white space in each turned into one space, joined by one space.

    Of the nodes around them only runs of their own text that reach the threshold stay; in them, all but lists of links and
    what is marked as no text of the page, if they fall below it.
    """
    parts: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        n, inside = stack.pop()
        if type(n) is str:
            parts.append(n if inside else " ")
        elif not n.dropped:
            kind = n.boiler or n.named or (n.tag in _LISTS and n.link_tags > 1)
            links = inside and kind and 2 * n.links > n.chars and n.density < low and n.plain < plain
            inside = inside or id(n) in chosen
            if links or not (inside or id(n) in around):
                parts.append("\n")
                continue
            edge = n.tag in _BLOCK
            if edge:
                parts.append("\n")
                stack.append(("\n", True))
            own = () if inside else _runs(n, plain)
            stack += [(c, inside or i in own) for i, c in reversed(list(enumerate(n.children)))]
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none, or links alone. A null page counts as empty. Of nodes with equal
    density sums an article comes first, then the first one that is met from the leaves up."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    if root.links == root.chars:  # no text but such: then names may mean something else
        measure(root, names=False)
    if root.links == root.chars:
        return ""
    best = root.peak
    # the least density on the path up to the body is the threshold
    path = [best, *_above(best)]
    low, plain = min(n.density for n in path), min(n.plain for n in path)
    return _text(root, *_chosen(root, low, plain), low, plain)


def _above(n: Node) -> Iterator[Node]:
    n = n.parent
    while n is not None:
        yield n
        n = n.parent


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages`` from its whole HTML.

    What is marked as hidden (the attribute, ``aria-hidden=true``, ``display:none``) is no text. Broken markup never fails: tags
    that are left open, ends without a beginning, open quotes, comments and scripts, and elements nested without bound take
    time in proportion to the page. Null HTML gives an empty text, null ids and urls stay null; repeated rows give repeated rows. A very long page is parsed
    whole. Other columns take no part; an empty table gives an empty one.
    """
    rows = project(pages, page_id="long", url="string", html="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # pages may be long
                part = b.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
