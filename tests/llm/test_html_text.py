"""HTML extraction against a plain recursive density measure, and on pages of many shapes."""

import html
import math
import random
import re

import pytest

from grovekit.llm import html_text


def squeeze(t):
    return re.sub(r"\s+", " ", t)


class Plain:
    """The same measure written as one recursion over the parsed tree."""

    def __init__(self, node, parent=None, names=True):
        self.node, self.parent, self.tag = node, parent, node.tag
        self.marked = node.boiler or node.named
        self.linked = node.tag == "a" or node.boiler or (names and node.named) or bool(parent and parent.linked)
        self.parts = [c if isinstance(c, str) else Plain(c, self, names) for c in node.children if isinstance(c, str) or not c.dropped]
        self.kids = [c for c in self.parts if not isinstance(c, str)]
        self.own = sum(len(squeeze(c).strip()) for c in self.parts if isinstance(c, str))
        self.chars = self.own + sum(c.chars for c in self.kids)
        self.links = self.chars if self.linked else sum(c.links for c in self.kids)
        self.tags = len(self.all()) - 1
        self.link_tags = sum(n.tag == "a" for n in self.all()[1:])

    def all(self):
        return [self, *[n for c in self.kids for n in c.all()]]

    def weigh(self, whole):
        def density(chars, links, tags, link_tags):
            x = (chars / max(1, links)) * (max(1, tags) / max(1, link_tags))
            return chars / max(1, tags) * math.log(max(x, 1.0) + 1e-9) / max(math.log(chars * links / max(1, chars - links) + whole * chars + math.e), 1e-9)

        for c in self.kids:
            c.weigh(whole)
        self.density = density(self.chars, self.links, self.tags, self.link_tags) if self.chars and not self.linked else 0.0
        self.plain = (self.chars - self.links) / max(1, self.tags)
        self.total = (sum(c.density for c in self.kids) + (density(self.own, 0, 1, 0) if self.own and not self.linked else 0.0)) if self.chars else 0.0

    def best(self):
        """The node of the largest density sum; of equal ones an article, then the one nearest to the root, the first."""
        found = self
        for c in self.kids if self.chars else []:
            b = c.best()
            if (b.total, b.tag in ("article", "main")) > (found.total, found.tag in ("article", "main")):
                found = b
        return found


def plain_text(page):
    root = Plain(html_text.parse(page))
    if root.links == root.chars:
        root = Plain(html_text.parse(page), names=False)
    if root.links == root.chars:
        return ""
    root.weigh(root.links / root.chars)
    best, path = root.best(), []
    n = best
    while n:
        path.append(n)
        n = n.parent
    low, plain = min(n.density for n in path), min(n.plain for n in path)

    def container(n, top):
        return n if n is top or n.tag not in html_text._PIECES else container(n.parent, top)

    chosen, around = [container(best, root)], []
    n = chosen[0]
    while n.parent and n.tag not in ("article", "main"):
        siblings = n.parent.kids
        chosen += [c for c in siblings[: siblings.index(n)] if c.tag in html_text._HEADINGS and not 2 * c.links > c.chars]
        n = n.parent

    def select(n):
        if n in chosen or not n.chars or not (n.density >= low or n.plain >= plain):
            return
        chosen.append(container(n.best(), n))
        if n not in chosen:
            around.append(n)
            for c in n.kids[::-1]:
                select(c)

    select(root)

    def own_runs(n):
        out, run = set(), []
        for i, c in enumerate([*n.parts, None]):
            if c is None or (not isinstance(c, str) and c.tag in html_text._BLOCK):
                if sum(len(squeeze(x).strip()) if isinstance(x, str) else x.chars - x.links for _, x in run) >= plain:
                    out |= {j for j, _ in run}
                run = []
            else:
                run.append((i, c))
        return out

    def text(n, inside):
        if isinstance(n, str):
            return n if inside else " "
        weak = 2 * n.links > n.chars and n.density < low and n.plain < plain
        drop = inside and weak and (n.marked or (n.tag in html_text._LISTS and n.link_tags > 1))
        inside = inside or n in chosen
        if drop or not (inside or n in around):
            return "\n"
        runs = set() if inside else own_runs(n)
        body = "".join(text(c, inside or i in runs) for i, c in enumerate(n.parts))
        return f"\n{body}\n" if n.tag in html_text._BLOCK else body

    return squeeze(text(root, False)).strip()


def random_page(r, depth=0):
    word = lambda k: " ".join(r.choice(["alpha", "be", "gamma &amp; d", "e", "zeta-eta"]) for _ in range(k))
    out = []
    for _ in range(r.randint(1, 5)):
        kind = r.random()
        tag = r.choice(["div", "section", "article", "main", "ul", "li", "p", "h2", "span", "b", "nav", "aside", "footer", "table", "blockquote", "header"])
        names = r.choice(["", "", "", " class=ad", " class='comments'", " id=story", " class='search-tips'", " role=navigation", " class='share-buttons box'"])
        if kind < 0.35 or depth > 4:
            out.append(word(r.choice([1, 3, 12, 60])))
        elif kind < 0.5:
            out.append(f"<a href=x>{word(r.randint(1, 4))}</a>")
        else:
            out.append(f"<{tag}{names}>{random_page(r, depth + 1)}</{tag}>")
    return " ".join(out)


@pytest.mark.parametrize("seed", range(300))
def test_against_the_plain_measure(seed):
    page = f"<html><body>{random_page(random.Random(seed))}</body></html>"
    assert html_text.main_text(page) == plain_text(page)


def test_pages():
    page = """<html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text,<br>with a <a href="#">link</a>.<p>Second   paragraph &lt;here&gt;.
    <div class="comments"><p>Great post!</p></div></article><aside>side</aside><form>search</form><footer>foot</footer></body>"""
    assert html_text.main_text(page) == "Title & more First bold text, with a link. Second paragraph <here>."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("<p>a<p>b") == "a b"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep" and html_text.main_text("<nav>menu <a href=x>x</a></nav>") == ""


def test_names_do_not_delete_prose():
    """Names of which only a word is a menu's or a comment's, labels, and names around the whole text."""
    tips = "Some tips on how to search the shelves, long enough to be read."
    body = f'<article><h1>T</h1><div class="search-tips"><p>{tips}</p></div><p class="social-history">{tips}</p><div id="tags-explained">{tips}</div></article>'
    assert html_text.main_text(body) == " ".join(["T", tips, tips, tips])
    assert html_text.main_text("<article><p>Press the <label>big</label> button, then wait for a while.</p></article>") == "Press the big button, then wait for a while."
    assert html_text.main_text(f"<div class=menu><p>{tips}</p><p>{tips}</p></div>") == f"{tips} {tips}"
    for name in ("comments", "post-comments", "readerComments", "ad", "google-ads", "cookie-banner", "newsletter-signup", "related-posts", "shareButtons"):
        assert html_text.main_text(f"<article><p>{tips * 3}</p><div class='{name}'><p>{tips * 9}</p></div></article>") == tips * 3, name


def test_by_density():
    """Elements named article decide nothing; blocks that reach the threshold stay, those below it and lists of links go."""
    p = lambda c, n: f"<p>{c * n}</p>"
    story = p("a", 500) + p("b", 500) + p("c", 300)
    want = " ".join(["a" * 500, "b" * 500, "c" * 300])
    teasers = "".join(f"<article><h2><a href=x>teaser {i}</a></h2><p>Few words. <a href=x>Read more</a></p></article>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(f"<body><div id=story>{story}</div>{teasers}</body>") == want
    assert html_text.main_text(f"<body><main><div id=story>{story}</div>{teasers}</main></body>") == want
    assert html_text.main_text(f"<body><div>{story}</div><div>{links}</div><div>{p('d', 400)}</div></body>") == want + " " + "d" * 400
    assert html_text.main_text(f"<body><div>{p('a', 500)}{links}{p('b', 500)}{p('c', 300)}</div></body>") == want
    assert html_text.main_text(f"<body><article><h1>Title</h1><div>{story}</div></article></body>") == "Title " + want
    assert html_text.main_text(f"<body>{'d' * 400} <b>e</b> f<div>{story}</div>g</body>") == "d" * 400 + " e f " + want
    assert html_text.main_text(f"<body><a href=x><div>{p('l', 200) * 2}</div></a><div>{p('a', 150)}{p('b', 150)}</div></body>") == "a" * 150 + " " + "b" * 150
    six = "".join(p(c, 400) for c in "abcdef")
    assert " ".join(c * 400 for c in "abcdef") in html_text.main_text(f"<body><article><p>tiny</p></article><div>{six}</div></body>")
    # ties: two blocks alike
    assert html_text.main_text(f"<body><div>{p('a', 300)}</div><div>{p('a', 300)}</div></body>") == "a" * 300 + " " + "a" * 300


def test_of_the_pages(spark):
    """The generated pages; without densities the results would be others."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for p in pages.collect():
        a = re.sub(r"</?(p|h1|br)>", "\n", p["html"][p["html"].index("<article>") + 9 : p["html"].index("</article>")])
        want[p["page_id"]] = re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", a))).strip()
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == want
    measure, differ = html_text.measure, 0

    def flat(root, names=True):
        for n in measure(root, names):
            n.density, n.plain, n.total, n.peak = 1.0, 1.0, 0.0, n

    for p in pages.collect():
        html_text.measure = flat
        try:
            differ += html_text.main_text(p["html"]) != want[p["page_id"]]
        finally:
            html_text.measure = measure
    assert differ == len(want)


def test_odd_tables(spark):
    """Null ids, urls and pages, repeated rows, clashing columns, a very long page, an empty table."""
    long = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    rows = [(1, "u", "<p>one two</p>", "x", 5), (1, "u", "<p>one two</p>", "x", 5), (None, None, None, None, None), (2, None, "", "y", 6), (3, "v", long, "z", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=repr)
    text = " ".join(["word word word"] * 50_000)
    assert got == sorted([(1, "u", "one two", 7)] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", text, len(text))], key=repr)
    assert html_text.extract(df.filter("false")).count() == 0


TALE = "The river rose in the night, and by the morning the lower fields were gone under brown water. " * 3
BROKEN = [
    ('<div class="story" data-title="The hidden cost of gold"><p>{0}</p></div>', "{0}"),
    ('<section aria-label="The hidden story"><p>{0}</p></section>', "{0}"),
    ('<article><p title="a hidden gem">{0}</p><p hidden>no</p><p aria-hidden="true">no</p><p style="color:red; DISPLAY : none">no</p><p aria-hidden=false>{0}</p></article>', "{0} {0}"),
    ('<body><form id=aspnetForm><div><p>{0}</p><p>{0}</p></div></form></body>', "{0} {0}"),
    ('<body><form id="aspnetForm"><nav><a href=x>menu</a></nav><div><p>{0}</p></div></form><footer>Copyright 2020 by the authors of this page, all rights reserved</footer></body>', "{0}"),
    ('<body><aside><p>{0}</p></aside><footer>Copyright 2020</footer></body>', "{0}"),
    ('<body><div role="form"><p>{0}</p></div><nav>menu</nav></body>', "{0}"),
    ('<body><article><p>Short.</p></article><aside><p>{0}{0}{0}</p></aside></body>', "Short."),
    ('<body><article><p>{0}<p>{0}</article><form><label>Search</label> the archive</form>', "{0} {0}"),
    ('<div><p>{0}</div></span></i><p>{0}</b></p></div></div>', "{0} {0}"),
    ('<ul><li>{0}<li>{0}</ul></li></li><p>{0}', "{0} {0} {0}"),
    ('<table><tr><td>{0}<td>{0}</p></table><p>{0}</p>', "{0} {0} {0}"),
    ('<article><p class="a>{0}</p><p>{0}</p></article>', "{0} {0}"),  # the quote is never closed: a character like others
    ('<article><p title="a > b" class=\'x>y\'>{0}</p><p data-x="<b>">{0}</p></article>', "{0} {0}"),
    ('<article><p>{0}</p><!-- open <p>no</p>', "{0}"),
    ('<article><p>{0}</p><script>if (a < b) { "</p>" } ', "{0}"),
    ('<article><p>{0} 1 < 2 and 3 <4 &amp;lt; </p></article>', "{0} 1 < 2 and 3 <4 &lt;"),
    ('<b><i><p>{0}<p>{0}</b></i>', "{0} {0}"),
    ('<p>{0}<![CDATA[ <p> ]]></p>', "{0} <p>"),
    ('<div><a href=x>one<a href=y>two</a></a></div><div><p>{0}</p></div>', "{0}"),
    ('<li>{0}<ul><div><div></li></li><li>{0}</ul>', "{0} {0}"),
]


@pytest.mark.parametrize("page,want", BROKEN)
def test_broken_and_odd_markup(page, want):
    tale = TALE.strip()
    assert html_text.main_text(page.replace("{0}", tale)) == want.replace("{0}", tale)


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "</span>" * n, lambda n: "<li><ul>" + "<div>" * n + "</li>" * n, lambda n: "<b>" * n + "<br>" * n, lambda n: '<a x="1 ' * n + '"' * (n % 2), lambda n: "<a x='1 " * (n | 1),
    lambda n: '<a x="1>' * (n | 1), lambda n: "<div>" * n + "<span>" * n + "word " * 50, lambda n: "<p" * n, lambda n: "<!-" * n, lambda n: "<td><div>" * n + "</p>" * n, lambda n: "<a>" * n,
])
def test_time_grows_with_the_page(make):
    """A megabyte of what is left open, nested or unmatched takes no more than its share of what a quarter of it takes."""
    import time

    size = len(make(1001)) / 1001
    began = time.process_time()
    html_text.main_text(make(int(250_000 / size)))
    one = time.process_time() - began
    began = time.process_time()
    html_text.main_text(make(int(1_000_000 / size)))
    assert time.process_time() - began < max(8, 9 * one)
