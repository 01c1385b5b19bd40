"""Main text of web pages by composite text density.

For a node with C signs of text, LC of them in links, T tags below it and LT link tags,

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

so that text with few tags scores high and text in links is punished. A node's sum is that of its children's densities. The
node with the largest sum is the centre of the text; the least density on its path up to the body is the threshold,
and of the nodes that reach it the one with the largest sum, or its ancestor that holds the whole article, is
the main text; without article or main, together with its siblings that reach the threshold. Menus, footers, asides,
scripts and styles are left out by tag or role. The words of a class or id (header, sidebar, notice, advert, reader
comment) and the tags header and form are evidence only: see unwanted().

Blocks are joined in page order by one space, white space inside a block becomes one space.

Defined results: null and empty pages give the empty text; empty tables give empty results; broken and unclosed markup is read as
browsers do in the main (a paragraph ends where the next block begins); repeated rows each get a row; whole pages are read;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, narrowed

#: A tag without `<` or `>` inside quotes: it fails no later than the next of them, so a page is scanned in linear time.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^<>"']*(?:(?:"[^"<>]*"|'[^'<>]*')[^<>"']*)*)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARKS = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag in the second set ends an open element of the first, within the nearest barrier.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "optgroup", "legend"}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROP = frozenset("nav footer aside script style noscript template head title iframe object embed svg canvas button select textarea input menu dialog noembed noframes xmp audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners sidebar sidebars sidebox aside nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies widget widgets pagination pager toolbar skip disclaimer paywall toc".split()
)
#: Words of reader comments: evidence at any size.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: A class with one of these says what a page has or how it looks (has-sidebar, share-enabled), not what a node is.
STATE = frozenset("has have with without no not is enabled disabled on off open opened closed show shown hide".split())
#: Classes of content, where no other word of the same class is in WORDS.
CONTENT = frozenset("content article post entry story main body text".split())
#: Words that mark more than this share of a page's text are no evidence there.
MARKED = 0.25
#: What may stand in a head without ending it.
METADATA = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "words", "c", "t", "lc", "lt", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, drop: bool, words: frozenset[str] = frozenset()):
        self.tag, self.parent, self.drop, self.words = tag, parent, drop, words
        self.items: list[Node | str] = []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0


def judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, frozenset[str]]:
    """Whether tag, role or style drop a node, and the words that are evidence against it."""
    if tag in DROP:
        return True, frozenset()
    words = {tag} if tag == "form" or tag == "header" and not inside_article else set()
    if tag in ("html", "body") or not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, frozenset(words)
    content = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True, frozenset()
        if name == "role" and value.lower() == "form":
            words.add("form")
        if name in ("class", "id") and tag not in ("article", "main") and tag not in HEADINGS:
            for one in value.split():
                parts = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()))
                if STATE.isdisjoint(parts):
                    words |= parts & WORDS
                    content |= WORDS.isdisjoint(parts) and not CONTENT.isdisjoint(parts)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, frozenset()
    return False, frozenset(words | {""} if content and words else words)


class TagEnds:
    """Where a tag ends: at the first `>` outside quotes. Found for all places of a page in one pass from its end."""

    def __init__(self, page: str):
        self.at = [m.start() for m in MARKS.finditer(page)]
        n = len(self.at)
        self.end = [-1] * (n + 1)
        following = {'"': n, "'": n}
        for i in range(n - 1, -1, -1):
            c = page[self.at[i]]
            if c == ">":
                self.end[i] = self.at[i]
            else:
                self.end[i] = self.end[min(following[c] + 1, n)]
                following[c] = i

    def after(self, i: int) -> int:
        return self.end[bisect_left(self.at, i)]


class Open:
    """The open elements, with the depths of those of each tag, so that no start or end tag walks the whole path."""

    def __init__(self, root: Node):
        self.path, self.where, self.blocks, self.plain = [], defaultdict(list), [-1], []
        self.push(root)

    def push(self, x: Node) -> None:
        d = len(self.path)
        self.path.append(x)
        self.where[x.tag].append(d)
        if x.tag in BLOCK:
            self.blocks.append(d)
        if x.tag not in INLINE and x.tag != "p":
            self.plain.append(d)

    def keep(self, depth: int) -> None:
        """Closes all but the first `depth` elements."""
        while len(self.path) > depth:
            x = self.path.pop()
            self.where[x.tag].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()
            if self.plain[-1] == len(self.path):
                self.plain.pop()

    def last(self, *tags: str) -> int:
        """The depth of the innermost open element of these tags, or -1."""
        return max(w[-1] if (w := self.where[t]) else -1 for t in tags)


def tree(page: str) -> Node:
    root = Node("#root", None, False)
    now = Open(root)
    at = scan = 0
    ends: TagEnds | None = None

    def text(end: int) -> None:
        if end > at:
            t = page[at:end]
            if now.path[-1].tag == "head" and not t.isspace():
                now.keep(len(now.path) - 1)
            now.path[-1].items.append(unescape(t))

    while True:
        i = page.find("<", scan)
        if i < 0:
            break
        if page.startswith(("<!", "<?"), i):
            text(i)
            mark = "-->" if page.startswith("<!--", i) else ">"
            end = page.find(mark, i + 4 if mark == "-->" else i)
            at = scan = end + len(mark) if end >= 0 else len(page)
            continue
        if m := TAG.match(page, i):
            closing, tag, attributes, end = m[1], m[2].lower(), m[3], m.end()
        elif m := NAME.match(page, i):
            ends = ends or TagEnds(page)
            end = ends.after(m.end()) + 1
            closing, tag, attributes = m[1], m[2].lower(), page[m.end() : end - 1] if end else ""
        else:
            end = 0
        if not end:  # no tag: the sign is text
            scan = i + 1
            continue
        text(i)
        at = scan = end
        if closing:
            d = now.last(tag)
            if tag in INLINE and now.last("article", "td", "table") > d:
                d = -1
            if d > 0:
                if tag not in INLINE or now.blocks[-1] <= d:
                    now.keep(d)
            elif tag == "br":
                now.path[-1].items.append(Node("br", now.path[-1], False))
            continue
        if tag == "body":
            body, head = now.last("body"), now.last("head")
            if body > head:
                continue
            if head >= 0:
                now.keep(head)
        elif now.path[-1].tag == "head" and tag not in METADATA:
            now.keep(len(now.path) - 1)
        if tag in CLOSES_P and (d := now.last("p")) > now.plain[-1]:
            now.keep(d)
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            wall = now.last(*barrier)
            if open_ := [w[k] for e in ended if (k := bisect_right(w := now.where[e], wall)) < len(w)]:
                now.keep(min(open_))
        node = now.path[-1]
        drop, words = judged(tag, attributes, tag == "header" and now.last("article", "main") >= 0)
        new = Node(tag, node, node.drop or drop, words)
        node.items.append(new)
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", m.end()) if m else -1
            at = scan = end + 1 if end >= 0 else len(page)
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCK - {"br", "hr"}:
            now.push(new)
    text(len(page))
    return root


def measure(root: Node) -> list[Node]:
    """Counts and densities; the nodes in page order. Without recursion: a page may nest without end."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        x.c = x.t = x.lc = x.lt = 0
        x.density = x.sum = 0.0
        stack.extend(reversed([i for i in x.items if isinstance(i, Node) and not i.drop]))
    for x in reversed(order):
        for i in x.items:
            if isinstance(i, str):
                x.c += len("".join(i.split()))
        if x.tag == "a":
            x.lc, x.lt = x.c, x.lt + 1
        if (p := x.parent) is not None:
            p.c, p.t, p.lc, p.lt = p.c + x.c, p.t + x.t + 1, p.lc + x.lc, p.lt + x.lt
    body = next((x for x in order if x.tag == "body"), root)
    share = body.lc / max(1, body.c)
    for x in order:
        t, lc, lt, plain = max(1, x.t), max(1, x.lc), max(1, x.lt), max(1, x.c - x.lc)
        if x.c:
            base = math.log(x.c / plain * x.lc + share * x.c + math.e)
            x.density = x.c / t * max(0.0, math.log(max(x.c / lc * t / lt, 1.0)) / math.log(base) if base > 1.000001 else math.log(max(x.c / lc * t / lt, 1.0)))
    for x in reversed(order):
        if x.parent is not None:
            x.parent.sum += x.density
    return order


def holders(order: list[Node], *tags: str) -> set[Node]:
    """The nodes of these tags and all that hold one."""
    out: set[Node] = set()
    for x in order:
        if x.tag in tags:
            while x is not None and x not in out:
                out.add(x)
                x = x.parent
    return out


def unwanted(order: list[Node]) -> list[Node]:
    """Nodes to leave out by their words. Never one that holds an article, main, most of the text or all first headings. Of
    others, those mostly of links, and those with a word whose nodes together hold at most MARKED of the text, unless
    a class of content speaks for them; comments at any size. Beside an article that has text, all but those with more
    than four times that text."""
    marked = [x for x in order if x.words]
    if not marked:
        return []
    body = next((x for x in order if x.tag == "body"), order[0])
    total, kept = max(1, body.c), holders(order, "article", "main")
    first = dict.fromkeys(order, 0)
    inside, above = {None: False}, {None: frozenset()}
    whole = 0
    for x in order:  # what holds a node comes before it
        outer = inside[x.parent]
        inside[x] = outer or x.tag in ("article", "main")
        whole += x.c if inside[x] and not outer else 0  # the outermost articles
        above[x] = above[x.parent] | x.parent.words if x.parent is not None and not x.parent.words <= above[x.parent] else above[x.parent]
    for x in reversed(order):
        first[x] += x.tag == "h1"
        if x.parent is not None:
            first[x.parent] += first[x]
    of_page, within = first[order[0]], defaultdict(int)
    for x in marked:
        for w in x.words - above[x]:
            within[w] += x.c
    out = []
    for x in marked:
        links = 2 * x.lc > x.c
        comments = not COMMENTS.isdisjoint(x.words)
        beside = whole and not inside[x] and (comments or x.c <= 4 * whole)
        if x in kept or 2 * x.c > total and not beside or of_page and first[x] == of_page and not links:
            continue
        few = "" not in x.words and any(within[w] <= MARKED * total for w in x.words)
        if links or few or beside or comments and "" not in x.words:
            out.append(x)
    return out


def main_nodes(root: Node) -> list[Node]:
    """The parts of the main text in page order."""
    order = measure(root)
    if out := unwanted(order):
        for x in out:
            x.drop = True
        order = measure(root)
    best = max(order, key=lambda x: x.sum, default=None)
    if best is None or not root.c:
        return []
    threshold, x = best.density, best
    while x is not None and x.tag not in ("body", "html", "#root"):
        threshold = min(threshold, x.density)
        x = x.parent
    body = next((y for y in order if y.tag == "body"), root)
    reach = [y for y in order if y.density >= threshold and y.sum and y is not body and y.tag not in ("html", "#root")]
    best = max([*reach, best], key=lambda y: y.sum)
    x, whole = best, None
    while x is not None:
        if x.tag in ("article", "main"):
            whole = x
        x = x.parent
    if whole is not None:
        return [whole]
    # headings and sparse paragraphs beside the densest part belong to it: up to the last ancestor that isn't the body
    while best.parent is not None and best.parent.tag not in ("body", "html", "#root") and best.parent.lc <= 0.5 * best.parent.c:
        best = best.parent
    # paragraphs right in the body
    if best.parent is body and best.tag in BLOCK and best.tag not in ("div", "section", "table", "td"):
        return [body]
    if best.parent is None:
        return [best]
    threshold = min(threshold, body.density)
    titles = holders(order, "h1")
    beside = lambda y: y.c and 2 * y.lc <= y.c and (y.density >= threshold or y.tag in HEADINGS or y in titles)
    return [y for y in best.parent.items if isinstance(y, Node) and not y.drop and (y is best or beside(y))]


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if words := " ".join("".join(now).split()):
            out.append(words)
        now.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        x, i = stack.pop()
        if i == 0 and x.tag in BLOCK:
            flush()
        while i < len(x.items):
            y = x.items[i]
            i += 1
            if isinstance(y, str):
                now.append(y)
            elif not y.drop:
                stack.append((x, i))
                stack.append((y, 0))
                break
        else:
            if x.tag in BLOCK:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(x for node in main_nodes(tree(page)) for x in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        return batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return arrow_map(narrowed(pages, page_id=id_col, url=url_col, html=html_col), run, "page_id long, url string, text string, n_chars long")
