"""Main text of web pages by wrapper induction (operator 4).

Pages of a host that use the same containers share a layout, and with it a wrapper. One page of each
layout, the one with the smallest hash, is its pivot; a layout of fewer than LEAST pages is read with
its host's commonest one. Every page's tree of block elements is aligned with the pivot's by simple
tree matching, which maps nodes to slots. Over all pages of the layout, a slot whose text is the same
on nearly all of them is template, and slots that vary are content. The region of the article is the
smallest container that holds most of the varying prose; it is found on the pivot, for the whole
layout, from slots alone, and a page's article is what it has there, and its varying title before it.

Elements, roles and names of classes break ties: they tell what stands inside the region and varies
but is no article (menus, adverts, forms, reader comments), and where the article is on a page that
shows nothing in its wrapper's region.

Counting goes over every page: each task adds up (layout, slot, text hash) before the shuffle, so a
host with a third of all pages is no heavier than its share. Pivots and slots are a page and a list a
layout; they are broadcast only if small and joined otherwise, where adaptive execution splits a
skewed host.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones left out, the others joined in page order by a line feed. A line break element
is white space.

Defined results: null and empty html give an empty text; a null or relative url belongs to the host
''; a page all of whose region is template (copies of one page) keeps it; repeated rows give repeated
results, and each counts, but a text is template only if pages that differ show it; an empty table
gives no rows; extra columns are ignored. Elements may be nested to any depth. Matching two lists of
n and m children that differ takes n * m steps and n * m / 4 bytes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerstone.llm.common import batches, materialize, small, small_batches

#: A slot is template if at least CONSTANT of its pages show the same text in it, LEAST of them at least.
CONSTANT, LEAST = 0.9, 3
#: The region is a container with so much of the varying prose; its parent, if that has more than DIRECT of it in paragraphs of its own.
REGION, DIRECT = 0.75, 0.02
#: Shapes and scores that a task remembers, and pivots; bytes of pivots that are broadcast.
MEMO, PIVOTS, BROADCAST_BYTES = 200_000, 2000, 16 << 20

# Elements, and words of class and id, by what they are for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set("html body article section main nav header footer aside div p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset details summary center hgroup menu dialog search".split())
NOT_TEXT = set("head nav footer aside form button select option object audio video template dialog menu datalist".split()) | RAW
CONTAINERS = set("# html body main article section div center td".split())
PROSE = set("p ul ol dl pre blockquote table figure".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
NOT_ARTICLE = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion promoted sidebar menu nav navbar navigation navi breadcrumb breadcrumbs "
    "masthead footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup login pagination pager toolbar".split()
)
#: Words that name a container of that kind, but on a paragraph may as well be the article's.
DOUBTFUL = set("notice notices alert popup modal overlay lightbox widget share sharing social related recommended recommendations trending skip search copyright disclaimer".split())
#: How compound words begin that mean the same; "commentary" is an article's.
STEMS = ("advert", "adsense", "sponsor", "sidebar", "navbar", "navlink", "navlist", "navmenu", "navigation", "menubar", "breadcrumb", "footer", "commentlist", "commentform", "commentsection", "disqus", "cookie", "newsletter", "subscri", "pagination")
DOUBTFUL_STEMS = ("popup", "related", "recommend", "socialshar", "sharebar", "sharebutton")
HEADER_WORDS = {"header", "topbar"}
#: Start tags before which an open element of these names ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "body", "html", "article", "section", "main", "div", "td", "th"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element, or any element that is not text: its items are strings and nodes in page order."""

    __slots__ = ("children", "headings_only", "inline", "items", "junk", "label", "linked", "shape", "slot", "tag")

    def __init__(self, tag: str, label: str, junk: bool = False, inline: bool = False, headings_only: bool = False):
        self.tag, self.label, self.junk, self.inline, self.headings_only = tag, label, junk, inline, headings_only
        self.items: list[str | Node] = []
        self.children: list[Node] = []
        self.linked, self.shape, self.slot = 0, 0, -1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def _kind(tag: str, attrs: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no article text, and whether only headings in it are."""
    if tag in ("html", "body", "article", "main") and "comment" not in attrs.get("class", "").lower():
        return False, False
    words = {w.lower() for w in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")} if attrs else set()
    if tag in NOT_TEXT or attrs.get("role", "").lower() in ROLES or words & NOT_ARTICLE or any(w.startswith(STEMS) for w in words):
        return True, False
    if tag not in HEADINGS and tag not in PROSE - {"ul", "ol", "dl"} and (words & DOUBTFUL or any(w.startswith(DOUBTFUL_STEMS) for w in words)):
        return True, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True, False
    if tag == "header" or words & HEADER_WORDS:
        return not in_article, in_article
    return False, False


def parse(page: str) -> Node:
    """The tree of a page. Never fails: what is not closed ends where it must, what was never open is passed over."""
    root = Node("#", "#")
    stack: list[tuple[str, Node | None, Node]] = [("#", root, root)]  # tag, its node if it has one, the node that takes text
    opened: Counter[str] = Counter()
    now, articles, links, at, n = root, 0, 0, 0, len(page)

    def pop_to(i: int) -> None:
        nonlocal now, articles, links
        for tag, _, _ in stack[i:]:
            opened[tag] -= 1
            articles -= tag in ("article", "main")
            links -= tag == "a"
        del stack[i:]
        now = stack[-1][2]

    def text(raw: str) -> None:
        if raw:
            got = html.unescape(raw) if "&" in raw else raw
            now.items.append(got)
            if links:
                now.linked += len(got)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][1] is not None and tag not in BLOCKS and not stack[i][1].inline and tag not in NOT_TEXT:
                    break
            continue
        tag = (m["start"] or m["odd"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                now.items.append(m[0][9:-3])
            continue
        raw = m["attrs"] if m["start"] else m["rest"]
        if tag in VOID:
            if tag == "br":
                now.items.append(" ")
            elif tag == "hr":
                now.items.append(Node("hr", "hr"))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in BLOCKS and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][1] is not None and not stack[i][1].inline:
                    break
        if tag in ENDS and any(opened[e] for e in ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[tag]:
                    pop_to(i)
                    if tag != "tr":
                        break
                elif stack[i][0] in SCOPES and not (tag == "tr" and stack[i][0] == "td"):
                    break
        attrs = _attributes(raw)
        junk, headings = _kind(tag, attrs, articles > 0)
        node = None
        if tag in BLOCKS or junk:
            mark = attrs.get("class", "").split()
            node = Node(tag, f"{tag}.{mark[0].rstrip('0123456789')}" if mark else tag, junk, tag not in BLOCKS, headings)
            if attrs.get("role", "").lower() == "main":
                node.tag = "main"
            now.items.append(node)
            now.children.append(node)
        if raw.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, node, node or now))
        opened[tag] += 1
        articles += tag in ("article", "main")
        links += tag == "a"
        if node is not None:
            now = node
    forms = [node for node in _nodes(root) if node.tag == "form"]
    if forms:  # a form around most of a page is not one to fill in
        everything = _length(root, True)
        for node in forms:
            node.junk = node.junk and _length(node, True) * 2 <= everything
    return root


def runs(node: Node) -> list[str]:
    """The node's own blocks of text, white space made one space: what stands between its block children."""
    found, open_run = [], []
    for item in node.items:
        if isinstance(item, str):
            open_run.append(item)
        elif not item.inline:
            found.append(open_run)
            open_run = []
    found.append(open_run)
    return [t for r in found if (t := " ".join("".join(r).split()))]


class Shapes:
    """Numbers equal subtrees and remembers how well two shapes match; both depend on labels only."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.trees: dict[int, tuple] = {}
        self.sizes: dict[int, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def number(self, node: Node) -> int:
        for each in reversed(list(_nodes(node))):  # children before parents
            key = (each.label, *[c.shape for c in each.children])
            if key not in self.numbers:
                self.numbers[key] = n = len(self.numbers) + 1
                self.trees[n], self.sizes[n] = key, 1 + sum(self.sizes[c] for c in key[1:])
            each.shape = self.numbers[key]
        return node.shape

    def known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        return 0 if self.trees[a][0] != self.trees[b][0] else self.scores.get((a, b))

    def score(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that can be matched with order and parents kept."""
        got, todo = self.known(a, b), [(a, b)]
        while got is None and todo:
            x, y = (self.trees[t][1:] for t in todo[-1])
            low, n, m = self.unlike(x, y)
            if first := [(i, j) for i in set(x[low : low + n]) for j in set(y[low : low + m]) if self.known(i, j) is None]:
                todo += first
            else:
                self.scores[todo.pop()] = 1 + sum(self.known(x[i], y[j]) for i, j in self.pairs(x, y))
        return self.known(a, b) if got is None else got

    def unlike(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int, int]:
        """Where two lists of children begin to differ, and how many of each do. Equal subtrees at either end always match in some best matching."""
        low = 0
        while low < len(xs) and low < len(ys) and xs[low] == ys[low]:
            low += 1
        high = 0
        while high < min(len(xs), len(ys)) - low and xs[-1 - high] == ys[-1 - high]:
            high += 1
        return low, len(xs) - low - high, len(ys) - low - high

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The best order-keeping matching of two lists of children."""
        low, n, m = self.unlike(xs, ys)
        middle = self.programme(xs[low : low + n], ys[low : low + m]) if n and m else []
        return [*((i, i) for i in range(low)), *((low + i, low + j) for i, j in middle), *((len(xs) - k, len(ys) - k) for k in range(len(xs) - low - n, 0, -1))]

    def programme(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        kinds, at = np.unique(ys, return_inverse=True)
        rows = {x: np.array([self.score(x, y) for y in kinds.tolist()], np.int64)[at] for x in set(xs)}
        above, up, left = np.zeros(len(ys) + 1, np.int64), [], []
        for x in xs:
            row = np.concatenate(([0], np.maximum.accumulate(np.maximum(above[1:], above[:-1] + rows[x]))))
            up.append(np.packbits(row[1:] == above[1:]))
            left.append(np.packbits(row[1:] == row[:-1]))
            above = row
        bit = lambda bits, j: bits[j >> 3] >> (7 - (j & 7)) & 1
        found, i, j = [], len(xs), len(ys)
        while i and j:
            if bit(up[i - 1], j - 1):
                i -= 1
            elif bit(left[i - 1], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]

    def align(self, page: Node, pivot: Node) -> None:
        """Give every matched node of page the slot of its node of pivot."""
        open_pairs = [(page, pivot)]
        while open_pairs:
            a, b = open_pairs.pop()
            if a.label == b.label:
                a.slot = b.slot
                open_pairs += [(a.children[i], b.children[j]) for i, j in self.pairs(tuple(c.shape for c in a.children), tuple(c.shape for c in b.children))]


class Wrapper:
    """A layout's pivot with slots numbered in page order, its template, and where its article is."""

    def __init__(self, pivot: str, slots: list[dict] | None, shapes: Shapes):
        self.tree = parse(pivot)
        shapes.number(self.tree)
        for slot, node in enumerate(_nodes(self.tree)):
            node.slot = slot
        self.template = {x["slot"]: x["text"] for x in slots or () if x["text"] is not None}
        prose = {x["slot"]: x["prose"] for x in slots or ()}
        if not slots:
            self.region, self.titles = -1, set()
            return
        weights = [(0 if n.slot in self.template else prose.get(n.slot, 0)) + prose.get(-1 - n.slot, 0) for n in _nodes(self.tree)]
        found = region(self.tree, weights)
        self.region = found.slot if found is not None else -1
        self.titles = {n.slot for n in _nodes(self.tree) if n.tag == "h1" and n.slot in prose and n.slot not in self.template}


class Wrappers:
    """Wrappers by layout; all share what is known of shapes."""

    def __init__(self) -> None:
        self.known: dict[tuple, Wrapper] = {}
        self.shapes = Shapes()

    def aligned(self, page: str | None, key: tuple, pivot: str | None, slots: list[dict] | None = None) -> tuple[Node, Wrapper]:
        if len(self.shapes.numbers) + len(self.shapes.scores) > MEMO or len(self.known) > PIVOTS:
            self.__init__()
        if key not in self.known:
            self.known[key] = Wrapper(pivot or "", slots, self.shapes)
        tree = parse(page or "")
        self.shapes.number(tree)
        self.shapes.align(tree, self.known[key].tree)
        return tree, self.known[key]


def own_prose(node: Node) -> int:
    """Characters of the node's own text that are in no link."""
    return max(0, sum(len(t) for t in runs(node)) - node.linked)


def region(tree: Node, weights: list[int]) -> Node | None:
    """The smallest container with REGION of all weight, given by node in page order; None without any.

    It is entered only where its parent has next to no weight in paragraphs of its own, so that an
    article in which one part outweighs the rest stays whole; an article element is never divided.
    """
    nodes = list(_nodes(tree))
    total = dict(zip(map(id, nodes), weights))
    own = dict(total)
    for node in reversed(nodes):
        total[id(node)] = 0 if node.junk else total[id(node)] + sum(total[id(c)] for c in node.children)
    everything, now = total[id(tree)], tree
    if not everything:
        return None
    while now.tag != "article":
        inside = [c for c in now.children if c.tag in CONTAINERS and any(not x.inline for x in c.children)]
        largest = max(inside, key=lambda c: total[id(c)], default=None)
        direct = own[id(now)] + sum(total[id(c)] for c in now.children if c.tag in PROSE)
        if largest is None or total[id(largest)] < REGION * everything or direct > DIRECT * everything:
            break
        now = largest
    return now


def _nodes(tree: Node) -> Iterator[Node]:
    rest = [tree]
    while rest:
        node = rest.pop()
        yield node
        rest.extend(reversed(node.children))


def _digest(texts: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _length(node: Node, junk: bool = False) -> int:
    """Characters of text in a node; junk: whether those of what is no article count too."""
    total, rest = 0, [node]
    while rest:
        item = rest.pop()
        if isinstance(item, str):
            total += len(item)
        elif junk or not item.junk:
            rest.extend(item.items)
    return total


def _told(tree: Node) -> list[Node]:
    """Where a page itself says that its article is: its article elements, or its main parts."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    rest = [tree]
    while rest:
        node = rest.pop()
        if node.junk:
            continue
        if node.tag in found:
            found[node.tag].append(node)
        if node.tag != "article":
            rest.extend(reversed(node.children))
    return found["article"] or found["main"]


def roots(tree: Node, wrapper: Wrapper | None = None) -> tuple[list[Node], str]:
    """The parts of a page that are its article, in page order, and what told: "slots" of its wrapper or the "page" itself."""
    if wrapper is not None and wrapper.region >= 0:
        found: list[Node] = []
        for node in _open_nodes(tree):
            if node.slot == wrapper.region:
                return [*found, node], "slots"
            if node.slot in wrapper.titles:
                found.append(node)
    if told := _told(tree):
        return told, "page"
    found_here = region(tree, [own_prose(n) for n in _nodes(tree)])
    return [found_here or tree], "page"


def _open_nodes(tree: Node) -> Iterator[Node]:
    """The nodes of a page in order, less all that is no article."""
    rest = [tree]
    while rest:
        node = rest.pop()
        if not node.junk:
            yield node
            rest.extend(reversed(node.children))


def main_text(tree: Node, wrapper: Wrapper | None = None) -> tuple[str, str]:
    """The blocks of the article that are not template, one a line, and what told where it is."""
    parts, told = roots(tree, wrapper)
    template = wrapper.template if wrapper is not None else {}
    menus = told == "page" and not _told(tree)
    kept: list[str] = []
    every: list[str] = []

    def visit(node: Node, headings_only: bool) -> Iterator[tuple[Node, bool]]:
        """Takes the node's blocks, and yields its nodes where they are to be visited."""
        if node.junk:
            return
        headings_only = (headings_only or node.headings_only) and node.tag not in HEADINGS
        own = iter(runs_between(node))
        constant = node.slot in template and (texts := runs(node)) and template[node.slot] == _digest(texts)
        menu = menus and node.tag in ("li", "dd", "dt") and node.linked * 5 > 4 * sum(len(i) for i in node.items if isinstance(i, str) and not i.isspace()) > 0

        def add(block: str) -> None:
            if block and not headings_only and not menu:
                every.append(block)
                if not constant:
                    kept.append(block)

        add(next(own))
        for item in node.items:
            if not isinstance(item, str) and not item.inline:
                yield item, headings_only
                add(next(own))
            elif not isinstance(item, str) and not item.junk:
                yield item, headings_only

    for root in parts:
        walk = [visit(root, False)]
        while walk:
            if (inner := next(walk[-1], None)) is None:
                walk.pop()
            else:
                walk.append(visit(*inner))
    return "\n".join(kept or every), told


def runs_between(node: Node) -> list[str]:
    """As runs(), with empty ones: one before each block child and one after the last."""
    found: list[list[str]] = [[]]
    for item in node.items:
        if isinstance(item, str):
            found[-1].append(item)
        elif not item.inline:
            found.append([])
    return [" ".join("".join(r).split()) for r in found]


KEY = ["host", "layout"]


def _slot_counts(pages: DataFrame) -> DataFrame:
    """host, layout, slot, text (hash), n, prose, first and last page (hashes), pages (bits of hashes) over aligned pages, added up batch by batch.

    Text of nodes that the pivot lacks counts as prose of the slot around them, under -1 - slot.
    """
    fields = "host string, layout long, slot int, text long, n long, prose long, first long, last long, pages long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = Wrappers()
        for whole in parts:
            found: dict[tuple, list[int]] = {}
            for part in batches(whole, column=2):
                for host, layout, page, pivot in zip(*(c.to_pylist() for c in part.columns[:4])):
                    tree, _ = wrappers.aligned(page, (host, layout), pivot)
                    mark = _digest([page or ""])
                    for slot, text, prose in slot_texts(tree):
                        x = found.setdefault((host, layout, slot, text), [0, 0, mark, mark, 0])
                        x[0] += 1
                        x[1] += prose
                        x[2], x[3], x[4] = min(x[2], mark), max(x[3], mark), x[4] | 1 << mark % 63
            names = [f.split()[0] for f in fields.split(", ")]
            columns = list(zip(*(k + tuple(x) for k, x in found.items()))) or [()] * len(names)
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return small_batches(pages).select(*KEY, "html", "pivot").mapInArrow(run, fields)


def slot_texts(tree: Node) -> Iterator[tuple[int, int, int]]:
    """slot, text (hash), characters of prose of every node with text in an aligned page, less what is no article."""
    rest = [(tree, tree.slot)]
    while rest:
        node, around = rest.pop()
        if node.junk:
            continue
        if texts := runs(node):
            if node.slot >= 0:
                yield node.slot, _digest(texts), own_prose(node)
            elif around >= 0:
                yield -1 - around, 0, own_prose(node)
        inner = node.slot if node.slot >= 0 else around
        rest.extend((c, inner) for c in node.children)


def _wrapper_slots(counts: DataFrame, constant: float) -> DataFrame:
    """host, layout, slots: of every slot with text its prose, and its text (hash) if that is template."""
    by_text = counts.groupBy(*KEY, "slot", "text").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"), F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("pages").alias("pages"))
    most = lambda c: F.max_by(c, "n").alias(c)
    slots = by_text.groupBy(*KEY, "slot").agg(F.sum("n").alias("shown"), F.max("n").alias("n"), most("text"), most("first"), most("last"), most("pages"), F.bit_or("pages").alias("every"), F.sum("prose").alias("prose"))
    differ = (F.col("first") != F.col("last")) & (F.bit_count("pages") >= constant * F.bit_count("every"))
    fixed = (F.col("slot") >= 0) & (F.col("shown") >= LEAST) & (F.col("n") >= constant * F.col("shown")) & differ
    return slots.groupBy(*KEY).agg(F.collect_list(F.struct("slot", F.when(fixed, F.col("text")).alias("text"), "prose")).alias("slots"))


def _texts(pages: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = Wrappers()
        for whole in parts:
            for part in batches(whole, column=2):
                host, layout, page, pivot, slots = (c.to_pylist() for c in part.columns[:5])
                texts, told = zip(*[main_text(*wrappers.aligned(p, (h, x), v, s)) for h, x, p, v, s in zip(host, layout, page, pivot, slots)])
                yield pa.RecordBatch.from_arrays([part.column(5), part.column(6), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(told, pa.string())], names=["page_id", "url", "text", "n_chars", "told_by"])

    return small_batches(pages).select(*KEY, "html", "pivot", "slots", "page_id", "url").mapInArrow(run, "page_id long, url string, text string, n_chars long, told_by string")


def layout_of(page: Column) -> Column:
    """A page's layout: the containers it uses, by element and first class, numbers aside."""
    tags = F.regexp_extract_all(page, F.lit(r"""(?i)<(?:div|section|article|main|header|footer|nav|aside|form)\b(?:[^>]*?\bclass\s*=\s*["']?[^\s"'>]*)?"""), F.lit(0))
    named = F.transform(tags, lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, r"""(?is)^(<\w+).*?(?:\bclass\s*=\s*["']?|$)""", "$1 "), r"[0-9]+", "")))
    return F.xxhash64(F.array_sort(F.array_distinct(named)))


def extract(pages: DataFrame, constant: float = CONSTANT, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars and told_by ("slots" of the wrapper, or the "page" itself) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    html_ = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html_.alias("html"), host.alias("host"))
    pages = pages.withColumn("own", layout_of(F.col("html")))
    mark = F.xxhash64("html", "page_id", "url")
    layouts = materialize(pages.filter("html != ''").groupBy("host", "own").agg(F.min(mark).alias("mark"), F.count("*").alias("n")), "layouts")
    most = layouts.groupBy(F.col("host").alias("main_host")).agg(F.max("n").alias("most"))
    main = layouts.join(most, (F.col("host") == F.col("main_host")) & (F.col("n") == F.col("most"))).groupBy("main_host").agg(F.min("own").alias("main"))
    chosen = layouts.join(main, F.col("host") == F.col("main_host")).filter((F.col("n") >= least) | (F.col("own") == F.col("main")))
    chosen = materialize(chosen.select(F.col("host").alias("host_of"), F.col("own").alias("layout_of"), "mark", (F.col("own") == F.col("main")).alias("is_main")), "chosen", layouts.count())
    found = pages.join(small(chosen, 100_000), (F.col("host") == F.col("host_of")) & (F.col("own") == F.col("layout_of")) & (mark == F.col("mark")))
    pivots = materialize(found.groupBy("host_of", "layout_of").agg(F.min("html").alias("pivot"), F.first("is_main").alias("is_main")), "pivots")
    few = (pivots.agg(F.sum(F.octet_length("pivot") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    beside = lambda x: F.broadcast(x) if few else x
    known = pivots.select(F.col("host_of").alias("own_host"), F.col("layout_of").alias("own_layout"))
    commonest = pivots.filter("is_main").select(F.col("host_of").alias("main_host"), F.col("layout_of").alias("main_layout"))
    dealt = pages.join(beside(known), (F.col("host") == F.col("own_host")) & (F.col("own") == F.col("own_layout")), "left").join(beside(commonest), F.col("host") == F.col("main_host"), "left")
    dealt = dealt.withColumn("layout", F.coalesce("own_layout", "main_layout", F.lit(0)))
    at = lambda table: (F.col("host") == table["host_of"]) & (F.col("layout") == table["layout_of"])
    slots = _wrapper_slots(_slot_counts(dealt.join(beside(pivots), at(pivots), "left")), constant).select(F.col("host").alias("host_s"), F.col("layout").alias("layout_s"), "slots")
    wrappers = pivots.join(slots, (F.col("host_of") == F.col("host_s")) & (F.col("layout_of") == F.col("layout_s")), "left").select("host_of", "layout_of", "pivot", "slots")
    wrappers = materialize(wrappers, "wrappers")
    return _texts(dealt.join(beside(wrappers), at(wrappers), "left"))
