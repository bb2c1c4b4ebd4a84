"""Main text of web pages by composite text density (operator 4).

Every node of the page gets its composite text density: characters per tag, times the logarithm of
the page-adjusted link ratios, to a base that grows with the links inside (so texts full of links
weigh less). A node's density sum is the sum over its children. The body's node of the largest sum
is the content, and the smallest density on the path from the body to it is the threshold below
which parts are left out; headings and dense texts beside the content belong to it as well.

Elements that never hold article text (navigation, scripts, forms and the like) are not in the
tree, nor are parts that a role marks as such. The words of a class or id (advertising, notices,
comments) are only evidence. A name counts only if all its parts are such words or words for plain
containers (``ad-box`` does, ``ad-hoc`` doesn't). A marked part is cut unless it is a heading, holds
the article or main element or most of the page's text, is a section that is named after its own
heading, or is prose inside an article under a word that articles use as well (``notice``, ``tags``).

Parsing takes time in proportion to the page, whatever is unclosed or stray in it.

Defined results: a null, empty or text-free page gives an empty text; unclosed and stray tags are
tolerated; an attribute whose quote is never closed ends with its tag, a tag that never ends takes
the rest of the page; repeated rows each keep their result; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What an attribute list stops at: its end, or a value in quotes.
STEP = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile("class|id|role|hidden", re.I)

# fixed values: elements and roles as HTML names them
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
#: Never part of an article, with all they hold.
CUT = RAW | {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "label", "input", "svg",
             "canvas", "object", "audio", "video", "dialog", "fieldset", "datalist", "map"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog",
             "alert", "alertdialog", "toolbar"}
#: Elements of the raw kind whose content is tags all the same.
NOT_TEXT = {"noscript", "template"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
          "tfoot", "th", "thead", "tr", "ul"}
#: Opening tags that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
#: Groups of elements whose end tag may be missing: the members, and what keeps them from outside.
GROUPS = {
    "p": ({"p"}, {"td", "th", "button", "table", "caption"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "d": ({"dt", "dd"}, {"dl"}),
    "row": ({"tr"}, {"table"}),
    "cell": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: The groups whose innermost open member an opening tag ends.
ENDS = {"li": ("li", "p"), "dt": ("d", "p"), "dd": ("d", "p"), "tr": ("row", "cell"), "td": ("cell",), "th": ("cell",),
        "option": ("option",)} | {tag: ("p",) for tag in ENDS_P - {"li", "dt", "dd"}}
#: What an element is to the groups: (group, whether it is a barrier).
PART_OF: dict[str, list[tuple[str, bool]]] = {}
for _group, (_members, _barriers) in GROUPS.items():
    for _tag in _members:
        PART_OF.setdefault(_tag, []).append((_group, False))
    for _tag in _barriers:
        PART_OF.setdefault(_tag, []).append((_group, True))

#: Words of a class or id that speak against a part, wherever it stands.
AGAINST = re.compile(
    r"ad|ads|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|paywall|comments?|disqus|respond|reply|replies|sidebar|footer|masthead|topbar|navbar|nav|"
    r"breadcrumbs?|login|signup|pagination|pager",
    re.I,
)
#: Words that do so outside articles; inside, only against what is no prose.
PERHAPS = re.compile(
    r"banner|notice|menu|navigation|side|widget|toolbar|discussion|related|recommend\w*|share|sharing|social|search|"
    r"skip|hidden|tags",
    re.I,
)
#: Words for plain containers, which say nothing by themselves.
NEUTRAL = re.compile(
    r"\d+(?:x\d+)?|[a-z]|area|bar|block|body|box|btn|buttons?|container|content|form|group|head|header|icons?|inner|items?|"
    r"left|right|top|bottom|main|links?|list|module|msg|message|outer|page|panel|post|posts|row|section|site|slot|text|"
    r"title|unit|wrap|wrapper|article|articles|story|stories|new|us|to|the|more|bottom|global|primary|secondary|sticky",
    re.I,
)
#: Of those, what also names sections under a heading that are not the article.
NOT_SECTIONS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|reply|replies)(?=$|[\s_-])", re.I)
#: A marked part is a wrapper of the page with this share of its text, and so many times the unmarked text outside.
SHARE, TIMES = 0.5, 4
#: Characters outside links from which a part counts as prose.
PROSE = 60
#: Share of a part's characters in links from which it is a list of links.
LINKED = 0.5
CERTAIN, DOUBTFUL = 2, 1


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked",
                 "name", "hidden", "article")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[str | Node] = []  # text and children, in order
        self.marked, self.name = 0, ""  # by class or id; the id
        self.hidden = parent is not None and parent.hidden  # cut, or inside of what is cut
        self.article = tag in ARTICLE or (parent is not None and parent.article)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def evidence(names: str) -> int:
    """What a class or id says against an element: ``CERTAIN``, ``DOUBTFUL`` or nothing."""
    found = 0
    for name in names.split():
        said = 0
        for part in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name):
            if AGAINST.fullmatch(part):
                said = CERTAIN
            elif PERHAPS.fullmatch(part):
                said = max(said, DOUBTFUL)
            elif part and not NEUTRAL.fullmatch(part):
                said = 0
                break
        found = max(found, said)
    return found


def _describe(node: Node, attributes: str) -> None:
    """Note what tag and attributes say against an element."""
    tag = node.tag
    if tag in CUT or (tag == "header" and not node.article):
        node.hidden = True
        return
    if not attributes or not TELLING.search(attributes):
        return
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or (name == "role" and value.lower() in CUT_ROLES):
            node.hidden = tag not in ("html", "body") or node.hidden
        elif name in ("class", "id"):
            if name == "id":
                node.name = value
            if tag not in ("html", "body") and tag not in ARTICLE and tag not in HEADINGS:
                node.marked = max(node.marked, evidence(value))


class Parser:
    """Tree of a page. Open elements are counted by tag and kept by group, so no tag costs a search."""

    def __init__(self, page: str):
        self.page = page
        self.root = Node("#root", None)
        self.nodes, self.open = [self.root], [self.root]
        self.count: Counter = Counter()
        self.groups: dict[str, list[tuple[int, bool]]] = {g: [] for g in GROUPS}
        self.missing: set[str] = set()  # marks that do not come again in the page

    def _find(self, mark: str, at: int) -> int:
        if mark in self.missing:
            return -1
        place = self.page.find(mark, at)
        if place < 0:
            self.missing.add(mark)
        return place

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` of the tag whose attributes start at ``at``; -1 if it never ends."""
        while True:
            m = STEP.search(self.page, at)
            if not m:
                return -1
            if not m[1]:
                return m.start()
            start = m.end()
            close = self._find(m[1], start)
            stop = self.page.find(">", start, close if close >= 0 else None)
            # a value with a tag's end in it that runs to no quote, or to one that opens another value
            if stop >= 0 and (close < 0 or self.page[start:close].rstrip().endswith("=")):
                return stop
            if close < 0:
                return -1
            at = close + 1

    def _push(self, node: Node) -> None:
        for group, barrier in PART_OF.get(node.tag, ()):
            self.groups[group].append((len(self.open), barrier))
        self.count[node.tag] += 1
        self.open.append(node)

    def _pop_to(self, size: int) -> None:
        while len(self.open) > size:
            node = self.open.pop()
            self.count[node.tag] -= 1
            for group, _ in PART_OF.get(node.tag, ()):
                self.groups[group].pop()

    def _text(self, lo: int, hi: int) -> None:
        if lo < hi and not self.open[-1].hidden:
            self.open[-1].parts.append(self.page[lo:hi])

    def _end(self, tag: str) -> None:
        if self.count[tag]:
            size = len(self.open) - 1
            while self.open[size].tag != tag:
                size -= 1
            self._pop_to(size)

    def _start(self, tag: str, attributes: str) -> bool:
        """Open an element; whether it may hold something."""
        if self.count["head"] and tag in ("body", "article", "main", "div", "p"):
            self._end("head")  # a head that was never closed
        for group in ENDS.get(tag, ()):
            inner = self.groups[group]
            if inner and not inner[-1][1]:
                self._pop_to(inner[-1][0])
        parent = self.open[-1]
        node = Node(tag, parent)
        if not parent.hidden:
            _describe(node, attributes)
            if node.hidden:
                parent.parts.append("\n")
            else:
                parent.parts.append(node)
                self.nodes.append(node)
        if tag in VOID or attributes.endswith("/"):
            return False
        self._push(node)
        return True

    def parse(self) -> tuple[Node, list[Node]]:
        """The root and all nodes in document order; what is cut is not in the tree."""
        page, at, text = self.page, 0, 0  # ``text``: where the text not yet taken begins
        while (at := self._find("<", at)) >= 0:
            if page.startswith("<!--", at):
                self._text(text, at)
                end = self._find("-->", at + 2)
                if end < 0:
                    return self.root, self.nodes
                at = text = end + 3
                continue
            mark = page[at + 1 : at + 2]
            if mark in ("!", "?"):
                self._text(text, at)
                end = self._find(">", at)
                if end < 0:
                    return self.root, self.nodes
                at = text = end + 1
                continue
            closing = mark == "/"
            m = NAME.match(page, at + 1 + closing)
            if not m:
                at += 1
                continue
            self._text(text, at)
            end = self._tag_end(m.end())
            if end < 0:
                return self.root, self.nodes
            tag = m[0].lower()
            at = text = end + 1
            if closing:
                self._end(tag)
            elif self._start(tag, page[m.end() : end]) and tag in RAW and tag not in NOT_TEXT:
                last = re.compile(f"</{tag}(?=[\\s/>])", re.ASCII | re.IGNORECASE).search(page, at)
                if not last:
                    return self.root, self.nodes
                at = text = last.start()
        self._text(text, len(page))
        return self.root, self.nodes


def parse(page: str) -> tuple[Node, list[Node]]:
    return Parser(page).parse()


def _below(node: Node) -> list[Node]:
    """The node and all below it, in document order."""
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        found.append(n)
        stack += [p for p in reversed(n.parts) if not isinstance(p, str)]
    return found


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", entities.unescape(text).lower()))


def _prune(root: Node, nodes: list[Node]) -> list[Node]:
    """Take out the marked parts that are not the article; the nodes left."""
    if not any(n.marked for n in nodes):
        return nodes
    plain, linked, clean, holds = {}, {}, {}, set()  # text outside links, in links, outside marked parts too; article
    heading: dict[Node, Node] = {}  # the first heading inside
    for n in reversed(nodes):
        own = sum(sum(map(len, p.split())) for p in n.parts if isinstance(p, str))
        below = [p for p in n.parts if not isinstance(p, str)]
        inside = own + sum(plain[p] for p in below)
        link = n.tag == "a"
        plain[n] = 0 if link else inside
        linked[n] = sum(linked[p] for p in below) + (inside if link else 0)
        clean[n] = 0 if link else own + sum(clean[p] for p in below if not p.marked)
        if n.tag in ARTICLE or any(p in holds for p in below):
            holds.add(n)
        first = n if n.tag in HEADINGS else next((heading[p] for p in below if p in heading), None)
        if first is not None:
            heading[n] = first
    slugs: dict[Node, str] = {}

    def named(n: Node) -> bool:
        """Whether a part's id is that of its own first heading."""
        if not n.name or n not in heading or NOT_SECTIONS.search(n.name):
            return False
        h = heading[n]
        if h not in slugs:
            slugs[h] = _slug("".join(p for x in _below(h) for p in x.parts if isinstance(p, str))).strip("-")
        return slugs[h] == _slug(n.name)

    stack: list[tuple[Node, int, int]] = [(root, plain[root], clean[root])]
    while stack:
        n, whole, outside = stack.pop()
        kept: list[str | Node] = []
        for p in n.parts:
            if isinstance(p, str) or not p.marked:
                kept.append(p)
                if not isinstance(p, str):
                    stack.append((p, whole, outside))
            elif p in holds or (plain[p] >= SHARE * whole and plain[p] >= TIMES * outside and plain[p]):
                kept.append(p)
                stack.append((p, plain[p], clean[p]))
            elif named(p) or (p.marked == DOUBTFUL and p.article and plain[p] >= max(PROSE, linked[p])):
                kept.append(p)
                stack.append((p, whole, outside))
            else:
                kept.append("\n")
        n.parts = kept
    return _below(root)


def _measure(nodes: list[Node], body: Node) -> None:
    for n in reversed(nodes):
        for p in n.parts:
            if isinstance(p, str):
                n.chars += sum(map(len, p.split()))
            else:
                n.chars += p.chars
                n.tags += p.tags + (p.tag not in ("br", "wbr"))
                n.link_chars += p.link_chars
                n.link_tags += p.link_tags + (p.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    for n in nodes:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, body.chars, body.link_chars)
        if n.parent is not None:
            n.parent.total += n.density


def density(chars: int, tags: int, link_chars: int, link_tags: int, all_chars: int, all_links: int) -> float:
    """Composite text density: C/T * log_b(C/LC * T/LT), b = ln(C/(C-LC) * LC + LCb/Cb * C + e).

    Counts of zero stand as one, so the base is always above 1; what is only links has none.
    """
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    if link_chars >= c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + max(all_links, 1) / max(all_chars, 1) * c + math.e)
    return max(c / t * math.log(c / lc * t / lt) / math.log(base), 0.0)


def extract(page: str) -> str:
    """The main text: blocks in page order, parted by an empty line."""
    if not page or page.isspace():
        return ""
    root, nodes = parse(page)
    nodes = _prune(root, nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    if body is not root and any((p.strip() if isinstance(p, str) else p.tag not in ("html", "body")) for p in root.parts):
        body = root  # text outside the body
    _measure(nodes, body)
    if not body.chars:
        return ""
    best = body
    for n in nodes:
        if n.total > best.total:
            best = n
    path, n = [], best
    while n is not None and n is not body:
        path.append(n)
        n = n.parent
    threshold = min((n.density for n in [*path, body] if n.density > 0), default=0.0)
    # the whole article, if the densest part lies in one
    top = next((n for n in reversed(path) if n.tag in ARTICLE), None)
    inside = top is not None
    way = set(path) if not inside else set()  # from the body to the content
    if not inside:
        top = body
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = " ".join(entities.unescape("".join(line)).split())
        if words:
            blocks.append(words)
        line.clear()

    def dense(n: Node) -> bool:
        """Inside the content all but lists of links that are thinner than all that holds it."""
        return inside or n.density >= threshold or n.link_chars < LINKED * n.chars or n.tag not in ("ul", "ol", "table", "div", "section")

    def beside(n: Node) -> bool:
        """Headings and dense prose beside the content."""
        return n.tag in HEADINGS or (
            n.density >= threshold and n.link_chars < LINKED * n.chars and n.chars - n.link_chars >= PROSE
        )

    stack: list = [(top, inside or top is best)]
    while stack:
        p, within = stack.pop()
        if isinstance(p, str):
            line.append(p)
        elif p is None:
            end()
        elif p.tag in ("br", "wbr"):
            line.append(" " if p.tag == "br" else "")
        else:
            block = p.tag in BLOCKS
            if block:
                end()
                stack.append((None, True))
            for part in reversed(p.parts):
                if within:
                    take = isinstance(part, str) or dense(part)
                    stack += [(part, True)] * take
                elif isinstance(part, str):
                    if len(part.strip()) >= PROSE:
                        stack.append((part, False))
                elif part in way:
                    stack.append((part, part is best))
                elif beside(part):
                    stack.append((part, True))
    end()
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, with its main text and that text's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [extract(t) for t in texts(b, "__html")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                [*keep, "text", "n_chars"],
            )

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(documents(spark, sf_dir, "pages"))
