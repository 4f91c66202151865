"""Main-text extraction from web pages by composite text density.

A page becomes a DOM; parts that by their tag or role are menus, scripts and the like are left out. Class names, ids and the
form tag speak against a part. Names of adverts, notices, menus, comments and the like leave it out wherever anything else has
text; vaguer ones unless it holds a main element or the densest subtree of what is left, or unless all parts of these names side by
side are denser together than all that would stay.
For every remaining node the composite text density is computed: characters per tag, adjusted for links against the
page's overall share of link text. A node's density sum is the sum of its children's densities; the subtree with the
largest sum is the main text, together with those others whose nodes reach the threshold, the least density on the path
from that subtree to the body. Where the chosen subtree lies in an article or main element, that element is the main text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices

#: A quote opens a value only after the equals sign; one that is never closed is a part of an unquoted value.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+", re.A)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE.replace('([', '(?:[')})?+)*+)(?:>|\Z)", re.S | re.A
)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: The void elements, and the elements whose content is not markup.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_FOREIGN = frozenset("svg math path circle rect line g use polygon polyline ellipse".split())
#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph, and for each element those that its start ends, up to a bound.
_ENDS_P = _BLOCK - frozenset("caption tbody td tfoot th thead tr option optgroup html body legend".split())
_ENDS = {
    "li": ("li", frozenset("ul ol menu dir".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset("table tr".split())), "th": ("td th", frozenset("table tr".split())),
    "tbody": ("tbody thead tfoot tr td th", frozenset(["table"])), "tfoot": ("tbody thead tr td th", frozenset(["table"])), "thead": ("tbody", frozenset(["table"])),
    "option": ("option", frozenset("select datalist".split())), "optgroup": ("option optgroup", frozenset(["select"])),
}
_MARKS = frozenset(t for ended, bound in _ENDS.values() for t in (*ended.split(), *bound))
_ENDS = {t: (frozenset(ended.split()), bound) for t, (ended, bound) in _ENDS.items()}
_CELLS, _TABLE_PARTS = frozenset("td th table caption".split()), frozenset("table tr tbody thead tfoot body html".split())
_P_SCOPE = frozenset("applet button caption html marquee object table td th template".split())
#: Elements and roles that are never main text.
_DROPPED = frozenset("head nav aside footer script style noscript template iframe object embed svg math canvas audio video button select option datalist textarea input label dialog menu map noembed noframes applet".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status tablist".split())
#: Parts of class names and ids that name what is not main text.
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner sidebar "
    "sidebars menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification disclaimer "
    "popup modal overlay lightbox newsletter subscribe subscription signup signin login share sharing sharebar social related recommended recommendations widget widgets pagination "
    "pager paging toolbar skip skiplink search searchbox searchform paywall alert comment comments commentlist discussion disqus respond replies reply reactions reaction responses guestbook feedback outbrain taboola hidden".split()
)
_COMMENTS = frozenset("comment comments commentlist discussion disqus respond replies reply reactions reaction responses guestbook".split())
#: Those that in one name with a word for text (paywall-content, widget-body) name that text itself.
_WRAPPERS = frozenset("widget widgets paywall overlay modal popup hidden skip social subscription subscribe alert".split())
#: Names that may as well be those of an article's own parts.
_VAGUE = _WRAPPERS | frozenset("promo promos promotion promoted related recommended recommendations sponsored share sharing sharebar feedback banner masthead".split())
_TEXT_NAMES = frozenset("content body text article post story entry main feature".split())
_MAIN = frozenset(["article", "main"])
#: First and last parts of names that tell the state of a part that is something else (has-sidebar, comments-open),
#: and first parts of page builders' names, whose widgets are containers of any content.
_STATES, _STATES_AFTER = frozenset("has no not non with without".split()), frozenset("open opened closed off enabled disabled".split())
_BUILDERS = frozenset("elementor et wp fl vc siteorigin so panel wpb fusion avia brxe".split())
#: The density is a logarithm to a base that tends to 1 on pages without links; it is kept off 1.
_LEAST_BASE = 1.5


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubt", "comments", "main", "holds_main", "names", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[_Node | str] = []
        self.dropped = self.doubt = self.comments = self.main = self.holds_main = False
        self.names: frozenset[str] = frozenset()


def _names(attributes: str) -> tuple[set[str], str, bool, bool]:
    """Parts of the class names and the id, the role, whether it is hidden, whether it is the article's body."""
    parts: set[str] = set()
    role, hidden, body = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in value.split():
                own = [x.lower() for x in _NAME_PART.findall(word)]
                if len(own) > 1 and (own[0] in _STATES or own[-1] in _STATES_AFTER):
                    continue
                if len(own) > 1 and own[0] in _BUILDERS:
                    own = [x for x in own if x not in ("widget", "widgets")]
                if not _TEXT_NAMES.isdisjoint(own):
                    own = [x for x in own if x not in _WRAPPERS]
                parts.update(own)
        elif name == "role":
            role = value.strip().lower()
        elif name == "itemprop":
            body = body or value.strip().lower() == "articlebody"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "hidden":
            hidden = True
    return parts, role, hidden, body


class _Open:
    """The open elements: the innermost one, and how many there are of each tag, over all and within the current table cell.

    An element is entered and left once, and the counts say whether a search upward will find anything, so a page takes time
    in proportion to its length, however deep it is."""

    def __init__(self, root: _Node):
        self.here = root
        self.count: Counter = Counter()
        self.cells: list[Counter] = [Counter()]
        self.paragraphs: list[_Node | None] = [None]  # for each open element the paragraph that a block would end
        self.marks: list[_Node] = []  # open elements that the rules of _ENDS look at

    def enter(self, node: _Node) -> None:
        self.here, tag = node, node.tag
        self.count[tag] += 1
        if tag in _CELLS:
            self.cells.append(Counter())
        self.cells[-1][tag] += 1
        self.paragraphs.append(node if tag == "p" else None if tag in _P_SCOPE else self.paragraphs[-1])
        if tag in _MARKS:
            self.marks.append(node)

    def leave(self, node: _Node) -> None:
        """Leaves the open elements up to and with this one."""
        while True:
            here = self.here
            self.count[here.tag] -= 1
            self.cells[-1][here.tag] -= 1
            if here.tag in _CELLS:
                self.cells.pop()
            self.paragraphs.pop()
            if here.tag in _MARKS:
                self.marks.pop()
            self.here = here.parent
            if here is node:
                return

    def innermost(self, tag: str) -> _Node:
        node = self.here
        while node.tag != tag:
            node = node.parent
        return node

    def end(self, tag: str) -> None:
        """An end tag; it does not reach out of a table cell but for the table's own parts."""
        if (self.count if tag in _TABLE_PARTS else self.cells[-1])[tag]:
            self.leave(self.innermost(tag))

    def start(self, tag: str) -> None:
        """What the start of an element ends."""
        if (tag in _ENDS_P or tag in _ENDS) and self.paragraphs[-1] is not None:
            self.leave(self.paragraphs[-1])
        if tag in _ENDS:
            ended, bound = _ENDS[tag]
            last = None
            for node in reversed(self.marks):
                if node.tag in bound:
                    break
                if node.tag in ended:
                    last = node
            if last is not None:
                self.leave(last)
        if tag == "body" and self.count["head"]:  # whatever is open in the head ends
            self.leave(self.innermost("head"))


def parse(html: str) -> _Node:
    """The DOM under a root node. Text nodes are decoded strings; comments, declarations and raw-text elements are left out."""
    root = _Node("#root", None)
    opened = _Open(root)
    at, size = 0, len(html)
    find = _TOKEN.search
    while at < size:
        m = find(html, at)
        if m is None:
            opened.here.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            opened.here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if tag in ("body", "html") and opened.count[tag]:
            continue
        opened.start(tag)
        child = _Node(tag, opened.here)
        opened.here.children.append(child)
        _judge(child, m[3], any(opened.count[t] for t in _MAIN))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(html, at)
            at = end.end()
        elif tag not in _VOID and not (tag in _FOREIGN and m[3].rstrip().endswith("/")):  # a slash does not close an HTML element
            opened.enter(child)
    return root


def _up(node: _Node | None, tag: str) -> Iterator[_Node]:
    while node is not None:
        if node.tag == tag:
            yield node
        node = node.parent


def _judge(node: _Node, attributes: str, in_main: bool) -> None:
    """Marks the node as dropped for its tag or role, or as doubtful for its names or as a form; _settle decides on those."""
    names, role, hidden, body = _names(attributes) if attributes.strip() else (set(), "", False, False)
    main = node.tag in _MAIN or role in ("main", "article") or body
    node.comments, node.names = bool(names & _COMMENTS), frozenset(names & _DROPPED_NAMES)
    if main and not node.comments:
        node.main = node.holds_main = True
    node.dropped = node.tag in _DROPPED or hidden or role in _DROPPED_ROLES
    if not node.dropped and node.tag not in ("html", "body") and not node.holds_main:
        node.doubt = node.tag == "form" or role == "form" or bool(names & _DROPPED_NAMES)
    if node.tag == "header" and not node.dropped:
        node.doubt = node.doubt or not in_main


def _settle(root: _Node) -> list[_Node]:
    """The nodes in document order. Elements stay that hold a main element, unless their tag is dropped, and of doubtful ones those
    that hold the densest subtree there is, with their siblings of the same tag and names."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    for node in reversed(order):
        holds = any(c.holds_main and not c.dropped for c in node.children if isinstance(c, _Node))
        if holds:
            node.holds_main = True
            node.doubt = False
            if node.tag not in _DROPPED:
                node.dropped = False
    doubts = [n for n in order if n.doubt and not n.dropped]
    if not doubts:
        return order
    body = next((n for n in order if n.tag == "body"), root)
    certain = [n for n in doubts if not n.names <= _VAGUE]

    def weigh(*parts: list[_Node]) -> _Node:
        """The densest subtree without these parts."""
        for node in doubts:
            node.dropped = False
        for node in (n for part in parts for n in part):
            node.dropped = True
        hidden, body.dropped = body.dropped, False
        _measure(order, body)
        body.dropped = hidden
        return _densest(body)[id(body)]

    def hold(node: _Node | None) -> None:
        while node is not None:
            if node.doubt:
                held.add(group(node))
            node = node.parent

    group = lambda n: (id(n.parent), n.tag, n.names)
    held: set[tuple] = set()
    best = weigh(certain)
    if body.chars == body.link_chars:  # nothing else has text
        certain, best = [n for n in certain if n.comments], weigh([n for n in certain if n.comments])
        if body.chars == body.link_chars:
            certain, best = [], weigh()
    if best.total:
        hold(best)
    sums: dict[tuple, float] = Counter()
    of: dict[tuple, _Node] = {}
    for node in doubts:
        if not node.dropped and group(node) not in held:
            sums[group(node)] += node.density
            of.setdefault(group(node), node)
    left = weigh(certain, [n for n in doubts if group(n) not in held]).total
    if sums and (most := max(sums, key=lambda k: sums[k])) and sums[most] > left:
        hold(of[most])
    for node in doubts:
        node.dropped = group(node) not in held
    return order


def _measure(order: list[_Node], body: _Node) -> None:
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * (t / lt), 1.0)) / math.log(max(base, _LEAST_BASE))
        node.total = sum(x.density for x in node.children if isinstance(x, _Node) and not x.dropped)
        if any(isinstance(x, str) and not x.isspace() for x in node.children):
            node.total = max(node.total, node.density)  # text of its own counts as a child


def _kept(body: _Node) -> list[_Node]:
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, _Node) and not c.dropped)
    return order


def _densest(body: _Node) -> dict[int, _Node]:
    """For each node the one with the largest sum in its subtree, the first of equals."""
    top_of: dict[int, _Node] = {}
    for x in reversed(_kept(body)):
        below = [top_of[id(c)] for c in x.children if isinstance(c, _Node) and not c.dropped]
        top_of[id(x)] = max([x, *below], key=lambda y: y.total)
    return top_of


def _select(body: _Node) -> list[_Node]:
    """The nodes of the main text, in document order, none inside another. The page's only h1 is one, where it comes before them."""
    order, top_of = _kept(body), _densest(body)
    best = top_of[id(body)]
    node = best
    while node is not None and node is not body:
        if node.tag in _MAIN:
            top = node
            for up in (x for t in _MAIN for x in _up(node.parent, t)):
                if up.tag == "article":
                    top = up
            return [top]
        node = node.parent
    threshold, node = best.density, best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    chosen: set[int] = {id(best)}
    for x in order:
        if x is not body and x.density >= threshold and x.chars:
            chosen.add(id(top_of[id(x)]))
    titles = [x for x in order if x.tag == "h1"]
    if best.total and len(titles) == 1 and order.index(titles[0]) < order.index(best):
        chosen.add(id(titles[0]))
    found, stack = [], [body]
    while stack:
        x = stack.pop()
        if id(x) in chosen:
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, _Node) and not c.dropped)
    return found


def _blocks(nodes: list[_Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for top in nodes:
        stack: list[_Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif not x.dropped or x is top:
                if x.tag == "br" or x.tag == "wbr":
                    held.append(" " if x.tag == "br" else "")
                if x.tag in _BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def extract(html: str | None) -> str:
    """The main text: its blocks in page order, one a line; empty if there is none."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    order = _settle(root)
    body = next((n for n in order if n.tag == "body"), root)
    body.dropped = False
    _measure(order, body)
    return "\n".join(_blocks(_select(body)))


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with text and n_chars (its code points).

    A null or empty page gives an empty text. Each row stands alone, so repeated rows, ties and empty tables need no rule;
    columns other than `keep` and the page are not read.
    """
    keep = pages.columns if keep is None else keep
    rows = pages.select(F.col(html).alias("h"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                texts = [extract(h) for h in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["row", "text", "n_chars"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long").select("row.*", "text", "n_chars")
