"""Main text of web pages by tree scoring.

A page is read into a tree of containers (tags that only style text are not nodes).  Parts that are
never main text are left out: scripts, styles, forms, navigation, headers and footers of the page,
sidebars, and containers whose class, id or role says advert, notice, share bar, related links or
reader comments.  An <article> or <main> that says so is left out if there is another one beside it, or if
the page has more text outside it than inside.  Every paragraph-like block then passes points to its
ancestors: one for being there, one for each comma, one for each 100 characters up to three; its parent
gets all of them, every further ancestor half of the one below, up to the root, summed in one pass from
the leaves.  A container's points are discounted by its link density.
The best container, or the <article> or <main> around it, is taken, together with siblings that score
at least a fifth of it (and ten points) or are dense text themselves, inside a <main> those of every
level below it; their blocks are the main text.

Work is per page (Arrow batches); nothing is shuffled.  Defined results: null or empty html, and
pages without text, give an empty text; repeated rows are extracted each on its own; very long pages
are read whole in linear time (broken tags and deep nesting included); ties go to the container that comes
first; an empty table gives no rows; other input columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
# An ordinary tag; a broken one costs no more than the way to the next "<"
TAG = re.compile(r"""<(?P<close>/?)(?P<tag>[A-Za-z][^\s/><]*+)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
NAME = re.compile(r"<(?P<close>/?)(?P<tag>[A-Za-z][^\s/><]*+)")
ATTRIBUTE = re.compile(r"""(?P<name>[^\s=/"'>]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?""")
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
DROP = frozenset("head nav aside footer form button select option fieldset dialog menu applet audio video canvas map".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul details dialog hgroup center dir".split())
# An opening tag ends an open one of these, up to the boundary named
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}),
        "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
# Words in class, id or role that mark a part as not main text
JUNK = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted
banner banners comment comments commentlist disqus discussion respond responses replies reply feedback nav navbar navigation menu menus breadcrumb breadcrumbs
pagination pager footer foot sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay
toolbar share sharing social related recommended recommendations subscribe subscription newsletter signup login masthead topbar
skip skiplink tags toc complementary contentinfo search dialog copyright disclaimer legal hidden header""".split())
JUNK_STARTS = ("cookie", "advert", "sponsor", "newsletter", "subscri", "breadcrumb", "sidebar", "navbar", "footer", "popup")
MAIN = frozenset("article main content post entry story body text page".split())
WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*)")


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None"
    order: int
    junk: bool = False
    inside: bool = False  # an article or main, or inside one
    doubt: bool = False  # an article or main that is named like something else
    children: list["Node"] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (place in the page, text) directly in this node
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0


def _is_junk(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROP or tag == "header" and not in_article:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name in ("class", "id", "role"):
            words = {w.lower() for part in value.split() for w in WORD.findall(part)}
            if in_article:
                words.discard("header")  # that of the article
            junk = words & JUNK or {w for w in words if w.startswith(JUNK_STARTS)}
            if junk and not (words & MAIN and junk <= _MAY_BE_MAIN):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


# Next to a word for main text ("post-header", "search-page") these do not mark a part as something else
_MAY_BE_MAIN = frozenset("page text tags toc search related social share promo menu widget header".split())


class Tree:
    """One pass over the tags; blocks are finished whenever a container begins or ends."""

    def __init__(self, source: str):
        self.node = Node("html", None, 0)
        self.nodes = [self.node]
        self.stack = [self.node]
        self.open: dict[str, list[int]] = {}  # tag: depths of its open nodes
        self.text: list[str] = []
        self.in_link = 0
        self.links = 0
        self.place = 0
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                self.node.blocks.append((self.place, block))
                self.node.chars += len(block)
                self.node.link_chars += min(self.links, len(block))
                self.place += 1
            self.text = []
        self.links = 0

    def data(self, raw: str) -> None:
        if raw:
            s = entities.unescape(raw) if "&" in raw else raw
            self.text.append(s)
            if self.in_link:
                self.links += len(s)

    def push(self, tag: str, attrs: str) -> None:
        self.flush()
        self.in_link = 0
        up, article = self.node, tag in ("article", "main")
        junk = _is_junk(tag, attrs, up.inside)
        node = Node(tag, up, len(self.nodes), up.junk or junk and not article, up.inside or article, article and junk and not up.junk)
        up.children.append(node)
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.node = node

    def close(self, depth: int) -> None:
        self.flush()
        self.in_link = 0
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()
        self.node = self.stack[-1]

    def pop(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the nearest open node with one of the tags, if it is open below ``until``."""
        stack = self.stack
        low = max(0, len(stack) - 9)
        for depth in range(len(stack) - 1, low, -1):
            tag = stack[depth].tag
            if tag in tags:
                return self.close(depth)
            if tag in until:
                return
        if low:  # deep nesting: from the depths of open tags
            nearest = max((d for t in tags for d in self.open.get(t, ())[-1:]), default=0)
            if nearest > max((d for t in until for d in self.open.get(t, ())[-1:]), default=0):
                self.close(nearest)

    def tag_at(self, source: str, at: int) -> tuple[bool, str, str, int] | None:
        """(closing, tag, attributes, end) of the tag at a "<"; None if it is none, as a quote in it never ends."""
        if m := TAG.match(source, at):
            return bool(m["close"]), m["tag"].lower(), m["attrs"], m.end()
        if not (m := NAME.match(source, at)):
            return None
        if self.marks is None:  # places of all that may end a tag or begin a quote, once per page
            self.marks = {q: [x.start() for x in re.finditer(q, source)] for q in (">", '"', "'")}
        p, seen = m.end(), []
        while True:
            nearest = {q: places[k] for q, places in self.marks.items() if (k := bisect_left(places, p)) < len(places)}
            if not nearest:
                end = len(source)
                return bool(m["close"]), m["tag"].lower(), source[m.end():end], end
            q = min(nearest, key=nearest.get)
            if q == ">":
                return bool(m["close"]), m["tag"].lower(), source[m.end():nearest[q]], nearest[q] + 1
            if nearest[q] in self.dead:
                break  # from here an earlier tag found no end
            seen.append(nearest[q])
            places = self.marks[q]
            k = bisect_left(places, nearest[q] + 1)
            if k == len(places):
                break
            p = places[k] + 1
        self.dead.update(seen)
        return None

    def read(self, source: str) -> None:
        self.marks: dict[str, list[int]] | None = None
        self.dead: set[int] = set()
        at = search = 0
        while (p := source.find("<", search)) >= 0:
            if m := MARKUP.match(source, p):
                self.data(source[at:p])
                at = search = m.end()
                if m["cdata"]:
                    self.data(m["cdata"])
                continue
            if (found := self.tag_at(source, p)) is None:
                search = p + 1
                continue
            self.data(source[at:p])
            closing, tag, attrs, at = found
            search = at
            if closing:
                if tag == "a":
                    self.in_link = 0
                elif tag in ("p", "br"):
                    self.flush() if tag == "p" else self.text.append(" ")
                    self.pop({"p"}, CLOSES_P - {"p"})
                elif tag not in INLINE and tag not in ("html", "body"):
                    self.pop({tag}, {"table"} if tag in ("li", "div", "p") else frozenset())
                continue
            if tag in VOID:
                if tag == "hr":
                    self.pop({"p"}, CLOSES_P - {"p"})
                    self.flush()
                else:
                    self.text.append(" " if tag in ("br", "img", "input") else "")
                continue
            if tag in RAW:
                if attrs.rstrip().endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = search = end.end() if end else len(source)
                continue
            if tag == "a":
                self.in_link = 1
                continue
            if tag in INLINE or tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                self.pop({"p"}, CLOSES_P - {"p"})
            if tag in ENDS:
                self.pop(*ENDS[tag])
            self.push(tag, attrs)
        tail = source[at:]
        cut = tail.rfind("<")
        self.data(tail[:cut] if cut >= 0 and re.match(r"</?[A-Za-z!]", tail[cut:]) else tail)


def _settle_doubts(nodes: list[Node]) -> None:
    """Articles that are named like something else are left out if another article stands beside them, or if they are
    the only one and hold less text than the rest of the page."""
    doubts = [n for n in nodes if n.doubt]
    if not doubts:
        return
    chars: dict[Node, int] = {}
    sure: dict[Node, int] = {}  # articles without doubt at or below a node
    for node in reversed(nodes):  # children come after their parents
        chars[node] = (0 if node.junk else node.chars) + sum(chars[c] for c in node.children)
        sure[node] = (node.tag == "article" and not node.doubt and not node.junk) + sum(sure[c] for c in node.children)
    others = sure[nodes[0]]
    only = sum(n.tag == "article" and not n.junk for n in nodes) <= 1
    for node in doubts:
        inside = sure[node]
        if others - inside > 0 or not inside and (not only or chars[nodes[0]] > 2 * chars[node]):
            node.junk = True
    for node in nodes[1:]:
        node.junk = node.junk or node.parent.junk


def _best(nodes: list[Node]) -> Node | None:
    """The container with the most points after the discount for links."""
    for node in reversed(nodes):  # children come after their parents
        if node.junk:
            continue
        holder = node.parent if node.tag in PARAGRAPH and node.parent is not None else node
        for _, block in node.blocks:
            holder.points += 1 + block.count(",") + min(3, len(block) / 100)
        if node.parent is not None:
            node.parent.points += node.points / 2
    total = {}
    for node in reversed(nodes):  # children come after their parents
        own = [0, 0] if node.junk else [node.chars, node.link_chars]
        for child in node.children:
            own = [a + b for a, b in zip(own, total[child])]
        total[node] = own
    best, most = None, 0.0
    for node in nodes:
        if not node.junk and node.points > 0 and total[node][0]:
            node.points *= 1 - total[node][1] / total[node][0]
            if node.points > most:
                best, most = node, node.points
    return best


def main_text(source: str | None) -> str:
    if not source:
        return ""
    tree = Tree(source)
    _settle_doubts(tree.nodes)
    best = _best(tree.nodes)
    if best is None:
        return ""
    while best.parent is not None and best.tag in PARAGRAPH | {"table", "tbody", "thead", "tr", "ul", "ol", "dl"}:
        best = best.parent  # a list or table belongs to the text around it
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    chosen = [article or best]
    main = article
    while main is not None and main.tag != "main":
        main = main.parent
    node = chosen[0]
    while node is not main and node.parent is not None:
        for other in node.parent.children:
            if other is node or other.junk:
                continue
            chars = sum(len(b) for _, b in other.blocks)
            dense = other.tag in PARAGRAPH and chars and other.link_chars < chars / 4
            if dense or other.points >= max(10, chosen[0].points / 5):
                chosen.append(other)
        node.parent.blocks and chosen.append(Node("#text", None, 0, blocks=node.parent.blocks))
        if main is None:
            break
        node = node.parent
    found, todo = [], list(chosen)
    while todo:
        node = todo.pop()
        if not node.junk:
            found += node.blocks
            todo += node.children
    return "\n\n".join(text for _, text in sorted(found))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if none), n_chars (code points)."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
