"""Main text of web pages by wrapper induction.

Pages are parsed into trees of block elements. All different pages of a host are aligned by simple tree matching into one
tree, in groups whose trees are then merged; a text that at least half of the pages with its parent have at one node is
constant and belongs to the host's template, the other nodes are slots. Every page of the host is then aligned with its
template. Text in an article or main element is content, constant or not, but for what is marked there as something else, so
what is below one is not aligned, nor what is below a dropped element. On a page without an article, constant nodes go, and of the varying slots those inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments go too.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import discard, fields, materialize, shuffle_partitions, table

#: Share of the pages with its parent that a constant text needs (three pages at least), and share of a page's characters that
#: earlier pages of its group hold from which it counts as a copy of them and not as a page more.
CONSTANT, COPY = 0.5, 0.8
#: Pages of a host that one group holds before it is split, and hosts that are split at most: with more pages groups grow.
GROUP_PAGES, SPLIT_HOSTS = 1024, 50_000
#: Pages after which a group's tree loses the texts and nodes that less than one of RARE of them has.
PRUNE_EVERY, RARE = 16, 8
#: Elements nested deeper are placed beside each other.
DEPTH = 200
#: Two lists of children with more pairs are matched row by row over arrays, with so many pairs traced back at once.
LONG, CELLS = 9216, 1 << 26
#: Templates of so many bytes together are broadcast; larger ones are joined by host.
BROADCAST_BYTES = 16 << 20

# Fixed values of HTML: elements without content, raw text, blocks, and those whose content is no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul template".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg canvas object embed dialog menu title xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole class tokens or ids that mark what is no part of an article; of the second set only outside of one. Articles, main,
#: headings and what holds one of the first two or an h1 (but for what lies in an article itself) are not marked by a name.
DROPPED_NAMES = frozenset("nav navbar navigation menu menubar footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies breadcrumb breadcrumbs pagination pager search toolbar widget widgets skip outbrain taboola".split())
OUTSIDE_NAMES = frozenset("header masthead banner topbar top hero branding logo".split())
UNNAMED = frozenset("article main h1 h2 h3 h4 h5 h6".split())
#: What can stand in head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
CLOSES_P = BLOCK - {"head", "html", "body", "option", "optgroup"}
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']|["'](?=[^"']*>))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element of the block tree, or with tag `#` a text block."""

    __slots__ = ("tag", "text", "kind", "children", "texts")

    def __init__(self, tag: str, text: str = "", kind: str = ""):
        self.tag, self.text, self.kind, self.children, self.texts = tag, text, kind, [], {text: 1}


def _kind(tag: str, attributes: str) -> str:
    """`drop`, `outside` (dropped outside of an article), `article` or nothing; `named` and `named outside` by a name alone."""
    if tag in DROPPED:
        return "drop"
    kind, named = "article" if tag in ("article", "main") else "outside" if tag == "header" else "", ""
    if attributes and tag not in ("html", "body"):
        found: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), (a or b or c).lower())
        role = found.get("role", "").strip()
        if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or role in DROPPED_ROLES:
            return "drop"
        if role in ("main", "article"):
            kind = "article"
        if kind != "article" and tag not in UNNAMED:
            names = {*found.get("class", "").split(), found.get("id", "").strip()}
            named = "named" if names & DROPPED_NAMES else "named outside" if names & OUTSIDE_NAMES and not kind else ""
    return named or kind


def _settle(node: Node, inside: bool = False) -> bool:
    """Makes the kinds given by a name final; True if an article or an h1 is in what stays of the node."""
    holds = False
    for c in node.children:
        if c.tag == "#" or c.kind == "drop":
            continue
        within = _settle(c, inside or c.tag == "article" or c.kind == "article" and c.tag != "main")
        if c.kind.startswith("named"):
            kind = "outside" if c.kind == "named outside" else "drop"
            c.kind = "outside" if within and not inside and c.tag == "header" else "" if within and not inside else kind
        holds |= c.kind == "article" or c.tag == "h1" or c.kind != "drop" and within
    return holds


def parse(source: str) -> Node:
    """The block tree of a page: block elements and text blocks; inline elements give their text to the block around them."""
    root = Node("html")
    stack: list[tuple[str, Node, bool]] = [("html", root, False)]  # tag, node that gets children, is it inline
    texts: list[str] = []
    at, n = 0, len(source)

    def flush(to: Node) -> None:
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                to.children.append(Node("#", text))

    def pop_to(i: int) -> None:
        flush(stack[-1][1])
        del stack[i:]

    while at < n:
        token = _TOKEN.search(source, at)
        end = token.start() if token else n
        if end > at:
            piece = source[at:end]
            if stack[-1][0] == "head" and not piece.isspace():
                pop_to(len(stack) - 1)
            texts.append(html_lib.unescape(piece) if "&" in piece else piece)
        if not token:
            break
        at = token.end()
        closing, tag = token[1], token[2]
        if tag:
            tag = tag.lower()
            if tag == "body":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "head":
                        pop_to(i)
                        break
            elif stack[-1][0] == "head" and tag not in IN_HEAD:
                pop_to(len(stack) - 1)
            if tag == "br":
                texts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush(stack[-1][1])
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if not stack[i][2]:
                        break
            if tag in SIBLING:
                own, limit = SIBLING[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in own:
                        pop_to(i)
                        if tag != "tr":
                            break
                    elif stack[i][0] in limit:
                        break
            kind = _kind(tag, token[3])
            if tag in ("html", "body") and not kind:
                continue
            inline = tag not in BLOCK and kind not in ("drop", "named")
            if not inline and len(stack) > DEPTH and (kind != "drop" or stack[-1][1].kind == "drop"):
                flush(stack[-1][1])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else n
                elif not token[0].endswith("/>"):
                    stack.append((tag, stack[-1][1], False))
                continue
            if inline:
                if not token[0].endswith("/>"):
                    stack.append((tag, stack[-1][1], True))
                continue
            parent = stack[-1][1]
            flush(parent)
            node = Node(tag, kind=kind)
            parent.children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else n
            elif not token[0].endswith("/>"):
                stack.append((tag, node, False))
        elif closing:
            tag = closing.lower()
            if tag in ("html", "body", "br"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if stack[i][2] and all(s[2] for s in stack[i:]):
                        del stack[i]
                    else:
                        pop_to(i)
                    break
                if not stack[i][2] and tag not in BLOCK:
                    break
    flush(stack[-1][1])
    _settle(root)
    return root


class Slot:
    """A node of a template under induction: how many pages had it, with which texts how often, and its children."""

    __slots__ = ("tag", "n", "texts", "children")

    def __init__(self, tag: str, n: int = 0):
        self.tag, self.n, self.texts, self.children = tag, n, {}, []


def page_slot(node: Node) -> Slot:
    """A page as a template of one page, without what its marks decide: what is below articles and dropped elements."""
    slot = Slot(node.tag, 1)
    if node.tag == "#":
        slot.texts[node.text] = 1
    elif node.kind not in ("article", "drop"):
        slot.children = [page_slot(c) for c in node.children]
    return slot


def _same(a, b) -> bool:
    """Whether two text nodes have a text in common."""
    x, y = a.texts, b.texts
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 1:
        (t,) = x
        return t in y
    return not x.keys().isdisjoint(y)


def _weight(x, y, known: dict) -> int:
    """The weight of the match of two nodes of one tag: 1 and that of what is below; a text in common weighs one more."""
    if x.tag == "#":
        return 1 + _same(x, y)
    if not x.children or not y.children:
        return 1
    key = (id(x), id(y))
    if (found := known.get(key)) is None:
        if len(x.children) == len(y.children) == 1:
            p, q = x.children[0], y.children[0]
            found = 1 + (_weight(p, q, known) if p.tag == q.tag else 0)
        else:
            found = 1 + size_of_match(x.children, y.children, known)
        known[key] = found
    return found


def _weights(a: list, b: list, known: dict) -> list[list[tuple[int, int]]]:
    """For each of a's nodes the places of b's nodes of its tag, and the weights of these pairs."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.tag, []).append(j)
    return [[(j, _weight(x, b[j], known)) for j in places.get(x.tag, [])] for x in a]


def _texts(node, found: set[str]) -> set[str]:
    """found with the texts of and below a node."""
    if node.tag == "#":
        found.update(node.texts)
    for c in node.children:
        _texts(c, found)
    return found


class LongLists:
    """The weights of all pairs of two long lists, a row of them at a time.

    Nodes without a text in common weigh what their shapes do, so one pair of two shapes stands for all such pairs; only
    pairs of nodes with a text in common are weighed one by one, and of equal nodes (but for texts that the other list has
    nowhere) one.
    """

    def __init__(self, a: list, b: list, known: dict):
        self.known, self.shapes, self.kinds, self.blind = known, {}, {}, {}
        below: list[list[set[str]]] = [[_texts(x, set()) for x in nodes] for nodes in (a, b)]
        self.common = set().union(*below[0]) & set().union(*below[1])
        (self.a, self.a_nodes, self.a_shape, self.a_texts), (self.b, self.b_nodes, self.b_shape, self.b_texts) = (self._sorted_out(*x) for x in zip((a, b), below, strict=True))
        self.holders: dict[str, list[int]] = {}
        for k, texts in enumerate(self.b_texts):
            for t in texts:
                self.holders.setdefault(t, []).append(k)
        self.by_tag: dict[str, dict[int, list[int]]] = {}
        for k, (node, shape) in enumerate(zip(self.b_nodes, self.b_shape, strict=True)):
            self.by_tag.setdefault(node.tag, {}).setdefault(shape, []).append(k)
        self.b_shapes, self.b_places = np.asarray(self.b_shape), np.asarray(self.b)
        self.rows: dict[int, np.ndarray] = {}

    def _ids(self, node) -> tuple[int, int]:
        """Numbers of a node's shape and of the node without the texts that only one list has."""
        below = [self._ids(c) for c in node.children]
        own = frozenset(self.common.intersection(node.texts)) if node.tag == "#" else None
        shape = self.shapes.setdefault((node.tag, tuple(x for x, _ in below)), len(self.shapes))
        return shape, self.kinds.setdefault((node.tag, own, tuple(x for _, x in below)), len(self.kinds))

    def _sorted_out(self, nodes: list, below: list[set[str]]):
        """For each node the number of its kind; for each kind a node, its shape and its texts that both lists have."""
        numbers: dict[int, int] = {}
        kind, first, shapes, texts = [], [], [], []
        for node, own in zip(nodes, below, strict=True):
            shape, k = self._ids(node)
            if k not in numbers:
                numbers[k] = len(first)
                first.append(node)
                shapes.append(shape)
                texts.append(own & self.common)
            kind.append(numbers[k])
        return kind, first, shapes, texts

    def row(self, i: int) -> np.ndarray:
        """The weights of a's i-th node with all of b's; 0 for those of other tags."""
        k = self.a[i]
        if (found := self.rows.get(k)) is None:
            node, shape, size = self.a_nodes[k], self.a_shape[k], len(self.shapes)
            sharing = {j for t in self.a_texts[k] for j in self.holders.get(t, ()) if self.b_nodes[j].tag == node.tag}
            blind = self.blind.setdefault(shape, np.zeros(size, np.int64))
            for other, kinds in self.by_tag.get(node.tag, {}).items():
                if not blind[other] and (j := next((j for j in kinds if j not in sharing), None)) is not None:
                    blind[other] = _weight(node, self.b_nodes[j], self.known)
            weights = blind[self.b_shapes]
            for j in sharing:
                weights[j] = _weight(node, self.b_nodes[j], self.known)
            found = weights[self.b_places]
            if len(self.rows) > 256:
                self.rows.clear()
            self.rows[k] = found
        return found

    def totals(self, rows, lo: int, hi: int, back: bool = False, marks: list | None = None) -> np.ndarray:
        """The greatest weights of the rows with the first 0, 1, ... of b's nodes lo to hi, or with back the last ones. marks
        gets, of each row, where the total is that of the row before and where it is that of one node less."""
        best = np.zeros(hi - lo + 1, np.int64)
        for i in rows:
            own = self.row(i)[lo:hi]
            step = best[:-1] + (own[::-1] if back else own)
            np.maximum(step, best[1:], out=step)
            np.maximum.accumulate(step, out=step)
            if marks is not None:
                marks.append((np.packbits(step == best[1:]), np.packbits(step == np.append(0, step[:-1]))))
            best[1:] = step
        return best

    def pairs(self, first: int, last: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """The pairs of a match of greatest weight of a's nodes first to last with b's nodes lo to hi."""
        if first >= last or lo >= hi:
            return []
        if last - first > 1 and (last - first) * (hi - lo) > CELLS:
            middle = (first + last) // 2
            both = self.totals(range(first, middle), lo, hi) + self.totals(range(last - 1, middle - 1, -1), lo, hi, back=True)[::-1]
            cut = lo + int(both.argmax())
            return self.pairs(first, middle, lo, cut) + self.pairs(middle, last, cut, hi)
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        self.totals(range(first, last), lo, hi, marks=marks)
        out, i, j = [], last - first - 1, hi - lo - 1
        while i >= 0 and j >= 0:
            above, left = (bits[j >> 3] >> (7 - (j & 7)) & 1 for bits in marks[i])
            if above:
                i -= 1
            elif left:
                j -= 1
            else:
                out.append((first + i, lo + j))
                i, j = i - 1, j - 1
        return out[::-1]


def match(a: list, b: list, known: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: the pairs of an order-preserving match of greatest weight.

    Long lists are matched by LongLists, as whole as short ones. known keeps the weights of pairs of nodes while neither
    changes.
    """
    if not a or not b:
        return []
    if len(a) * len(b) > LONG:
        return LongLists(a, b, {} if known is None else known).pairs(0, len(a), 0, len(b))
    # best chains by their last column: columns ascending, totals ascending, each with the pair before it
    columns, totals, ends = [], [], []
    for i, row in enumerate(_weights(a, b, {} if known is None else known)):
        found = []
        for j, w in row:
            k = bisect_left(columns, j)
            found.append((j, w + (totals[k - 1] if k else 0), (i, j, ends[k - 1] if k else None)))
        for j, total, end in found:
            at = _place(columns, totals, j, total)
            if at:
                columns[at], totals[at], ends[at] = [j], [total], [end]
    pairs, at = [], ends[-1] if ends else None
    while at:
        i, j, at = at
        pairs.append((i, j))
    return pairs[::-1]


def _place(columns: list[int], totals: list[int], j: int, total: int) -> slice | None:
    """What a chain that ends at column j takes the place of among the best ones; None if one is as good."""
    k = bisect_left(columns, j)
    if (k and totals[k - 1] >= total) or (k < len(columns) and columns[k] == j and totals[k] >= total):
        return None
    hi = k
    while hi < len(columns) and totals[hi] <= total:
        hi += 1
    return slice(k, hi)


def size_of_match(a: list, b: list, known: dict | None = None) -> int:
    """The weight of match(a, b)."""
    if not a or not b:
        return 0
    if len(a) * len(b) > LONG:
        return int(LongLists(a, b, {} if known is None else known).totals(range(len(a)), 0, len(b))[-1])
    columns, totals = [], []
    for row in _weights(a, b, {} if known is None else known):
        for j, total in [(j, w + (totals[k - 1] if (k := bisect_left(columns, j)) else 0)) for j, w in row]:
            at = _place(columns, totals, j, total)
            if at:
                columns[at], totals[at] = [j], [total]
    return totals[-1] if totals else 0


def merge(slot: Slot, other: Slot, known: dict | None = None) -> None:
    """Adds other's pages to slot: matched nodes are one, the others stand beside each other in order."""
    known = {} if known is None else known
    slot.n += other.n
    for text, n in other.texts.items():
        slot.texts[text] = slot.texts.get(text, 0) + n
    pairs = dict((j, i) for i, j in match(slot.children, other.children, known))
    merged, at = [], 0
    for j, child in enumerate(other.children):
        if j in pairs:
            merged += slot.children[at : pairs[j] + 1]
            at = pairs[j] + 1
            merge(merged[-1], child, known)
        else:
            merged.append(child)
    slot.children = merged + slot.children[at:]


def pruned(slot: Slot, least, rare: float, parent: int | None = None) -> Slot | None:
    """slot with the texts that least(pages with the text, pages with the parent) keeps, and the nodes of `rare` pages or more
    that hold any; None if none."""
    parent = slot.n if parent is None else parent
    out = Slot(slot.tag, slot.n)
    out.texts = {t: n for t, n in slot.texts.items() if least(n, parent)}
    out.children = [c for c in (pruned(c, least, rare, slot.n) for c in slot.children if c.n >= rare) if c]
    return out if out.texts or out.children else None


def constant_part(slot: Slot, constant: float = CONSTANT) -> Slot | None:
    """What is constant; nodes that less than one of RARE pages has are no layout of the host's."""
    return pruned(slot, lambda n, parent: n >= max(3, constant * parent), slot.n / RARE)


def frequent_part(slot: Slot) -> Slot:
    """slot without the texts and nodes of less than one of RARE pages; what is constant in all has more."""
    return pruned(slot, lambda n, parent: RARE * n >= parent, slot.n / RARE) or Slot(slot.tag, slot.n)


def _blocks(node: Node):
    """The texts of a page outside of what its marks drop."""
    for c in node.children:
        if c.tag == "#":
            yield c.text
        elif c.kind != "drop":
            yield from _blocks(c)


class Induction:
    """The tree of a group's pages; a page that is a near copy of earlier ones counts for nothing."""

    def __init__(self):
        self.tree, self.seen, self.added = Slot("html"), set(), 0

    def add(self, page: Node) -> None:
        own = [(hash(t), len(t)) for t in _blocks(page)]
        known = sum(n for h, n in own if h in self.seen)
        if self.added and own and known >= COPY * sum(n for _, n in own):
            return
        self.seen.update(h for h, _ in own)
        merge(self.tree, page_slot(page))
        self.added += 1
        if self.added % PRUNE_EVERY == 0:
            self.tree = frequent_part(self.tree)


def induce(pages: list[Node]) -> Slot | None:
    """The constant nodes of the pages' common tree with their ancestors; None if there are none."""
    found = Induction()
    for page in pages:
        found.add(page)
    return constant_part(found.tree)


def dump(slot: Slot) -> list:
    return [slot.tag, slot.n, slot.texts, [dump(c) for c in slot.children]]


def revive(x: list) -> Slot:
    slot = Slot(x[0], x[1])
    slot.texts = x[2]
    slot.children = [revive(c) for c in x[3]]
    return slot


def constant_nodes(template: Slot | None, page: Node, found: set[int], known: dict | None = None) -> None:
    """Adds the id() of the page's text blocks that align with constant nodes of the template."""
    if template is None:
        return
    known = {} if known is None else known
    for i, j in match(template.children, page.children, known):
        slot, node = template.children[i], page.children[j]
        if node.tag == "#":
            if node.text in slot.texts:
                found.add(id(node))
        else:
            constant_nodes(slot, node, found, known)


def _has(node: Node, kind: str) -> bool:
    for c in node.children:
        if c.kind != "drop" and (c.kind == kind or _has(c, kind)):
            return True
    return False


def main_text(source: str, template: Slot | None = None) -> str:
    """The text blocks of the page's article, or without one the varying blocks that no mark drops, joined by blank lines."""
    page = parse(source)
    only_article = _has(page, "article")
    constant: set[int] = set()
    if not only_article:
        constant_nodes(template, page, constant)
    out: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        for c in node.children:
            if c.tag == "#":
                if (inside or not only_article) and id(c) not in constant:
                    out.append(c.text)
            elif c.kind != "drop" and not (c.kind == "outside" and not inside):
                walk(c, inside or c.kind == "article")

    walk(page, False)
    return "\n\n".join(out)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template JSON) of pages (host, html), induced from all different htmls; a host without constant nodes has no row.

    Equal htmls are left out before the exchange as far as a task sees them, and after it altogether. A host of more than
    GROUP_PAGES pages is split into groups by hash; their trees are merged in two rounds. A group is read page by page.
    """
    spark = pages.sparkSession
    live = pages.where(F.col("html").isNotNull()).select("host", "html", F.xxhash64("html").alias("h"))
    counted = materialize(live.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    room = max(GROUP_PAGES, total // SPLIT_HOSTS)
    split = spark.sparkContext.broadcast({r["host"]: -(-r["n"] // room) for r in counted.where(F.col("n") > room).collect()})
    discard(counted)

    def spread(batches):
        seen: set[tuple] = set()
        for batch in batches:
            keep, groups = [], []
            for i, key in enumerate(zip(batch.column("host").to_pylist(), batch.column("h").to_pylist(), strict=True)):
                if key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    keep.append(i)
                    groups.append(key[1] % split.value.get(key[0], 1))
            kept = [c.take(pa.array(keep, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(groups, pa.int64())], names=[*batch.schema.names, "g"])

    def grow(batches):
        at, last, found = None, None, Induction()
        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("host", "g", "h", "html")), strict=True):
                if own[:2] != at:
                    if at and found.added:
                        yield row(*at, found.tree)
                    at, last, found = own[:2], None, Induction()
                if own[2] != last:
                    last = own[2]
                    found.add(parse(own[3]))
        if at and found.added:
            yield row(*at, found.tree)

    def row(own: str, g: int, tree: Slot):
        tree = frequent_part(tree) if own in split.value else constant_part(tree)
        data = [json.dumps(dump(tree))] if tree else []
        return pa.RecordBatch.from_arrays([pa.array([own][: len(data)], pa.string()), pa.array([g][: len(data)], pa.int64()), pa.array(data, pa.string())], names=["host", "g", "tree"])

    dealt = live.mapInArrow(spread, "host string, html string, h long, g long").repartition(shuffle_partitions(spark), "host", "g")
    trees = dealt.sortWithinPartitions("host", "g", "h").mapInArrow(grow, "host string, g long, tree string")
    trees = materialize(trees, "trees")
    whole = trees.where(~F.col("host").isin(*split.value) if split.value else F.lit(True)).select("host", F.col("tree").alias("template"))
    if not split.value:
        return whole

    def joined(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values("g")
            tree = revive(json.loads(rows["tree"].iloc[0]))
            for other in rows["tree"].iloc[1:]:
                merge(tree, revive(json.loads(other)))
                tree = frequent_part(tree)
            tree = constant_part(tree) if last else tree
            found = [(pdf["host"].iloc[0], int(rows["g"].iloc[0]), json.dumps(dump(tree)))] if tree else []
            return pd.DataFrame(found, columns=["host", "g", "tree"], dtype=object)

        return run

    parts = trees.where(F.col("host").isin(*split.value)).withColumn("part", F.floor(F.col("g") / 128))
    once = parts.groupBy("host", "part").applyInPandas(joined(False), "host string, g long, tree string")
    merged = once.groupBy("host").applyInPandas(joined(True), "host string, g long, tree string")
    return whole.unionByName(merged.select("host", F.col("tree").alias("template")))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without html and with `text`, columns so named replaced: the main text of every page.

    A null html is the empty page and gives the empty text; a null or odd url is of the host ''. A page that is all of its
    host's pages, or one of two, has no template and is cut by its elements alone. Repeated rows stay repeated; further columns
    stay; an empty table gives no rows. Elements nested deeper than DEPTH are read as if beside each other.
    """
    kept = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(*kept, F.col(html).alias("html"), host(F.col(url)).alias("host"))
    found = materialize(templates(rows.select("host", "html")), "templates")
    size = found.agg(F.sum(F.octet_length("template") + 64)).first()[0] or 0
    schema = fields(pages.select(*kept), "text string")
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})
        discard(found)
        rows = rows.withColumn("template", F.lit(None).cast("string"))
    else:
        shared = None
        rows = rows.join(found, "host", "left")

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for own, source, joined in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                if own not in known:
                    raw = joined if shared is None else shared.value.get(own)
                    if len(known) > 1000:
                        known.clear()
                    known[own] = revive(json.loads(raw)) if raw else None
                texts.append(main_text(source, known[own]) if source else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, schema)


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; null html gives the empty text, null and repeated ids stay."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
