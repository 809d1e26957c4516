"""Main text of web pages by wrapper induction.

1. A page's DOM tree becomes its outline: siblings of equal key (element, classes and id, numbers made
   equal) that follow each other are one node, as are the equal kids of such a run. The text stays with the nodes.
2. Outlines are counted over all pages of a host. Its wrapper grows from all of them: each is aligned
   with it by simple tree matching, and what has no partner is inserted. A host of more than ``SHAPES``
   outlines grows in pieces of about as many, the most frequent first, and the pieces' wrappers grow together in rounds.
   In such a host what only one page has (a path of keys from the root) does not enter the wrapper: it is judged in
   its page, by the rules of 4, at the place where it would stand; its characters count at the nearest node both have.
3. Every outline is aligned with its host's wrapper, and all pages count at the wrapper's nodes: pages,
   characters, characters in links, lengths of runs, and how many pages hold which text there. Exact
   copies of a page count once.
4. Constant nodes are template: a text that stands at its node in at least ``ALIKE`` of the pages that
   have the node, and a node whose text is mostly links. A slot is a node whose text varies. A *region* is
   an element with a slot that repeats, more often in one page than in another. Slots are
   content if they are in a region, between two, in a container (below the body) with one, headings, or of some length: ``LEAD``
   characters a page on average, behind all regions ``TAIL``. The others, one short text in the page's frame, are not. In a region a text is
   template only if it stands in nearly every page (``ALWAYS``). A wrapper without regions has nothing but content slots.
5. Every page is aligned with the wrapper, and the text of its content slots goes out in page order.

Names only exclude: elements, classes and roles of menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments; within content only those of ``_STRICT``, and a paragraph, item or heading there only by a class of
just that name. Ids count as names, but tell no nodes apart unless they are such names: many are made from the page. A host without a wrapper (fewer than
three different pages), and a page that has none of its wrapper's regions, is left to names alone: the
elements and classes that name content, all of them, with the headings outside, or the whole page where none does.
A page that would lose more than half of its regions' text as constant (of its elements named as content, without
regions) is a copy with changes: it keeps that text.

Wrappers are broadcast up to ``MAX_HOSTS`` hosts and ``MAX_BYTES``, beyond it joined by host; a host
of a third of all pages then is a skewed join, which Spark splits.

Defined cases: a null or empty html gives an empty text; a null url or one without host has no wrapper;
repeated rows are extracted each; other columns are not read; an empty table gives an empty result. Nothing
recurses: elements nested 100,000 deep and texts of any length are read like others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .frames import mark, release, settle

#: Outlines (then wrappers of pieces) that grow together in one step; pages a text or wrapper needs at least; hosts that are broadcast.
SHAPES, LEAST, MAX_HOSTS = 64, 3, 20_000
#: Share of a node's pages that must hold a text for it to be template; share of a page's content below which its template stays.
ALIKE, COPY = 0.6, 0.5
#: Share of a region's pages that must hold a text for it to be template there; characters a page of a slot that is content outside regions, before and behind them.
ALWAYS, LEAD, TAIL = 0.95, 60, 120
#: Bytes of wrappers that are broadcast, at most; beyond, they are joined by host.
MAX_BYTES = 64 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that never hold main text, with names switched off too.
_NEVER = frozenset("script style noscript template iframe form button select option textarea input object dialog head title svg canvas xmp".split())
_GONE = frozenset("nav footer aside menu".split())
#: Names of what is not content, anywhere; and those that count outside of content only.
_STRICT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors comments disqus cookie cookies consent notice notices newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommended share sharing social popup modal pagination login signup".split()
)
_NAMED = _STRICT | frozenset("promo promotion banner side comment respond reply replies alert footer masthead overlay widget pager toolbar copyright search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WHOLE = frozenset(("html", "body", "main", "article"))
_BODY_NAMES = frozenset("content main article post entry story body text".split())
_KNOWN = _NAMED | _BODY_NAMES | {"header"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TOP = frozenset(("#root", "html", "body"))
#: Elements of one text.
_TEXTUAL = _HEADINGS | frozenset("p li dt dd blockquote pre td th caption figcaption".split())


class Node:
    """An element, or a text block (tag #). gone: 0 no, 1 excluded by name outside of content, 2 excluded by name, 3 never text."""

    __slots__ = ("tag", "key", "text", "links", "kids", "gone", "head", "at")

    def __init__(self, tag: str, key: str, text: str = "", links: int = 0, gone: int = 0, head: bool = False):
        self.tag, self.key, self.text, self.links, self.gone, self.head, self.at = tag, key, text, links, gone, head, 0
        self.kids: list[Node] = []


@lru_cache(4096)
def _element(tag: str, raw: str) -> tuple[str, int, bool]:
    """Key, gone and head of an element."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}
    names = html.unescape(f"{a.get('class', '')} {a.get('id', '')}").lower()
    split = lambda x: set(re.split(r"[\s_\-]+", x)) - {""}
    tokens = split(names)
    gone = 3 if tag in _NEVER else 2 if tag in _GONE else 0
    if tag not in _WHOLE or (tag == "article" and tokens & {"comment", "comments", "reply"}):
        gone = max(gone, 2 if (set(names.split()) if tag in _TEXTUAL else tokens) & _STRICT or tag == "article" and tokens & _NAMED else 1 if tokens & _NAMED or a.get("role", "").lower() in _ROLES else 0)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        gone = 3
    told = split(html.unescape(a.get("class", "")).lower()) | (tokens & _KNOWN)
    key = f"{tag}.{'.'.join(sorted({'0' if t.isdecimal() else t for t in told}))}" if told else tag
    return key, gone, tag == "header" or ("header" in tokens and tag not in _WHOLE)


def parse(source: str) -> Node:
    """The tree of block elements; text nodes (tag #) are blocks with references decoded and white space made one space."""
    root = Node("#root", "#root")
    stack, parts, links, linked = [root], [], 0, False
    open_: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                stack[-1].kids.append(Node("#", "#", text, min(links, len(text))))
            parts, links = [], 0

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(open_.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                cut(i)
                return
            if stack[i].tag in stop:
                return

    at, n, search = 0, len(source), _TOKEN.search
    while at < n:
        m = search(source, at)
        end = m.start() if m else n
        if end > at:
            parts.append(source[at:end])
            links += (end - at) * linked
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                linked = False
            elif tag not in _INLINE:
                flush()
                linked = False
                if open_.get(tag):
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    cut(i)
            continue
        if tag in _RAW:
            flush()
            at = _RAW[tag].search(source, at).end()
            continue
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif m[3] and ("class" in m[3] or "hidden" in m[3] or "style" in m[3]) and _element(tag, m[3])[1] > 1:
                at = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(source, at).end()
            elif tag == "a":
                linked = True
            continue
        flush()
        if tag in _VOID:
            continue
        if any(x.tag == "p" for x in stack[-3:]):
            close({"p"}, {"article", "body", "td", "li", "div"} - {tag} if tag == "p" else {"article", "body", "td"})
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        key, gone, head = _element(tag, m[3])
        node = Node(tag, key, gone=gone, head=head)
        stack[-1].kids.append(node)
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return root


class Tree:
    """Keys, parents and kids of numbered nodes, 0 the root."""

    def __init__(self, keys: list[str], parents: list[int]):
        self.keys, self.parents = keys, parents
        self.kids: list[list[int]] = [[] for _ in keys]
        for i, p in enumerate(parents[1:], 1):
            self.kids[p].append(i)
        self.known: tuple[dict[tuple, int], list[int], list[int]] | None = None

    def add(self, key: str, parent: int, place: int) -> int:
        self.known = None
        self.keys.append(key)
        self.parents.append(parent)
        self.kids.append([])
        self.kids[parent].insert(place, len(self.keys) - 1)
        return len(self.keys) - 1

    def order(self) -> list[int]:
        """All nodes, parents before kids, kids in their order."""
        out, stack = [], [0]
        while stack:
            i = stack.pop()
            out.append(i)
            stack.extend(reversed(self.kids[i]))
        return out

    def sizes(self) -> list[int]:
        size = [1] * len(self.keys)
        for i in reversed(self.order()[1:]):
            size[self.parents[i]] += size[i]
        return size

    def shapes(self, known: dict[tuple, int]) -> list[int]:
        """A number for each node; equal numbers, equal subtrees, also among trees numbered by the same `known`, which stays as it is."""
        shape, own = [0] * len(self.keys), {}
        for i in reversed(self.order()):
            s = (self.keys[i], *(shape[k] for k in self.kids[i]))
            n = known.get(s)
            shape[i] = own.setdefault(s, len(known) + len(own)) if n is None else n
        return shape

    def numbered(self) -> tuple[dict[tuple, int], list[int], list[int]]:
        """Numbers of this tree's subtrees, that of each node, and sizes; kept until it grows."""
        if self.known is None:
            shape = self.shapes({})
            self.known = {(k, *(shape[x] for x in kids)): n for k, kids, n in zip(self.keys, self.kids, shape)}, shape, self.sizes()
        return self.known

    def write(self) -> str:
        order = self.order()
        new = {old: i for i, old in enumerate(order)}
        return "\n".join(f"{new.get(self.parents[i], 0)} {self.keys[i]}" for i in order)

    @staticmethod
    def read(s: str) -> Tree:
        lines = [x.split(" ", 1) for x in s.split("\n")]
        return Tree([x[1] for x in lines], [int(x[0]) for x in lines])


def outline(root: Node) -> tuple[Tree, list[list[Node]]]:
    """The page's outline and the nodes of each of its nodes; each node's `at` is its place there. Numbered in page order."""
    keys, parents, members = [root.key], [-1], [[root]]
    stack = [(0, [root])]
    kids: list[list[int]] = [[]]
    while stack:
        i, mine = stack.pop()
        if len(mine) == 1:
            groups: list[list[Node]] = []
            for k in mine[0].kids:
                if groups and groups[-1][0].key == k.key:
                    groups[-1].append(k)
                else:
                    groups.append([k])
        else:
            by: dict[str, list[Node]] = {}
            for x in mine:
                for k in x.kids:
                    by.setdefault(k.key, []).append(k)
            groups = list(by.values())
        for g in groups:
            kids[i].append(len(keys))
            stack.append((len(keys), g))
            keys.append(g[0].key)
            parents.append(i)
            members.append(g)
            kids.append([])
    # number them in page order
    tree = Tree([], [])
    tree.keys, tree.parents, tree.kids = keys, parents, kids
    order = tree.order()
    new = [0] * len(order)
    for i, old in enumerate(order):
        new[old] = i
    tree = Tree([keys[i] for i in order], [new[parents[i]] if i else -1 for i in order])
    members = [members[i] for i in order]
    for i, group in enumerate(members):
        for x in group:
            x.at = i
    return tree, members


def align(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of node pairs of equal key that keeps order and ancestry, and the pairs, parents first.

    Equal subtrees are taken as wholes, at both ends of two lists of kids at once; the rest of the lists is searched, but for keys that only one has.
    """
    if a.keys[0] != b.keys[0]:
        return 0, []
    known, sa, size = a.numbered()
    sb = b.shapes(known)
    todo, visit = [], [(0, 0)]
    middle: dict[tuple[int, int], tuple[int, int, list[int], list[int]]] = {}
    while visit:
        p = visit.pop()
        if sa[p[0]] == sb[p[1]]:
            continue
        x, y = a.kids[p[0]], b.kids[p[1]]
        lo, top = 0, min(len(x), len(y))
        while lo < top and sa[x[lo]] == sb[y[lo]]:
            lo += 1
        hi = 0
        while hi < top - lo and sa[x[-1 - hi]] == sb[y[-1 - hi]]:
            hi += 1
        by: dict[str, list[int]] = {}
        for j in y[lo : len(y) - hi]:
            by.setdefault(b.keys[j], []).append(j)
        x = [i for i in x[lo : len(x) - hi] if a.keys[i] in by]
        both = {a.keys[i] for i in x}
        y = [j for j in y[lo : len(y) - hi] if b.keys[j] in both]
        middle[p] = (lo, hi, x, y)
        todo.append(p)
        visit.extend((i, j) for i in x for j in by[a.keys[i]])
    best: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def weight(i: int, j: int) -> int:
        return size[i] if sa[i] == sb[j] else best[i, j] if a.keys[i] == b.keys[j] else 0

    for p in reversed(todo):
        lo, hi, x, y = middle[p]
        rows = [[0] * (len(y) + 1)]
        for i in x:
            up, row, left = rows[-1], [0], 0
            for c, j in enumerate(y):
                left = max(left, up[c + 1], up[c] + weight(i, j))
                row.append(left)
            rows.append(row)
        tables[p] = rows
        kids = a.kids[p[0]]
        best[p] = 1 + rows[-1][-1] + sum(size[k] for k in kids[:lo]) + sum(size[k] for k in kids[len(kids) - hi :])
    pairs, visit = [], [(0, 0)]
    while visit:
        p = visit.pop()
        pairs.append(p)
        x, y = a.kids[p[0]], b.kids[p[1]]
        if sa[p[0]] == sb[p[1]]:
            visit.extend(zip(reversed(x), reversed(y)))
            continue
        lo, hi, mx, my = middle[p]
        found = list(zip(x[len(x) - hi :], y[len(y) - hi :]))[::-1]
        rows, i, j = tables[p], len(mx), len(my)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((mx[i], my[j]))
        found += list(zip(x[:lo], y[:lo]))[::-1]
        visit.extend(found)
    return weight(0, 0), pairs


def grow(wrapper: Tree, page: Tree) -> None:
    """Aligns the page's outline with the wrapper and inserts what has no partner, after its elder siblings."""
    of = {j: i for i, j in align(wrapper, page)[1]}
    for j in page.order()[1:]:
        if j in of:
            continue
        parent = of[page.parents[j]]  # parents come first: matched or inserted
        kids = page.kids[page.parents[j]]
        elder = next((of[k] for k in reversed(kids[: kids.index(j)]) if k in of), None)
        of[j] = wrapper.add(page.keys[j], parent, 0 if elder is None else wrapper.kids[parent].index(elder) + 1)


def induce(outlines: list[str]) -> str:
    """The wrapper of a host's outlines, the most frequent first."""
    wrapper = Tree.read(outlines[0])
    for s in outlines[1:]:
        grow(wrapper, Tree.read(s))
    return wrapper.write()


def _key(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def _outline_key(s: str) -> str:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Wrapper:
    """A wrapper with what all pages count at its nodes: stats of (node, pages, chars, links, fewest, most), texts that stand in most pages of their
    node (node, text key, whether in nearly all)."""

    def __init__(self, tree: str, stats: list[tuple], common: list[tuple[int, int, bool]]):
        self.tree = t = Tree.read(tree)
        n = len(t.keys)
        self.common = {(i, t) for i, t, _ in common}
        self.always = {(i, t) for i, t, always in common if always}
        self.maps: dict[str, list[int]] = {}
        order = t.order()
        chars, links, some = [0] * n, [0] * n, [0] * n
        fewest, most = [0] * n, [0] * n
        for i, pages, c, x, lo, hi in stats:
            chars[i], links[i], some[i], fewest[i], most[i] = c, x, pages, lo, hi
        own = [c / max(1, k) for c, k in zip(chars, some)]
        for i in reversed(order[1:]):
            chars[t.parents[i]] += chars[i]
            links[t.parents[i]] += links[i]
        # a text is mostly links at the node that holds it, and in any element around it
        linked = [2 * links[i] > chars[i] > 0 for i in range(n)]
        begins = [0] * n
        for at, i in enumerate(order):
            begins[i] = at
        sizes = t.sizes()
        repeats = [i for i in order[1:] if most[i] > fewest[i] and most[i] > 1 and chars[i] and not linked[i]]
        region, self.run = [False] * n, [False] * n
        for i in repeats:
            region[t.parents[i]] = self.run[i] = True
        for i in order[1:]:
            self.run[i] |= self.run[t.parents[i]]
        # where a region lies below a node
        holds = list(region)
        for i in reversed(order[1:]):
            holds[t.parents[i]] |= holds[i]
        self.regions = any(region)
        spans = [(begins[i], begins[i] + sizes[i]) for i in range(n) if region[i]]
        first, last = (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (0, n)
        self.inside, self.tight = [False] * n, [False] * n  # in a region; in one below the body
        tight = self.tight
        self.holds, self.first, self.last, self.begins, self.ends = holds, first, last, begins, [b + z for b, z in zip(begins, sizes)]
        self.content = [not self.regions] * n
        for i in order:
            p = t.parents[i] if i else i
            tag = t.keys[i].split(".", 1)[0]
            self.inside[i] = self.inside[p] or region[i]
            tight[i] = tight[p] or (region[i] and tag not in _TOP)
            if i and linked[i] and not tight[i]:
                self.content[i] = False
            elif self.regions:
                near = i and holds[p] and t.keys[p].split(".", 1)[0] not in _TOP
                self.content[i] = bool((self.inside[i] and (i == 0 or self.content[p] or not self.inside[p])) or (i and self.content[p]) or near or tag in _HEADINGS or (first <= begins[i] < last and not holds[i]) or self.long(tag, own[i], begins[i]))
            elif i:
                self.content[i] = self.content[p]

    def long(self, tag: str, chars: float, at: int) -> bool:
        """Whether a text block of so many characters a page, at this place, is content by its length."""
        return tag == "#" and chars >= (LEAD if at < self.last else TAIL)

    def of(self, page: Tree) -> list[int]:
        """The wrapper's node of each of the outline's nodes, or -1."""
        s = page.write()
        have = self.maps.get(s)
        if have is None:
            if len(self.maps) > 256:
                self.maps.clear()
            have = [-1] * len(page.keys)
            for i, j in align(self.tree, page)[1]:
                have[j] = i
            self.maps[s] = have
        return have

    def judged(self, page: Tree, members: list[list[Node]], of: list[int]) -> tuple[list[int], list[bool]]:
        """Of each of the outline's nodes, the wrapper's node it is or stands in, and whether it is content.

        A node without a partner is judged as the wrapper would judge it if it were inserted, with what its own page counts there.
        """
        near, content = list(of), [w >= 0 and self.content[w] for w in of]
        if -1 not in of:
            return near, content
        order = page.order()
        chars, links, spot = [sum(len(x.text) for x in g) for g in members], [sum(x.links for x in g) for g in members], [0] * len(of)
        for j in reversed(order[1:]):
            chars[page.parents[j]] += chars[j]
            links[page.parents[j]] += links[j]
        for p in order:
            mine, at = of[p] >= 0, self.begins[of[p]] + 1 if of[p] >= 0 else spot[p]
            for j in page.kids[p]:
                if of[j] >= 0:
                    at = self.ends[of[j]]
                    continue
                near[j], spot[j] = near[p], at
                w = near[j]
                if 2 * links[j] > chars[j] > 0 and not self.tight[w]:
                    content[j] = False
                elif self.regions:
                    beside = mine and self.holds[w] and self.tree.keys[w].split(".", 1)[0] not in _TOP
                    content[j] = content[p] or beside or page.keys[j].split(".", 1)[0] in _HEADINGS or self.first < at < self.last or self.long(page.keys[j], chars[j], at)
                else:
                    content[j] = content[p]
        return near, content


def _texts(root: Node, names: bool) -> Iterator[tuple[Node, bool, bool]]:
    """Text blocks that names do not exclude, in page order: the block, whether in an element that names content, whether in a heading."""
    stack = [(k, False, False, False) for k in reversed(root.kids)]
    while stack:
        k, held, heading, only = stack.pop()
        if k.tag == "#":
            if heading or not only:
                yield k, held, heading
            continue
        if k.gone == 3 or (names and (k.gone == 2 or (k.gone == 1 and not held))):
            continue
        if names and k.head:
            if not held:
                continue
            only = True
        held = held or k.tag in ("article", "main") or bool(k.key.count(".") and set(k.key.split(".")[1:]) & _BODY_NAMES)
        heading = heading or k.tag in _HEADINGS
        stack.extend((x, held, heading, only) for x in reversed(k.kids))


def extract(source: str | None, wrapper: Wrapper | None = None, names: bool = True) -> str:
    """The page's main text: its blocks joined by newlines, empty if there is none. names: whether names exclude."""
    if not source:
        return ""
    root = parse(source)
    texts = list(_texts(root, names))
    if wrapper is not None:
        tree, members = outline(root)
        of = wrapper.of(tree)
        near, content = wrapper.judged(tree, members, of)
        spots = [(k, of[k.at], near[k.at], held) for k, held, _ in texts]
        if not wrapper.regions or any(wrapper.inside[w] for _, _, w, _ in spots):
            # block, whether template, whether in a region, or where names say content if there is none
            slots = [(k, i >= 0 and (i, _key(k.text)) in (wrapper.always if wrapper.run[i] else wrapper.common), wrapper.inside[w] if wrapper.regions else held) for k, i, w, held in spots if content[k.at]]
            story = [(len(k.text), fixed) for k, fixed, core in slots if core]
            copy = sum(n for n, fixed in story if not fixed) < COPY * sum(n for n, _ in story)
            return "\n".join(k.text for k, fixed, core in slots if not fixed or (copy and core))
    if names and any(held for _, held, _ in texts):
        texts = [x for x in texts if x[1] or x[2]]
    return "\n".join(k.text for k, _, _ in texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page (host, page, html): its outline's key, and the outline (node null); of each node with text, and of each text, what counts there."""
    for b in A.pieces(batches, "html"):
        out = []
        for h, p, source in zip(*(b.column(c).to_pylist() for c in range(3))):
            tree, members = outline(parse(source))
            s = tree.write()
            k = _outline_key(s)
            out.append((h, k, p, s, None, 0, 0, 0, 0))
            for i, group in enumerate(members):
                texts = [x.text for x in group if x.tag == "#"]
                if texts or len(group) > 1 or i and tree.kids[i]:
                    out.append((h, k, p, None, i, 0, sum(map(len, texts)), sum(x.links for x in group), len(group)))
                out.extend((h, k, p, None, i, t, 0, 0, 0) for t in set(map(_key, texts)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)


_NAMES = ["h", "shape", "page", "outline", "node", "t", "chars", "links", "size"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([induce(b.column(2)[i].as_py())], pa.string())], names=["h", "piece", "wrapper"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, n, outline): a hash of the keys from the root to each node, with n where the outline has that path first, else 0."""
    for b in batches:
        for i in range(b.num_rows):
            tree, seen = Tree.read(b.column(3)[i].as_py()), set()
            path, pages = [0] * len(tree.keys), [0] * len(tree.keys)
            for j, key in enumerate(tree.keys):  # in page order: parents before kids
                path[j] = _key(f"{path[tree.parents[j]] if j else 0} {key}")
                if path[j] not in seen:
                    seen.add(path[j])
                    pages[j] = b.column(2)[i].as_py()
            n = len(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[i].as_py()] * n, pa.string()) for c in (0, 1)] + [pa.array(range(n), pa.int32()), pa.array(path, pa.int64()), pa.array(pages, pa.int64())], names=["h", "shape", "node", "path", "n"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, n, outline, nodes): the outline without these nodes and all below them."""
    for b in batches:
        out = []
        for h, n, s, gone in zip(*(b.column(c).to_pylist() for c in range(4))):
            if gone:
                tree, new, gone = Tree.read(s), {}, set(gone)
                keys, parents = [], []
                for j, p in enumerate(tree.parents):
                    if j not in gone and (j == 0 or p in new):
                        new[j] = len(keys)
                        keys.append(tree.keys[j])
                        parents.append(new[p] if j else -1)
                s = Tree(keys, parents).write()
            out.append((h, _outline_key(s), n, s))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["h", "shape", "n", "outline"])


def _grown(shapes: DataFrame) -> DataFrame:
    """h and wrapper of each host of shapes (h, shape, n, outline): the SHAPES most frequent outlines are its first piece, the others are dealt over as
    many pieces as they fill; the pieces' wrappers grow together, SHAPES at a time, until one is left."""
    place = F.row_number().over(W.partitionBy("h").orderBy(F.desc("n"), "shape"))
    first = shapes.select("h", "shape", "n").withColumn("place", place).filter(F.col("place") <= SHAPES).select("h", "shape", F.lit(0).cast("long").alias("piece"))
    sizes = shapes.groupBy("h").agg(F.ceil((F.count("*") - SHAPES) / SHAPES).alias("more"))
    rest = 1 + F.pmod(F.xxhash64("shape"), F.greatest(F.lit(1), "more"))
    rows = shapes.join(sizes, "h").join(first, ["h", "shape"], "left").select("h", F.coalesce("piece", rest).alias("piece"), F.struct((-F.col("n")).alias("o"), F.col("shape").alias("k"), "outline").alias("s"))
    while True:
        one = rows.groupBy("h", "piece").agg(F.sort_array(F.collect_list("s")).alias("s")).select("h", "piece", F.col("s.outline").alias("s"))
        made = settle(one.mapInArrow(_induce, "h string, piece long, wrapper string"), "grown")
        if not made.agg(F.max("piece")).first()[0]:
            return made.select("h", "wrapper")
        rows = made.select("h", F.floor(F.col("piece") / SHAPES).alias("piece"), F.struct(F.col("piece").alias("o"), F.lit("").alias("k"), F.col("wrapper").alias("outline")).alias("s"))


def _shared(shapes: DataFrame) -> DataFrame:
    """The outlines (h, shape, n, outline) without the paths that only one page of the host has, those that became equal as one."""
    paths = settle(shapes.select("h", "shape", "n", "outline").mapInArrow(_paths, "h string, shape string, node int, path long, n long"), "paths")
    lone = paths.groupBy("h", "path").agg(F.sum("n").alias("n")).filter("n = 1").select("h", "path")
    gone = paths.join(lone, ["h", "path"]).groupBy("h", "shape").agg(F.collect_list("node").alias("gone"))
    rows = shapes.join(gone, ["h", "shape"], "left").select("h", "n", "outline", "gone").mapInArrow(_without, "h string, shape string, n long, outline string")
    return settle(rows.groupBy("h", "shape").agg(F.sum("n").alias("n"), F.first("outline").alias("outline")), "shared-outlines")


def _placed(shapes: DataFrame, induced: DataFrame) -> DataFrame:
    """h, shape, node, wnode, own: the wrapper's node of each of the outline's nodes, or (own false) the one it stands in."""
    size, hosts = induced.agg(F.sum(F.octet_length("wrapper")), F.count("*")).first()
    shared = None
    rows = shapes.select("h", "shape", "outline").join(induced, "h")
    if hosts <= MAX_HOSTS and (size or 0) <= MAX_BYTES:
        shared = shapes.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in induced.collect()})
        rows = shapes.select("h", "shape", "outline")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Tree | None] = (None, None)
        for b in batches:
            for i in range(b.num_rows):
                h, k, s = (b.column(c)[i].as_py() for c in range(3))
                if h != last[0]:
                    w = b.column(3)[i].as_py() if shared is None else shared.value.get(h)
                    last = (h, w and Tree.read(w))
                if last[1] is None:
                    continue
                page = Tree.read(s)
                n = len(page.keys)
                at, own = [0] * n, [False] * n
                for w, j in align(last[1], page)[1]:
                    at[j], own[j] = w, True
                for j in range(1, n):
                    if not own[j]:
                        at[j] = at[page.parents[j]]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.string()), pa.array([k] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(at, pa.int32()), pa.array(own, pa.bool_())], names=["h", "shape", "node", "wnode", "own"])

    places = settle(rows.mapInArrow(run, "h string, shape string, node int, wnode int, own boolean"), "places")
    if shared is not None:
        shared.destroy()
    return places


def wrappers(rows: DataFrame) -> DataFrame:
    """h, wrapper, stats and common (node, text, whether nearly always) of each host of rows (page_id, html, host) with at least LEAST different pages."""
    held = rows.filter("host <> '' AND length(html) > 0").select("host", F.xxhash64("html").alias("page"), "html")
    counts = held.mapInArrow(_counts, "h string, shape string, page long, outline string, node int, t long, chars long, links long, size int")
    # copies of a page count once; after that only pages' numbers travel
    once = counts.groupBy("h", "shape", "node", "t", "page").agg(F.first("outline").alias("outline"), F.first("chars").alias("chars"), F.first("links").alias("links"), F.first("size").alias("size"))
    seen = settle(once.groupBy("h", "shape", "node", "t").agg(F.count("*").alias("n"), F.first("outline").alias("outline"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("size").alias("lo"), F.max("size").alias("hi")), "page-counts")
    shapes = seen.filter("node IS NULL").select("h", "shape", "n", "outline")
    hosts = shapes.groupBy("h").agg(F.sum("n").alias("pages"), F.count("*").alias("shapes")).filter(F.col("pages") >= LEAST)
    many = settle(hosts.filter(F.col("shapes") > SHAPES).select("h"), "many")
    induced = _grown(shapes.join(hosts.filter(F.col("shapes") <= SHAPES).select("h"), "h"))
    if not many.isEmpty():
        induced = settle(induced.unionByName(_grown(_shared(shapes.join(many, "h")))), "induced")
    at = seen.filter("node IS NOT NULL").drop("outline").join(_placed(shapes, induced), ["h", "shape", "node"]).filter("own OR t = 0")
    own = lambda c: F.when(F.col("own"), F.col(c)).otherwise(0)
    sums = (F.sum(own("n")).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min(F.when(F.col("own"), F.col("lo"))).alias("lo"), F.max(own("hi")).alias("hi"))
    at = at.groupBy("h", "wnode", "t").agg(*sums).withColumn("lo", F.coalesce("lo", F.lit(0)))
    at = settle(at.filter((F.col("t") == 0) | (F.col("n") >= LEAST)), "node-counts")
    nodes = at.filter("t = 0")
    stats = nodes.groupBy("h").agg(F.collect_list(F.struct("wnode", "n", "chars", "links", "lo", "hi")).alias("stats"))
    often = at.filter("t <> 0").select("h", "wnode", "t", F.col("n").alias("m")).join(nodes.select("h", "wnode", "n"), ["h", "wnode"]).filter(F.col("m") >= ALIKE * F.col("n"))
    common = often.groupBy("h").agg(F.collect_list(F.struct("wnode", "t", (F.col("m") >= ALWAYS * F.col("n")).alias("always"))).alias("common"))
    return induced.join(stats, "h", "left").join(common, "h", "left").select("h", "wrapper", "stats", "common")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)))
    begun = mark()
    made = settle(wrappers(rows.select("html", "host")), "wrappers")
    release(spark, begun, made)
    size, hosts = made.agg(F.sum(F.octet_length("wrapper") + 48 * F.coalesce(F.size("stats"), F.lit(0)) + 16 * F.coalesce(F.size("common"), F.lit(0))), F.count("*")).first()
    shared = None
    if hosts <= MAX_HOSTS and (size or 0) <= MAX_BYTES:
        shared = spark.sparkContext.broadcast({r[0]: (r[1], [tuple(x) for x in r[2] or ()], [tuple(x) for x in r[3] or ()]) for r in made.collect()})
        source = rows.select("page_id", "url", "html", "host")
    else:
        source = rows.join(made, rows.host == made.h, "left").select("page_id", "url", "html", "host", "wrapper", "stats", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper] = {}

        def wrapper(h: str, b: pa.RecordBatch, i: int) -> Wrapper | None:
            if h not in ready:
                if shared is not None:
                    parts = shared.value.get(h)
                else:
                    tree, stats, common = (b.column(c)[i].as_py() for c in (4, 5, 6))
                    parts = tree and (tree, [tuple(x.values()) for x in stats or ()], [tuple(x.values()) for x in common or ()])
                if not parts:
                    return None
                if len(ready) > 256:
                    ready.clear()
                ready[h] = Wrapper(*parts)
            return ready[h]

        for b in A.pieces(batches, "html"):
            out = [extract(page, wrapper(h, b, i)) for i, (page, h) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
