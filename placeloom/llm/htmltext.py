"""Main text of web pages by wrapper induction.

First pass: every page becomes a tree of its blocks, and the trees of a host are aligned by simple
tree matching and merged into one template.  Siblings of one label and shape are one slot (a
repeat group).  A slot counts its pages, the pages of each of its texts, and how much of its text
is links.  Counts of texts are lossy in a bounded way: one is forgotten only while it is on at most
``LOST`` of the slot's pages.  Merging needs bounded memory, so templates are folded within each
task, then by host and salt, then by host.

A text is constant (part of the template) if its slot has it on nearly all pages that reach the
container, with ``least`` different page contents; copies of one page are one content, so hosts
with fewer contents have no constants and only marks decide there.  From the template a wrapper is
induced: the innermost container that holds all other text, the constant texts, and the slots
outside articles that are menus (three links or more, and little else, page after page).

Second pass: each page gives the blocks below its host's container without constant texts, menus,
blocks that a constant heading names as comments and the like, and what is never main text (marked
menus, forms, scripts...).  Tags are read in one linear scan; there is no limit on depth, children
or pages.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import batches_of, materialize

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: What a tag holds after its name; a ">" inside quotes doesn't end it.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, looked for up to the nearest of the barriers.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "body": {"html"}}
NEVER = frozenset("head nav header footer aside form button select input dialog menu svg canvas object audio video map".split())
#: Words in a class, id or role that mark what is not main text.
NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo cookie cookies "
    "consent banner notice notices alert comment comments reply replies respond disqus share sharing social newsletter subscribe subscription popup modal "
    "login signup search widget toolbar pagination pager copyright complementary contentinfo related recommended".split()
)
NEGATIONS = frozenset("has with no without".split())
CONTAINERS = frozenset("html body div main article section table tbody tr td center #root".split())
NAME = re.compile(r"[a-z]+")
#: A constant text of one of these words, alone or in a short heading, names what follows it in its block.
HEADINGS = frozenset("comments comment replies related advertisement sponsored newsletter kommentare anzeige werbung verwandte commentaires publicité comentarios publicidad relacionados".split())
#: Elements that may be dropped as a whole for their heading.
SECTIONS = frozenset("div section ul ol dl table details fieldset".split())


def role_of(tag: str, attributes: str) -> str:
    """A node's label: its tag, and the noise words among its names (a small closed set)."""
    if not attributes or tag in ("html", "body", "main", "article"):
        return tag
    found = set()
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = NAME.findall(name)
            if not NEGATIONS.intersection(parts):
                found.update(NOISE.intersection(parts))
    if HIDDEN.search(attributes):
        found.add("hidden")
    return ".".join([tag, *sorted(found)]) if found else tag


def noise(label: str) -> bool:
    """Whether nothing below a node so labelled is main text."""
    return "." in label or label in NEVER


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of each tag in page order; names are empty for comments and the like.

    Linear: without a ">" further on nothing is a tag, and after quotes that don't close by the
    end of the page quotes are ordinary characters.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            m = COMMENT.match(page, lt)
            yield lt, m.end(), "", "", m[1] or ""
            at = m.end()
        elif lt < last and (m := TAG.match(page, lt)):
            rest = REST.match(page, m.end()) if quotes else None
            quotes = quotes and rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            name = m[2].lower()
            yield lt, end, m[1], name, page[m.end() : end - 1]
            at = end
            if not m[1] and name in RAW_END:
                e = RAW_END[name].search(page, at)
                yield at, (at := e.end() if e else len(page)), "", "", ""
        else:
            at = lt + 1


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', s, ''), ('open', tag, label) and ('close', tag, label) in page order; every open is closed.

    Elements that the page leaves open are closed where a browser would: a paragraph by the next
    block, list items and cells by their like, everything by the end of what holds it.
    """
    stack: list[tuple[str, str]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a tag
    blocks: list[int] = []
    labels: dict[tuple[str, str], str] = {}
    at = 0

    def down_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            t, label = stack.pop()
            places[t].pop()
            if t in BLOCK:
                blocks.pop()
            yield "close", t, label

    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            yield "text", page[at:start], ""
        at = end
        if not tag:
            if attributes:
                yield "text", entities.escape(attributes), ""
            continue
        if closing:
            if places.get(tag):
                yield from down_to(places[tag][-1])
            elif tag == "p":
                yield "open", "p", "p"
                yield "close", "p", "p"
            continue
        if tag in RAW_END:
            continue
        if tag in VOID:
            if tag == "hr":
                yield "open", "hr", "hr"
                yield "close", "hr", "hr"
            elif tag == "br":
                yield "text", " ", ""
            continue
        if tag in BLOCK and blocks and stack[blocks[-1]][0] == "p":
            yield from down_to(blocks[-1])
        if tag in ENDS:
            barrier = max([places[t][-1] for t in BARRIERS[tag] if places.get(t)], default=-1)
            beyond = [p[k] for t in ENDS[tag] if (p := places.get(t)) and (k := bisect_right(p, barrier)) < len(p)]
            if beyond:
                yield from down_to(min(beyond))
        label = labels.get((tag, attributes))
        if label is None:
            label = labels[(tag, attributes)] = role_of(tag, attributes)
        yield "open", tag, label
        if attributes.endswith("/") and tag not in BLOCK:
            yield "close", tag, label
        else:
            if tag in BLOCK:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, label))
    if at < len(page):
        yield "text", page[at:], ""
    yield from down_to(0)


def tidy(parts: list[str]) -> str:
    """Text with character references decoded and each run of white space made one space."""
    s = "".join(parts)
    return " ".join((entities.unescape(s) if "&" in s else s).split())


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


_paths: dict[tuple[int, str], int] = {}


def below(path: int, label: str) -> int:
    """The path of an element so labelled below ``path``, as a hash: as long for deep elements as for others."""
    known = _paths.get((path, label))
    if known is None:
        if len(_paths) > 100_000:
            _paths.clear()
        known = _paths[(path, label)] = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path)
    return known


ROOT = below(0, "#root")


class Outline:
    """The blocks of a page: elements in page order, and the runs of text between block boundaries."""

    def __init__(self, page: str):
        self.labels, self.parents, self.paths, self.own, self.bad = ["#root"], [-1], [ROOT], [False], [False]
        #: (element, text, characters of links, number of links) of each run outside what is never main text
        self.runs: list[tuple[int, str, int, int]] = []
        here, parts, linked, links, quiet, anchors = 0, [], 0, 0, 0, 0
        for kind, tag, label in events(page):
            if kind == "text":
                if not quiet and not self.bad[here]:
                    parts.append(tag)
                    if anchors:
                        linked += len(tag.strip())
                continue
            if tag in BLOCK:
                if parts:
                    if text := tidy(parts):
                        self.runs.append((here, text, min(linked, len(text)), links))
                    parts, linked, links = [], 0, 0
                if kind == "open":
                    self.labels.append(label)
                    self.parents.append(here)
                    self.paths.append(below(self.paths[here], label))
                    self.own.append(self.own[here] or label in ("article", "main"))
                    self.bad.append(self.bad[here] or noise(label))
                    here = len(self.labels) - 1
                else:
                    here = self.parents[here]
            elif noise(label):
                quiet += 1 if kind == "open" else -1
            elif tag == "a":
                anchors += 1 if kind == "open" else -1
                links += kind == "open"
        if parts and (text := tidy(parts)):
            self.runs.append((here, text, min(linked, len(text)), links))

    def menus(self) -> list[bool]:
        """Whether each element is a menu: a block outside articles with links and little else."""
        n = len(self.labels)
        if sum(r[3] for r in self.runs) < MENU_LINKS:
            return [False] * n
        chars, linked, links = ([0] * n for _ in range(3))
        for k, text, a, b in self.runs:
            chars[k] += len(text)
            linked[k] += a
            links[k] += b
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            links[up] += links[k]
        return [k > 0 and not self.own[k] and links[k] >= MENU_LINKS and linked[k] >= MENU_SHARE * chars[k] for k in range(n)]


# A template node is a list: label, pages, children, texts, the largest count forgotten, own characters, of links, pages where it is a menu.
LABEL, PAGES, KIDS, TEXTS, FLOOR, CHARS, LINKED, MENU = range(8)
# texts: digest -> (pages counted, most pages that may have been forgotten before, the smallest keys of different page contents)
#: A text is constant on at least this share of the container's pages; one on NEARLY_ALL + LOST of them is found for sure.
NEARLY_ALL, LOST = 0.9, 0.05
#: So many different contents must hold a text before it can be constant, unless the caller says otherwise; as many keys are kept.
SUPPORT = 3
#: A menu has so many links, this share of its text is links, and it is one on this share of the container's pages.
MENU_LINKS, MENU_SHARE, MENU_PAGES = 3, 0.8, 0.8
#: So many scores of pairs of nodes are kept while two templates are merged; others are worked out again.
SCORES = 200_000


def shape(node: list) -> tuple:
    return node[LABEL], frozenset(k[LABEL] for k in node[KIDS])


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most node pairs of an order-keeping alignment of two trees."""
    if a[LABEL] != b[LABEL]:
        return 0
    if not a[KIDS] or not b[KIDS]:
        return 1
    key = (id(a), id(b))
    score = memo.get(key)
    if score is None:
        score = 1 + _score(a[KIDS], b[KIDS], memo)
        if len(memo) < SCORES:
            memo[key] = score
    return score


def _score(xs: list, ys: list, memo: dict, steps: list[bytearray] | None = None) -> int:
    """The score of the best alignment, the same method for few and many children: quadratic time, two rows of scores.

    ``steps`` gets how each cell came about, one byte each: 0 by aligning the two, 1 by leaving out the second, 2 the first.
    """
    above = [0] * (len(ys) + 1)
    for x in xs:
        row, last, step = [0], 0, bytearray(len(ys))
        label = x[LABEL]
        for j, y in enumerate(ys):
            w = match(x, y, memo) if label == y[LABEL] else 0
            by_pair, up = above[j] + w, above[j + 1]
            if last < up or last < by_pair:
                last = max(up, by_pair)
                step[j] = 0 if w and last == by_pair else 2
            else:
                step[j] = 0 if w and last == by_pair else 1
            row.append(last)
        above = row
        if steps is not None:
            steps.append(step)
    return above[-1]


def align(xs: list, ys: list, memo: dict) -> list[tuple[int, int]]:
    """(place in xs, place in ys) of the aligned children, in order."""
    steps: list[bytearray] = []
    _score(xs, ys, memo, steps)
    out = []
    i, j = len(xs), len(ys)
    while i and j:
        step = steps[i - 1][j - 1]
        if step != 1:
            i -= 1
        if step != 2:
            j -= 1
        if not step:
            out.append((i, j))
    return out[::-1]


def _merge_texts(a: list, b: list, pages: bool) -> None:
    mine, other = a[TEXTS], b[TEXTS]
    if not pages:
        for d, x in other.items():
            mine.setdefault(d, x)
        return
    if b[FLOOR]:
        for d, (n, lost, keys) in mine.items():
            if d not in other:
                mine[d] = (n, lost + b[FLOOR], keys)
    for d, (n, lost, keys) in other.items():
        x = mine.get(d)
        if x is None:
            mine[d] = (n, lost + a[FLOOR], keys)
        else:
            mine[d] = (x[0] + n, x[1] + lost, x[2] if x[2] == keys else tuple(sorted({*x[2], *keys})[:SUPPORT]))
    a[FLOOR] += b[FLOOR]


def _forget(node: list) -> None:
    """Texts on at most LOST of the node's pages are forgotten, once there are many."""
    most = int(LOST * node[PAGES])
    if most and len(node[TEXTS]) > 64:
        gone = [(d, n + lost) for d, (n, lost, _) in node[TEXTS].items() if n + lost <= most]
        for d, _ in gone:
            del node[TEXTS][d]
        node[FLOOR] = max([node[FLOOR], *[n for _, n in gone]])


def merge(a: list, b: list, memo: dict | None = None, pages: bool = True) -> list:
    """``b`` aligned with and folded into ``a`` (both of one label); ``pages``: counts add up, else b is a sibling of a's page."""
    a[PAGES] = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    a[CHARS] += b[CHARS]
    a[LINKED] += b[LINKED]
    a[MENU] = a[MENU] + b[MENU] if pages else max(a[MENU], b[MENU])
    if b[TEXTS] or b[FLOOR] or a[FLOOR]:
        _merge_texts(a, b, pages)
        _forget(a)
    xs, ys = a[KIDS], b[KIDS]
    if not ys:
        return a
    if not xs:
        a[KIDS] = ys
        return a
    if len(xs) == len(ys) and all(x[LABEL] == y[LABEL] for x, y in zip(xs, ys)):  # the usual case: nothing to align
        for x, y in zip(xs, ys):
            merge(x, y, memo, pages)
        return a
    memo = {} if memo is None else memo
    pairs = align(xs, ys, memo)
    taken = {j: i for i, j in pairs}
    # what the order keeps apart goes to a free slot of its label, so a template has no more slots of a label than a page
    free: dict[str, list[int]] = {}
    busy = set(taken.values())
    for i in range(len(xs) - 1, -1, -1):
        if i not in busy:
            free.setdefault(xs[i][LABEL], []).append(i)
    added: dict[int, list] = {}  # new slots by the place that they follow
    at = -1
    for j, y in enumerate(ys):
        i = taken.get(j)
        if i is not None:
            at = i
        elif free.get(y[LABEL]):
            i = free[y[LABEL]].pop()
        else:
            added.setdefault(at, []).append(y)
            continue
        merge(xs[i], y, memo, pages)
    a[KIDS] = [k for i in range(-1, len(xs)) for k in ([xs[i]] if i >= 0 else []) + added.get(i, [])] if added else xs
    return a


def _deep(levels: int) -> None:
    """Room for recursion over a tree so deep."""
    if sys.getrecursionlimit() < 4 * levels + 10_000:
        sys.setrecursionlimit(4 * levels + 10_000)


def page_tree(page: str) -> list:
    """The tree of the blocks of one page that hold text, with siblings of one label and shape as one slot."""
    seen = Outline(page)
    marks = [digest(text) for _, text, _, _ in seen.runs]
    key = (xxhash.xxh64_intdigest(b"".join(d.to_bytes(8, "big") for d in marks)),)
    nodes: list[list | None] = [None] * len(seen.labels)
    is_menu = seen.menus()
    for (k, text, linked, _), d in zip(seen.runs, marks):
        node = nodes[k]
        if node is None:
            node = nodes[k] = [seen.labels[k], 1, [], {}, 0, 0, 0, int(is_menu[k])]
        node[TEXTS][d] = (1, 0, key)
        node[CHARS] += len(text)
        node[LINKED] += linked
    height = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node is None:
            continue
        if len(node[KIDS]) > 1:
            slots: dict[tuple, list] = {}
            _deep(height[k])
            for x in reversed(node[KIDS]):
                s = shape(x)
                if s in slots:
                    merge(slots[s], x, None, pages=False)
                else:
                    slots[s] = x
            node[KIDS] = list(slots.values())
        up = seen.parents[k]
        if up >= 0:
            height[up] = max(height[up], height[k] + 1)
            if nodes[up] is None:
                nodes[up] = [seen.labels[up], 1, [], {}, 0, 0, 0, int(is_menu[up])]
            nodes[up][KIDS].append(node)
    _deep(height[0])
    return nodes[0] or ["#root", 1, [], {}, 0, 0, 0, 0]


def dump(tree: list) -> str:
    """A template as flat JSON, whatever its depth: nodes in order, each with its number of children."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        out.append([n[LABEL], n[PAGES], len(n[KIDS]), [[d, *x] for d, x in n[TEXTS].items()], *n[FLOOR:]])
        todo += reversed(n[KIDS])
    return json.dumps(out, separators=(",", ":"))


def load(s: str) -> list:
    root, open_, depth = None, [], 0
    for x in json.loads(s):
        node = [x[0], x[1], [], {d: (n, lost, tuple(keys)) for d, n, lost, keys in x[3]}, *x[4:]]
        if open_:
            open_[-1][0][KIDS].append(node)
            open_[-1][1] -= 1
        root = root or node
        open_.append([node, x[2]])
        depth = max(depth, len(open_))
        while open_ and not open_[-1][1]:
            open_.pop()
    _deep(depth)
    return root


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def constant_key(path: int, text: int) -> int:
    """One number for a text at a path."""
    return signed(xxhash.xxh64_intdigest(text.to_bytes(8, "big"), path))


def wrapper(template: list, least: int = SUPPORT) -> tuple[int, list[int], list[int]]:
    """(path of the container of the main text, keys of constant texts, paths of menus).

    From the root, a container is entered while it holds all text that is neither constant nor
    noise, down to an article or main element at most, so nothing else is left outside.  Nothing
    is constant where nothing varies, nor on hosts with under ``least`` (1 to 3) different contents.
    """

    def constant(x: tuple, pages: int) -> bool:
        return len(x[2]) >= least and x[0] >= NEARLY_ALL * pages

    def varies(node: list, pages: int) -> bool:
        return bool(node[FLOOR]) or any(not constant(x, pages) for x in node[TEXTS].values())

    def holds_main(node: list, pages: int) -> bool:
        todo = [node]
        while todo:
            n = todo.pop()
            if varies(n, pages):
                return True
            todo += n[KIDS]
        return False

    node, path = template, ROOT
    while node[LABEL] not in ("article", "main") and not varies(node, pages := node[PAGES]):
        kids = node[KIDS]
        holders = kids if len(kids) == 1 else [k for k in kids if holds_main(k, pages)]
        if len(holders) != 1 or holders[0][LABEL] not in CONTAINERS:
            break
        node = holders[0]
        path = below(path, node[LABEL])
    pages = node[PAGES]
    if not holds_main(node, pages):
        return signed(path), [], []
    constants: set[int] = set()
    menus, chars, linked = set(), 0, 0
    todo = [(template, ROOT)]
    while todo:
        n, p = todo.pop()
        constants.update(constant_key(p, d) for d, x in n[TEXTS].items() if constant(x, pages))
        if n[MENU] >= MENU_PAGES * pages:
            menus.add(p)
        chars += n[CHARS]
        linked += n[LINKED]
        todo += [(k, below(p, k[LABEL])) for k in n[KIDS]]
    if 2 * linked > chars:  # the text itself is links
        menus = set()
    return signed(path), sorted(constants), sorted(map(signed, menus))


def extract(page: str, container: int | None = None, constant: frozenset[int] | set[int] = frozenset(), menus: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of main text of a page under a wrapper.

    A page that doesn't have the container falls back on its own article or main elements, then
    on its whole body.
    """
    seen = Outline(page)
    n = len(seen.labels)
    inside = [False] * n
    dropped = list(seen.bad)
    if container is not None:
        for k in range(n):
            inside[k] = k > 0 and inside[seen.parents[k]] or signed(seen.paths[k]) == container
    runs = [(k, text, bool(constant) and constant_key(seen.paths[k], digest(text)) in constant) for k, text, _, _ in seen.runs]
    if menus:
        for k, is_menu in enumerate(seen.menus()):
            if is_menu and signed(seen.paths[k]) in menus:
                dropped[k] = True
    if constant:
        begun = [False] * n
        for k, text, is_constant in runs:
            named = is_constant and len(words := text.lower().split()) <= 4 and not HEADINGS.isdisjoint(w.strip(".:!") for w in words)
            while k > 0 and not begun[k]:  # the elements that this run begins
                begun[k] = True
                if named and seen.labels[k] in SECTIONS and signed(seen.paths[k]) != container and inside[seen.parents[k]]:
                    dropped[k] = True
                k = seen.parents[k]
    for k in range(1, n):
        dropped[k] = dropped[k] or dropped[seen.parents[k]]
    rest = [(k, text) for k, text, is_constant in runs if not dropped[k] and not (is_constant and inside[k])]
    return [t for k, t in rest if inside[k]] or [t for k, t in rest if seen.own[k]] or [t for _, t in rest]


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and anything without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, html: str = "html", salts: int = 64, held: int = 200_000) -> DataFrame:
    """host and template (flat JSON) of each host, from all its pages.

    A task folds pages into templates of at most about ``held`` texts before it emits them; two
    merges follow, by host and one of ``salts`` numbers and by host, so that no task gets a host's
    pages.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(known.items())
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([dump(t) for _, t in rows], pa.string())], names=["host", "template"])

        for b in batches:
            for h, page in zip(b.column(0), b.column(1)):
                tree = page_tree(page.as_py() or "")
                h = h.as_py()
                size += _texts(tree)
                known[h] = merge(known[h], tree) if h in known else tree
                if size >= held:
                    size = sum(map(_texts, known.values()))  # what repeated or was forgotten takes no room
                    if size >= held // 2:
                        yield out()
                        size = 0
        if known:
            yield out()

    def unite(t: pa.Table) -> pa.Table:
        total = None
        for x in t.column("template"):
            tree = load(x.as_py())
            total = merge(total, tree) if total else tree
        return pa.table({"host": [t.column("host")[0].as_py()], "template": [dump(total)]})

    parts = batches_of(pages.select(host(F.col("url")).alias("host"), F.col(html).cast("string").alias("html"))).mapInArrow(fold, "host string, template string")
    some = parts.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(salts))).groupBy("host", "salt").applyInArrow(lambda k, t: unite(t), "host string, template string")
    return some.groupBy("host").applyInArrow(lambda k, t: unite(t), "host string, template string")


def _texts(tree: list) -> int:
    n, todo = 0, [tree]
    while todo:
        x = todo.pop()
        n += 1 + len(x[TEXTS])
        todo += x[KIDS]
    return n


def extract_text(pages: DataFrame, html: str = "html", least: int = SUPPORT, **sizes: int) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, blocks (array of strings).

    text joins the blocks by newline; it is empty if there are none, and for null pages.  Pages
    without a host share the empty host's template.  Repeated rows are extracted each.  ``least``:
    different page contents (1 to 3) that a constant text needs; hosts with fewer have marks only.
    An empty table gives an empty result; other columns are not read.
    """

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = [wrapper(load(t.as_py()), least) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rules], pa.int64()), *[pa.array([r[k] for r in rules], pa.list_(pa.int64())) for k in (1, 2)]], names=["host", "container", "constant", "menus"]
            )

    rules = materialize(templates(pages, html, **sizes).mapInArrow(induce, "host string, container long, constant array<long>, menus array<long>"), "html-wrappers")
    kinds = dict(pages.dtypes)
    dealt = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col(html).cast("string").alias("html")).join(rules, "host", "left").select("page_id", "url", "html", "container", "constant", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [extract(p.as_py() or "", c.as_py(), set(k.as_py() or ()), set(m.as_py() or ())) for p, c, k, m in zip(*[b.column(k) for k in range(2, 6)])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["\n".join(x) for x in blocks], pa.string()), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "text", "blocks"])

    return batches_of(dealt).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, blocks array<string>")
