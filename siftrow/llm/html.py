"""Main text of web pages by wrapper induction.

Pages of one host are made from one template. Each page's DOM is reduced to a tree of elements in which neighbours of the
same kind are one repeated slot. Trees of the same host are aligned two by two with simple tree matching, which finds the
mapping of equal elements in equal order that maps most nodes; the merged tree keeps, for each node, how many pages have
it, its most frequent texts, how much text it holds and how much of that is links.

What is content is read off the aligned slots. A node with one text on most pages that have its parent is template, wherever
it stands, and that text is left out. Of the slots that vary, the one that holds most of the text, level by level, is the
main one; a slot beside it is content if it holds a good share as much text and few links, and so are headings. Inside the
main slot all is content but lists of links. Elements, roles and names (article, nav, class="comments") decide only where
the figures leave it open: which slot to descend into, and whether a slot beside the main one serves the page.

Trees are merged within tasks first, then over salted groups of a host, then over the host, so every page takes part and
no task holds more than trees, which have one node per kind of element however long the page is. Pages are not shuffled for
the induction. The finished templates are small; they are sent to all tasks if they are within a bound, and else each page
meets the tree of its host in a join, the pages of a host dealt over several tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.llm.bytes import prefix_hashes, span_hashes
from siftrow.llm.common import stored, work_folder

# Fixed values of the HTML standard, as this reader needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas head title select textarea button option".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "li", "dt", "dd", "caption", "tbody", "thead", "tfoot", "html", "body"}
# An element that a new one of the same group ends.
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Elements, roles and names that serve the page, where the figures do not tell.
SERVICE_TAGS = frozenset("nav footer aside form header dialog menu".split())
SERVICE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SERVICE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer header login menu menus nav navbar navigation newsletter notice notices pagination popup promo promoted related replies "
    "reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Never service, whatever their names.
MAIN_TAGS = frozenset({"article", "main"})
# Elements of running text, whose names say nothing.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dt dd td th tr figcaption figure caption body html page #text".split())
HEADINGS = frozenset({"h1", "h2", "hgroup"})
# What the tree tells of an element besides its figures.
SERVES, NAMED, MAIN = -2, -1, 1
# Elements whose text runs on through everything but blocks.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 dt figcaption caption summary".split())
# Elements that are part of the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
# A text on this share of the pages that have a node's parent makes the node template.
SHARE = 0.75
# Texts of a node that are counted; each page count is exact up to so many texts, and then short by at most a
# LEADING-th of the pages with other texts.
LEADING = 8
# Share of the text below a node that its main slot holds at least; share of the main slot's text that makes a slot beside
# it content; share that a slot inside has to reach to be content against its name.
DOMINANT, RICH, QUIET = 0.6, 0.25, 0.15
# Share of links that makes a slot beside the main one, or one inside it, a list of links.
LINKED, ONLY_LINKS = 0.5, 0.9
# Pages of a host that go into one group at first, and groups that are then merged by one task.
SALTS = 64
# Templates of up to so many characters in all are sent to every task.
SENT_CHARS = 64 << 20

SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "name", "hint", "children", "texts")

    def __init__(self, tag: str, name: str = "", hint: int = 0):
        self.tag, self.name, self.hint, self.children, self.texts = tag, name, hint, [], []


def hint_of(tag: str, attrs: dict[str, str | None]) -> int:
    """SERVES by element, role or being hidden, NAMED by a name, MAIN, or 0."""
    if tag in MAIN_TAGS:
        return MAIN
    if tag in SERVICE_TAGS or (attrs.get("role") or "").lower() in SERVICE_ROLES or "hidden" in attrs:
        return SERVES
    if tag in PLAIN or tag in INLINE:
        return 0
    named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
    return NAMED if any(w in SERVICE_NAMES for w in WORDS.findall(named)) else 0


class Reader(HTMLParser):
    """HTML to a tree. Texts are kept in page order among the children, as str."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in SAME_LEVEL:
            self._close(SAME_LEVEL[tag], SCOPE.get(tag, set()), deep=True)
        found = dict(attrs)
        node = Node(tag, " ".join(WORDS.findall(f"{found.get('class') or ''} {found.get('id') or ''}".lower())), hint_of(tag, found))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tags, stop, deep: bool = False):
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                del self.stack[i:]
                return
            if tag in stop or (deep and tag in ("body", "table") and tag not in tags):
                return

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def label(node: Node) -> str:
    return f"{node.tag}.{node.name}" if node.name else node.tag


class Part:
    """An element, or a run of text between elements, over the places first to last of an outline."""

    __slots__ = ("label", "first", "last", "children", "rest", "written", "hint")

    def __init__(self, name: str, first: int, hint: int = 0):
        self.label, self.first, self.last, self.children, self.hint = name, first, first, [], hint
        # Where the text since the last child begins, and whether there is any.
        self.rest, self.written = first, False

    def end_run(self, place: int) -> None:
        if self.written:
            run = Part("#text", self.rest)
            run.last = place
            self.children.append(run)
        self.rest, self.written = place, False


def outline(root: Node) -> tuple[list[str | None], list]:
    """The texts of a page in order (None where a block begins or ends), and the page's own tree.

    The tree: [label, first place, digest of the text, children, last place, size of the text, size of its links, hint].
    Neighbours with the same label are one node with the children of all. Text beside elements is a node of its own;
    inline elements are text, and what stands in them counts as if it stood around them. Text in a link counts as such
    unless the link goes around blocks. A header inside of article or main has no hint: its title is part of the text.
    """
    texts: list[str | None] = []
    linked: list[bool] = []
    page = Part("page", 0)
    open_parts = [page]
    todo: list[tuple[Iterator, bool, bool, bool, bool, bool]] = [(iter(root.children), False, False, False, False, False)]
    while todo:
        children, part, block, link, inner, running = todo[-1]
        child = next(children, todo)
        if child is todo:
            todo.pop()
            if block:
                texts.append(None)
                linked.append(False)
            if part or not todo:
                done = open_parts.pop()
                if done.children:
                    done.end_run(len(texts))
                done.last = len(texts)
                if open_parts:
                    open_parts[-1].rest = len(texts)
        elif isinstance(child, str):
            texts.append(child)
            linked.append(link)
            open_parts[-1].written = open_parts[-1].written or not child.isspace()
        elif child.tag == "br":
            texts.append(" ")
            linked.append(link)
        elif child.tag not in RAW:
            block = child.tag in BLOCKS
            part = block or not (running or child.tag in INLINE or child.tag in VOID)
            if part:
                open_parts[-1].end_run(len(texts))
                hint = 0 if inner and child.tag == "header" else child.hint
                open_parts.append(Part(label(child), len(texts), hint))
                open_parts[-2].children.append(open_parts[-1])
            if block:
                texts.append(None)
                linked.append(False)
            run_on = child.tag in RUNNING or (running and not block)
            todo.append((iter(child.children), part, block, child.tag == "a" or (link and not part), inner or child.hint == MAIN, run_on))

    # Digests without white space, so that each is a span of one array.
    bare = ["".join(t.split()).encode("utf-8", "replace") if t else b"" for t in texts]
    sizes = [len(x) for x in bare]
    ends = np.cumsum([0, *sizes])
    link_ends = np.cumsum([0, *(n if is_link else 0 for n, is_link in zip(sizes, linked, strict=True))])
    sums = prefix_hashes(np.frombuffer(b"".join(bare), np.uint8))
    tree = ["page", 0, None, [], len(texts), 0, 0, 0]
    nodes, below = [tree], [(page.children, tree[3])]
    while below:
        parts, out = below.pop()
        groups: list[list[Part]] = []
        for one in parts:
            if groups and groups[-1][0].label == one.label:
                groups[-1].append(one)
            else:
                groups.append([one])
        for group in groups:
            node = [group[0].label, group[0].first, None, [], group[-1].last, 0, 0, min(one.hint for one in group)]
            out.append(node)
            nodes.append(node)
            inner = [x for one in group for x in one.children]
            if inner:
                below.append((inner, node[3]))
    firsts, lasts = [n[1] for n in nodes], [n[4] for n in nodes]
    spans = span_hashes(sums, ends[firsts], ends[lasts]).tolist()
    size, links = (ends[lasts] - ends[firsts]).tolist(), (link_ends[lasts] - link_ends[firsts]).tolist()
    for node, *found in zip(nodes, spans, size, links, strict=True):
        node[2], node[5], node[6] = found
    return texts, tree


def tree_of(root: Node) -> list:
    """Template tree of one page: [label, pages, digest of the text or None if it varies, children, texts, size, links, hint].

    texts: the most frequent digests, each with its number of pages and the least and greatest digest of such a page. size
    and links are sums over the pages.
    """
    return _counted(outline(root)[1])


def _counted(tree: list) -> list:
    page = tree[2] >> 32
    top = [tree[0], 1, tree[2], [], {tree[2]: (1, page, page)}, *tree[5:]]
    todo = [(tree, top)]
    while todo:
        own, made = todo.pop()
        for child in own[3]:
            made[3].append([child[0], 1, child[2], [], {child[2]: (1, page, page)}, *child[5:]])
            todo.append((child, made[3][-1]))
    return top


def matching(a: list, b: list, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of sibling trees: the most nodes mapped, and the pairs that do it.

    known: results for lists of the same trees, by identity.
    """
    known = {} if known is None else known
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in known:
            todo.pop()
            continue
        below = [(p[3], q[3]) for p in x for q in y if p[0] == q[0] and p[3] and q[3] and (id(p[3]), id(q[3])) not in known]
        if below:
            todo.extend(below)
        else:
            known[id(x), id(y)] = _best(x, y, known)
            todo.pop()
    return known[id(a), id(b)]


def _best(a: list, b: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The matching of two lists when those of all lists below are known."""
    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            w = 0
            if a[i][0] == b[j][0]:
                w = 1 + (known[id(a[i][3]), id(b[j][3])][0] if a[i][3] and b[j][3] else 0)
            best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + w)
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[m][n], pairs[::-1]


def merge(a: list, b: list) -> list:
    """Both trees as one: matched nodes merged, the others side by side in their order."""
    known: dict = {}
    top = _both(a, b)
    todo = [(top, a[3], b[3])]
    while todo:
        node, x, y = todo.pop()
        if not x or not y:
            node[3] = x or y
            continue
        out, i, j = [], 0, 0
        for p, q in matching(x, y, known)[1]:
            out += x[i:p] + y[j:q]
            out.append(_both(x[p], y[q]))
            todo.append((out[-1], x[p][3], y[q][3]))
            i, j = p + 1, q + 1
        node[3] = out + x[i:] + y[j:]
    return top


def _both(a: list, b: list) -> list:
    """Two nodes as one, its children still to come."""
    texts = dict(a[4])
    for text, (n, low, high) in b[4].items():
        held = texts.get(text)
        texts[text] = (n + held[0], min(low, held[1]), max(high, held[2])) if held else (n, low, high)
    if len(texts) > LEADING:
        # Each text loses as many pages as the first that is left out has: one that leads keeps nearly all of its own.
        less = sorted((v[0] for v in texts.values()), reverse=True)[LEADING]
        texts = {k: (n - less, low, high) for k, (n, low, high) in texts.items() if n > less}
    same = a[2] if a[2] is not None and a[2] == b[2] else None
    return [a[0], a[1] + b[1], same, [], texts, a[5] + b[5], a[6] + b[6], min(a[7], b[7])]


def written(tree: list) -> str:
    """JSON of a tree as a flat list, each node before its children and with their number, so that depth has no limit."""
    flat, todo = [], [tree]
    while todo:
        node = todo.pop()
        rest = [[[k, *v] for k, v in x.items()] if isinstance(x, dict) else x for x in node[4:]]
        flat.append([*node[:3], len(node[3]), *rest])
        todo.extend(reversed(node[3]))
    return json.dumps(flat, separators=(",", ":"))


def read_tree(text: str) -> list:
    top: list = []
    todo = [(top, 1)]
    for name, pages, same, below, *rest in json.loads(text):
        while not todo[-1][1]:
            todo.pop()
        out, left = todo[-1]
        todo[-1] = (out, left - 1)
        out.append([name, pages, same, [], *({k: tuple(v) for k, *v in x} if isinstance(x, list) else x for x in rest)])
        todo.append((out[-1][3], below))
    return top[0]


def constant_text(node: list, parent_pages: int) -> int | None:
    """The text that makes a node template: on SHARE of the pages that have its parent, and not only on copies of one page."""
    return next((k for k, (n, low, high) in node[4].items() if low != high and n >= SHARE * parent_pages), None)


KEPT, LEFT_OUT, CENTRE = 0, 1, 2


def template_of(tree: list) -> list:
    """What the aligned tree says of each slot: [label, pages, constant text or None, children, verdict].

    The verdict is KEPT, LEFT_OUT, or CENTRE for the main slot; below, a child's own verdict and text go first.
    """
    top = [tree[0], tree[1], None, [], KEPT]
    todo, order = [(tree, top)], []
    while todo:
        node, made = todo.pop()
        order.append((node, made))
        for child in node[3]:
            made[3].append([child[0], child[1], constant_text(child, node[1]), [], KEPT])
            todo.append((child, made[3][-1]))
    # Text that varies and is not links, by node: what is constant below a node does not count for it.
    varying: dict[int, int] = {}
    fixed: dict[int, int] = {}
    for node, made in reversed(order):
        own = node[5] - node[6]
        fixed[id(node)] = own if made[2] is not None else sum(fixed[id(c)] for c in node[3])
        varying[id(node)] = max(0, own - fixed[id(node)])

    def mean(node: list) -> float:
        return varying[id(node)] / node[1]

    node, made = tree, top
    while True:
        open_ = [i for i, c in enumerate(node[3]) if c[7] >= 0]
        best = max(open_, key=lambda i: varying[id(node[3][i])], default=None)
        if best is None or not node[3][best][3] or not varying[id(node[3][best])]:
            break
        total = sum(varying[id(node[3][i])] for i in open_)
        if varying[id(node[3][best])] < DOMINANT * total:
            break
        main = mean(node[3][best])
        for i, (child, judged) in enumerate(zip(node[3], made[3], strict=True)):
            if i != best:
                judged[4] = KEPT if _beside(child, mean(child), main) else LEFT_OUT
                if judged[4] == LEFT_OUT and child[7] >= 0 and judged[2] is not None:
                    # Of constant slots only the constant text is known to be template.
                    judged[4] = KEPT
        node, made = node[3][best], made[3][best]
    made[4] = CENTRE
    for child, judged in zip(node[3], made[3], strict=True):
        if not _inside(child, mean(child), mean(node)):
            judged[4] = LEFT_OUT
    return top


def _beside(node: list, text: float, main: float) -> bool:
    """Whether a slot beside the main one is content."""
    if node[7] < 0:
        return False
    if node[7] == MAIN or node[0].partition(".")[0] in HEADINGS:
        return True
    return text >= RICH * main and node[6] <= LINKED * node[5]


def _inside(node: list, text: float, whole: float) -> bool:
    """Whether a slot of the main one is content."""
    if node[7] == SERVES or (node[7] == NAMED and text < QUIET * whole):
        return False
    return node[0].partition(".")[0] in PLAIN or node[6] < ONLY_LINKS * max(node[5], 1)


def host_of(url: Column) -> Column:
    """Host of an address in lower case, empty for null or other texts."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce_templates(pages: DataFrame) -> DataFrame:
    """host, tree (JSON): the template of each host, by all its pages (url, html). Pages without elements do not count."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list] = {}
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = tree_of(parse(html or ""))
                if not tree[3]:
                    continue
                trees[host] = merge(trees[host], tree) if host in trees else tree
            if len(trees) > 4096:
                yield rows(trees)
                trees = {}
        yield rows(trees)

    def rows(trees: dict[str, list]) -> pa.RecordBatch:
        texts = [written(t) for t in trees.values()]
        salts = [int(digest(h + t), 16) % SALTS for h, t in zip(trees, texts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(trees), pa.string()), pa.array(salts, pa.int32()), pa.array(texts, pa.string())], names=["host", "salt", "tree"])

    def total(table: pa.Table) -> list:
        trees = sorted(table.column("tree").to_pylist())
        out = read_tree(trees[0])
        for t in trees[1:]:
            out = merge(out, read_tree(t))
        return out

    def join(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "tree": [written(total(table))]})

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "tree": [written(template_of(total(table)))]})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(local, "host string, salt int, tree string")
    salted = parts.groupBy("host", "salt").applyInArrow(join, "host string, tree string")
    return salted.groupBy("host").applyInArrow(decide, "host string, tree string")


def content_blocks(root: Node, template: list | None) -> list[str]:
    """Texts of the page's content blocks in order, by the template of its host, or by its own slots.

    The latter where there is no template, or the page has nothing in its main slot: then its layout is another one.
    """
    texts, tree = outline(root)
    if template:
        left_out, at_home = _template_places(tree, template)
        if at_home and (blocks := _blocks(texts, left_out)):
            return blocks
    return _blocks(texts, _template_places(tree, template_of(_counted(tree)), template)[0])


def _template_places(tree: list, template: list, host: list | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Places of the page's nodes that are left out, and whether there is text in the main slot.

    Left out are nodes with the text of the template's node they are aligned with, and those of slots that are no content.
    A page judged by its own slots also loses the constant texts of its host's template.
    """
    out, known, at_home = [], {}, template[4] == CENTRE and tree[5] > 0
    fixed = _constant_places(tree, host) if host else set()
    todo = [(tree[3], template[3])]
    while todo:
        own, others = todo.pop()
        for i, j in matching(own, others, known)[1] if own and others else []:
            node, slot = own[i], others[j]
            if slot[4] == LEFT_OUT or (slot[2] is not None and node[2] == slot[2]) or (node[1], node[4]) in fixed:
                out.append((node[1], node[4]))
            else:
                at_home = at_home or (slot[4] == CENTRE and node[5] > 0)
                todo.append((node[3], slot[3]))
    return sorted(out), at_home


def _constant_places(tree: list, template: list) -> set[tuple[int, int]]:
    out, known, todo = set(), {}, [(tree[3], template[3])]
    while todo:
        own, others = todo.pop()
        for i, j in matching(own, others, known)[1] if own and others else []:
            if others[j][2] is not None and own[i][2] == others[j][2]:
                out.add((own[i][1], own[i][4]))
            else:
                todo.append((own[i][3], others[j][3]))
    return out


def _blocks(texts: list[str | None], left_out: list[tuple[int, int]]) -> list[str]:
    kept, at = [], 0
    for first, last in left_out:
        # Where blocks begin and end still counts.
        kept += texts[at:first] + [t for t in texts[first:last] if t is None]
        at = last
    out: list[str] = []
    inline: list[str] = []
    for text in [*kept, *texts[at:], None]:
        if text is not None:
            inline.append(text)
        elif inline:
            found = SPACE.sub(" ", "".join(inline)).strip()
            inline.clear()
            if found:
                out.append(found)
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the content's blocks in page order, joined by line breaks.

    A null or empty html, and a page without content, give an empty text. The host's template decides, inside and outside
    of article and main elements alike; see the module. A host of one page, or of equal pages only, has no constant texts;
    its slots are told by their text and links alone. A null url is a host of its own. Repeated rows are pages like others.
    No pages: no rows. Other columns are not read. The templates are written to the shared folder first.
    """
    templates = stored(induce_templates(pages), f"{work_folder(pages.sparkSession, 'templates')}/hosts")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    size = templates.agg(F.coalesce(F.sum(F.length("tree").cast("long")), F.lit(0))).first()[0]
    of_host = templates.select(F.col("host").alias("_host"), "tree")
    if size <= SENT_CHARS:
        joined = rows.join(F.broadcast(of_host), F.col("host") == F.col("_host"), "left")
    else:
        # Too many hosts for that: a host's pages are dealt over SALTS places, each with its template.
        salted = of_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    joined = joined.select("page_id", "url", "html", "tree")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, tree in zip(batch.column("html").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                if tree is not None and tree not in known:
                    known = {} if len(known) > 256 else known
                    known[tree] = read_tree(tree)
                texts.append("\n".join(content_blocks(parse(html or ""), known[tree] if tree is not None else None)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    fields = pages.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(extract, fields)
