"""Content of web pages by wrapper induction over pages of one host.

Pages become DOM trees. The trees of a host are aligned one after another with
its template by simple tree matching (Yang's ordered matching with equal tags);
what has no partner joins the template in its place. A text node that most of
the host's pages have, always with the same text, is constant and part of the
template; every other text is a slot, and slots are the content.

Templates are built per task where the pages are read and then merged by host,
by the same alignment, so no page is shuffled. They hold tags and text digests
only. Extraction aligns each page with its host's template: templates are
broadcast up to ``broadcast_bytes`` in all, else pages are joined by host.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import written

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>'\"]")
#: Short tags, in bounded time; what isn't one is looked at by its quotes.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>'\"<]{0,60})(?=[\s/>])(?:[^'\"<>]{0,200}+\"[^\"<>]{0,500}\"){0,12}+[^'\"<>]{0,200}+>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
_SILENT = frozenset(("script", "style", "noscript", "template", "iframe", "head"))
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {b: ("p",) for b in _BLOCK}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "body", "html", "div", "article", "section", "#root"))
_SPACE = re.compile(r"\s+")


class Node:
    """tag, children, text (of #text only), its digest; ``size`` and ``sig`` are of the structure below."""

    __slots__ = ("tag", "kids", "text", "mark", "n", "size", "sig")

    def __init__(self, tag: str, text: str | None = None, mark: int | None = None, n: int = 1):
        self.tag, self.kids, self.text, self.mark, self.n = tag, [], text, mark, n
        self.size, self.sig = 1, tag

    def seal(self) -> None:
        """Compute size and structure of the node from those of its children."""
        self.size = 1 + sum(k.size for k in self.kids)
        self.sig = self.tag if not self.kids else _interned((self.tag, *(k.sig for k in self.kids)))


_names: dict[tuple, str] = {}


def _interned(shape: tuple) -> str:
    if shape not in _names:
        if len(_names) > 200_000:
            _names.clear()
        _names[shape] = blake2b("\0".join(shape).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return _names[shape]


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def _tag_ends(page: str) -> Callable[[int], int]:
    """A function that finds the ``>`` of the tag that goes on at a position, outside quotes; -1 without one.

    Positions are asked for in growing order. What follows each quote is found
    once, so all calls together take time in proportion to the page.
    """
    known: dict[int, int] = {}
    low, high = 0, -1  # from low to high there is no quote or >, high has one

    def end(at: int) -> int:
        nonlocal low, high
        passed, i = [], at
        while True:
            if i == at and low <= at <= high:
                r = high
            else:
                m = _SPECIAL.search(page, i)
                r = m.start() if m else len(page)
                if i == at:
                    low, high = at, r
            if r in known or r == len(page):
                e = known.get(r, -1)
                break
            passed.append(r)
            if page[r] == ">":
                e = r
                break
            close = page.find(page[r], r + 1)
            if close < 0:
                e = -1
                break
            i = close + 1
        for r in passed:
            known[r] = e
        return e

    return end


def parse(page: str) -> Node:
    """The DOM tree of a page, however deep, in time in proportion to it; white space is collapsed; broken markup is taken as it comes."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {"#root": [0]}  # of the open elements of each tag, from the top down
    silent = 0
    end_of = _tag_ends(page)
    at, end = 0, len(page)

    def text(raw: str) -> None:
        if silent:
            return
        t = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
        if t:
            stack[-1].kids.append(Node("#text", t, digest(t)))

    def close(to: int) -> None:
        nonlocal silent
        while len(stack) > to:
            node = stack.pop()
            node.seal()
            places[node.tag].pop()
            silent -= node.tag in _SILENT

    def last(tags) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    look = 0
    while at < end:
        start = page.find("<", look)
        if start < 0:
            break
        m = _PLAIN.match(page, start)
        if m:
            to = m.end()
        elif page.startswith("<!--", start):
            to = page.find("-->", start + 4)
            to = end if to < 0 else to + 3
        elif page.startswith("<![CDATA[", start):
            to = page.find("]]>", start + 9)
            inside, to = (page[start + 9 :], end) if to < 0 else (page[start + 9 : to], to + 3)
            text(page[at:start])
            text(inside)
            at = look = to
            continue
        elif page.startswith(("<!", "<?"), start):
            to = page.find(">", start + 2)
            to = end if to < 0 else to + 1
        else:
            m = _NAME.match(page, start + 1)
            to = end_of(m.end()) + 1 if m else 0
            if not to:  # no tag: the sign is part of the text
                look = start + 1
                continue
        text(page[at:start])
        at = look = to
        if page[start + 1] in "!?":
            continue
        name = m.group(2).lower()
        if m.group(1):
            own = places.get(name)
            if own:
                close(own[-1])
            continue
        closes = last(_CLOSES.get(name, ()))
        if closes > last(_SCOPE):
            close(closes)
        node = Node(name)
        stack[-1].kids.append(node)
        if name in _VOID or page[to - 2] == "/":
            continue
        if name in _RAW:
            closing = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            inside = page[at : closing.start() if closing else end]
            at = look = closing.end() if closing else end
            if name not in _SILENT and not silent:
                t = _SPACE.sub(" ", html.unescape(inside)).strip()
                if t:
                    node.kids.append(Node("#text", t, digest(t)))
                    node.seal()
            continue
        places.setdefault(name, []).append(len(stack))
        silent += name in _SILENT
        stack.append(node)
    text(page[at:])
    close(0)
    return root


def deep() -> None:
    """Let recursion follow trees as deep as pages are: calls between Python functions don't take the machine's stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000_000))


_weights: dict[tuple[str, str], int] = {}


def weight(a: Node, b: Node) -> int:
    """The most node pairs of a simple tree matching of a and b."""
    if a.tag != b.tag:
        return 0
    if a.sig == b.sig:
        return a.size
    key = (a.sig, b.sig)
    w = _weights.get(key)
    if w is None:
        w = 1
        for i, j in pairs(a.kids, b.kids):
            w += weight(a.kids[i], b.kids[j])
        if len(_weights) > 500_000:
            _weights.clear()
        _weights[key] = w
    return w


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """An ordered matching of two lists of children of greatest total weight. Equal ends are matched first, which loses nothing."""
    low = 0
    while low < len(a) and low < len(b) and a[low].sig == b[low].sig:
        low += 1
    x, y = len(a), len(b)
    while x > low and y > low and a[x - 1].sig == b[y - 1].sig:
        x, y = x - 1, y - 1
    out = [(i, i) for i in range(low)]
    if x > low and y > low:
        out += [(low + i, low + j) for i, j in _best(a[low:x], b[low:y])]
    return out + [(x + i, y + i) for i in range(len(a) - x)]


def _best(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    first: dict[str, int] = {}
    other: dict[str, int] = {}
    ia = np.array([first.setdefault(k.sig, len(first)) for k in a])
    ib = np.array([other.setdefault(k.sig, len(other)) for k in b])
    one, two = {k.sig: k for k in a}, {k.sig: k for k in b}
    table = np.array([[weight(one[s], two[t]) for t in other] for s in first], np.int64)
    return _align(table, ia, ib)


def _align(table: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
    """The heaviest ordered matching; long lists are halved (Hirschberg) so that memory stays linear."""
    m, n = len(ia), len(ib)
    if m * n > 1 << 25 and m > 1:
        half = m // 2
        left = _row(table, ia[:half], ib)
        right = _row(table, ia[half:][::-1], ib[::-1])[::-1]
        cut = int(np.argmax(left + right))
        return _align(table, ia[:half], ib[:cut]) + [(i + half, j + cut) for i, j in _align(table, ia[half:], ib[cut:])]
    best = np.zeros((m + 1, n + 1), np.int64)
    for i in range(m):
        w = table[ia[i]][ib]
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w))
    out = []
    i, j = m, n
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def _row(table: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    best = np.zeros(len(ib) + 1, np.int64)
    for i in ia:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[i][ib]))
    return best


def merge(template: Node, tree: Node) -> None:
    """Align tree with the template (equal tags) and take it in. A text that differs makes its node vary (mark None)."""
    template.n += tree.n
    if template.mark != tree.mark:
        template.mark = None
    if not tree.kids and not template.kids:
        return
    matched = pairs(tree.kids, template.kids)
    to = dict(matched)
    for i, j in matched:
        merge(template.kids[j], tree.kids[i])
    if len(matched) < len(tree.kids):
        kids, at = [], 0
        for i, kid in enumerate(tree.kids):
            if i in to:
                kids += template.kids[at : to[i] + 1]
                at = to[i] + 1
            else:
                kids.append(kid)
        template.kids = kids + template.kids[at:]
    template.seal()


def bare(tree: Node) -> Node:
    """The tree without its texts, in place; their digests stay."""
    left = [tree]
    while left:
        node = left.pop()
        node.text = None
        left += node.kids
    return tree


def dump(node: Node) -> list:
    """Tags, marks, numbers of pages and of children, each from the top down and in order."""
    out: list[list] = [[], [], [], []]
    left = [node]
    while left:
        x = left.pop()
        for own, value in zip(out, (x.tag, x.mark, x.n, len(x.kids))):
            own.append(value)
        left += x.kids[::-1]
    return out


def load(x: list) -> Node:
    nodes, free = [], []
    for tag, mark, n, kids in zip(*x):
        node = Node(tag, None, mark, n)
        nodes.append(node)
        if free:
            parent = free[-1]
            parent[0].kids.append(node)
            parent[1] -= 1
            if not parent[1]:
                free.pop()
        if kids:
            free.append([node, kids])
    for node in reversed(nodes):
        node.seal()
    return nodes[0]


def extract(tree: Node, template: Node | None, share: float) -> tuple[list[str], int]:
    """The texts of the varying slots, in order, and the number of constant texts left out."""
    out: list[str] = []
    constant = 0
    total = template.n if template else 0

    def walk(node: Node, t: Node | None) -> None:
        nonlocal constant
        if node.tag == "#text":
            if t is not None and t.mark == node.mark and t.n >= max(2, share * total):
                constant += 1
            else:
                out.append(node.text)
            return
        to = dict(pairs(node.kids, t.kids)) if t is not None else {}
        for i, kid in enumerate(node.kids):
            walk(kid, t.kids[to[i]] if i in to else None)

    walk(tree, template)
    return out, constant


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _packed(node: Node) -> bytes:
    return json.dumps(dump(node), separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def _induce(held_nodes: int):
    """Templates of the hosts of each task; all that are held are given out whenever they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_packed(t) for t in held.values()], pa.binary())], ["host", "template"])
            held.clear()
            return out

        deep()
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html")):
                tree = bare(parse(page.as_py() or ""))
                if host in held:
                    size -= held[host].size
                    merge(held[host], tree)
                else:
                    held[host] = tree
                size += held[host].size
                if size > held_nodes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _join(key: tuple, t: pa.Table) -> pa.Table:
    """One template from those of a host, the largest first."""
    deep()
    own = sorted(t["template"].to_pylist(), key=lambda x: (-len(x), x))
    whole = load(json.loads(own[0]))
    for x in own[1:]:
        merge(whole, load(json.loads(x)))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([_packed(whole)], pa.binary())})


def templates(pages: DataFrame, *, held_nodes: int = 1_000_000) -> DataFrame:
    """(host, template) of (host, html) rows with a host."""
    partial = pages.where("host <> ''").select("host", "html").mapInArrow(_induce(held_nodes), "host string, template binary")
    return partial.groupBy("host").applyInArrow(_join, "host string, template binary")


def _contents(share: float, shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Node] = {}
        deep()
        for b in batches:
            content, slots, constants = [], [], []
            own = b.column("template") if shared is None else None
            for i, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html"))):
                if host not in loaded:
                    stored = own[i].as_py() if shared is None else shared.value.get(host)
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[host] = load(json.loads(stored)) if stored is not None else None
                texts, constant = extract(parse(page.as_py() or ""), loaded[host], share)
                content.append("\n".join(texts))
                slots.append(len(texts))
                constants.append(constant)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(content, pa.string()), pa.array(slots, pa.int64()), pa.array(constants, pa.int64())], ["page_id", "host", "content", "slots", "constants"])

    return run


def extract_content(pages: DataFrame, *, share: float = 0.5, held_nodes: int = 1_000_000, broadcast_bytes: int = 32 << 20, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, content, slots, constants): one row for each page.

    content has the texts of the page's varying slots in order, one a line, and
    constants is how many texts were left out as constant: at least ``share`` of
    the host's pages, and at least two, have the node, all with one text.
    Scripts, styles, comments and the head have no texts. A null or empty page
    has content '', a page without host (null or odd URL) is all content, and
    so is the only page of a host. A repeated row counts as another page. Null
    ids are carried along; extra columns aren't read; an empty table gives no
    rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    found = written(templates(rows, held_nodes=held_nodes), "templates")
    size = found.agg(F.sum(F.length("template"))).first()[0] or 0
    schema = f"page_id {pages.schema[page_id].dataType.simpleString()}, host string, content string, slots long, constants long"
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.host: bytes(r.template) for r in found.toLocalIterator()})
        return rows.mapInArrow(_contents(share, shared), schema)
    return rows.join(found.hint("shuffle_hash"), "host", "left").mapInArrow(_contents(share), schema)
