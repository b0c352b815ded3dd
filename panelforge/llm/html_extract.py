"""HTML extraction (3): wrapper induction over pages of one host.

Pages of a host are worked on in batches of ``BATCH`` pages, the last with what is left, up to twice as many (a host with
many pages or bytes is spread over as many salted keys as it asks for; a batch is all that a task holds). In a batch every
DOM tree is aligned with a pivot tree by simple tree matching, with runs of like siblings folded into one list slot. A
slot's text that most pages repeat is template, but for running text in an article; all other text outside marked page
furniture is content, wherever it stands. Names mark furniture if beside a mark they hold neutral words only.
Article and main elements are a hint only: where template would take more than half of their text, the body itself is
repeated and they stay whole. Tags are found in one pass and trees walked without recursion, so time follows the page's size;
two lists of siblings are aligned exactly at any length, in time that follows their length times what differs in them.

Defined results: null, empty and text-less html give "" and 0; html without tags is its own text; unclosed or stray tags,
comments and quotes do no harm; repeated rows are worked on like others and give equal answers up to their batch. Copies of
an article on one host stay whole where an article or main element holds them. Columns besides page_id, url and html are
not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, checked_broadcast, id_back, id_parts, parallelism, ship
from panelforge.llm.url_filter import parts

BATCH = 32
HEAVY = 2_000
PART_BYTES = 32 << 20
CONSTANT_SHARE = 0.8
MIN_PAGES = 3
#: Cells of two lists' table beyond which its rows are worked on as arrays, and cells held at once; neither changes a result.
SMALL, CELLS = 4_096, 1 << 20
#: Remembered scores of a batch; beyond that they are made anew for the next page.
SCORES = 100_000

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
_END = re.compile(r"[\s/]*>")
_WORD = re.compile(r"[a-z0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article aside body button caption div dl fieldset footer form header html li main nav ol section table td th tr ul object".split())
#: Elements and marks of page furniture.
FURNITURE_TAGS = set("nav footer aside form script style noscript template iframe svg head title button select textarea input dialog menu canvas object audio video datalist".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
FURNITURE_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav "
    "cookie cookies consent gdpr notice notices notification popup modal overlay toast newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations "
    "comment comments disqus discussion reply replies respond widget widgets pagination pager toolbar footer search searchbox form skip alert".split()
)
OUTSIDE_WORDS = set("header masthead topbar".split())
#: Words that may stand beside a mark in a name, as in comment-list; any other word makes the name one of content, as in related-work.
NEUTRAL_WORDS = set("a area bar block body bottom box btn button buttons center col column container content cta feed field fixed footer global group head header heading holder icon icons in inline inner item items js label left link links list main mini mobile module of outer page panel pane post primary reader readers region right root row secondary section site slot sticky story tile title top unit user users view wrap wrapper zone".split())
#: Elements that hold running text: an id (a heading's, made from its words) says nothing of them, nor does repetition in an article.
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p blockquote li dd dt pre td th tr figcaption caption".split())
CONTENT_TAGS = {"article", "main"}


def marked(name: str, marks: set[str]) -> bool:
    """Whether an id or a class names furniture: it holds a mark, and beside marks only neutral words and numbers."""
    words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    return any(w in marks for w in words) and all(w in marks or w in NEUTRAL_WORDS or w.isdigit() or len(w) == 1 for w in words)


class Node:
    __slots__ = ("tag", "label", "furniture", "children", "parent", "folded", "key", "in_content")

    def __init__(self, tag: str, found: dict[str, str], parent):
        self.tag, self.parent, self.children, self.folded, self.key = tag, parent, [], None, None
        self.in_content = parent is not None and (parent.in_content or parent.tag in CONTENT_TAGS)
        names = ""
        self.furniture = tag in FURNITURE_TAGS or tag == "header" and not self.in_content
        if found:
            names = f"{found.get('id', '')} {found.get('class', '')}"
            if tag not in ("html", "body", "main"):
                marks = FURNITURE_WORDS if self.in_content or tag == "article" else FURNITURE_WORDS | OUTSIDE_WORDS
                self.furniture |= any(marked(name, marks) for name in (found.get("class", "") if tag in TEXT_TAGS else names).split())
            roles = set(found.get("role", "").lower().split())
            if "main" in roles or "article" in roles or found.get("itemprop") == "articleBody":
                self.tag = "main" if "main" in roles else "article"
            self.furniture |= bool(roles & FURNITURE_ROLES) or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            names = ".".join(sorted(re.sub(r"\d+", "0", names).split()))
        self.label = f"{self.tag}.{names}" if names else self.tag


def markup(source: str):
    """(text before, tag, attributes, end of the tag) of each tag, then the rest as (text, None, None, None); a tag is "/x" if it closes.

    One pass: whatever is tried is also consumed. A tag that the page never ends is dropped with what follows it.
    """
    at, text = 0, 0
    while (m := _OPEN.search(source, at)) is not None:
        start, at = m.start(), m.end()
        if source.startswith("<!--", start):
            end = source.find("-->", at)
            end = -1 if end < 0 else end + 3
            name, found = "", {}
        elif source[start + 1] in "!?":
            end = source.find(">", at) + 1 or -1
            name, found = "", {}
        else:
            m = _NAME.match(source, start + 1 + (source[start + 1] == "/"))
            name, found, end = source[start + 1 : m.end()].lower(), {}, m.end()
            while (closed := _END.match(source, end)) is None:
                m = _ATTRIBUTE.match(source, end)
                if m is None:
                    break
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
                end = m.end()
            end = -1 if closed is None else closed.end()
        if end < 0:
            yield source[text:start], None, None, None
            return
        jump = yield source[text:start], name, found, end
        at = text = end if jump is None else jump
    yield source[text:], None, None, None


def parse(source: str) -> Node:
    root = now = Node("#page", {}, None)
    opened: Counter = Counter()  # of the tags that are open now
    pieces, jump = markup(source), None
    while True:
        try:
            text, tag, found, at = pieces.send(jump)
        except StopIteration:
            return root
        jump = None
        if text:
            now.children.append(entities.unescape(text))
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            node = now
            while opened[tag] and node is not root and node.tag != tag and not (tag == "p" and node.tag in SCOPE):
                node = node.parent
            if node is not root and node.tag == tag:
                while now is not node.parent:
                    opened[now.tag] -= 1
                    now = now.parent
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if closes and any(opened[c] for c in closes):
            node, bound = now, SCOPE - closes - ({"tr"} if tag == "tr" else set())
            while node is not root and node.tag not in closes and node.tag not in bound:
                node = node.parent
            while node is not root and node.tag in closes:
                while now is not node.parent:
                    opened[now.tag] -= 1
                    now = now.parent
                node = node.parent
        new = Node(tag, found, now)
        now.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            jump = len(source) if end is None else source.find(">", end.start()) + 1 or len(source)
        elif tag not in VOID:
            now = new
            opened[now.tag] += 1


def fold(node: Node) -> list[tuple[str, list[Node]]]:
    """A node's element children, runs of like ones as one slot."""
    if node.folded is None:
        out: list[tuple[str, list[Node]]] = []
        for c in node.children:
            if isinstance(c, Node) and (c.tag in BLOCK or c.tag in CONTENT_TAGS) and c.tag != "br":
                if out and out[-1][0] == c.label:
                    out[-1][1].append(c)
                else:
                    out.append((c.label, [c]))
        node.folded = out
    return node.folded


class Shapes:
    """Numbers for shapes of trees: the label and the shapes of the slots' first nodes. Scores are between shapes, so like trees are matched once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.known: dict[int, int] = {}  # by the id of a node, which the caller keeps alive
        self.label, self.below, self.size = [], [], []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, node: Node) -> int:
        stack = [node]
        while stack:
            x = stack[-1]
            if id(x) not in self.known:
                todo = [held[0] for _, held in fold(x) if id(held[0]) not in self.known]
                if todo:
                    stack += todo
                    continue
                below = tuple(self.known[id(held[0])] for _, held in fold(x))
                number = self.numbers.setdefault((x.label, below), len(self.label))
                if number == len(self.label):
                    self.label.append(x.label)
                    self.below.append(below)
                    self.size.append(1 + sum(self.size[c] for c in below))
                self.known[id(x)] = number
            stack.pop()
        return self.known[id(node)]

    def score(self, s: int, t: int) -> int:
        if s == t:
            return self.size[s]
        if self.label[s] != self.label[t]:
            return 0
        return self.scores[s, t] if self.below[s] and self.below[t] else 1

    def missing(self, s: int, t: int):
        """Pairs of shapes below whose score must be found first."""
        by: dict[str, list[int]] = {}
        for v in dict.fromkeys(self.below[t]):
            if self.below[v]:
                by.setdefault(self.label[v], []).append(v)
        for u in dict.fromkeys(self.below[s]):
            if self.below[u]:
                for v in by.get(self.label[u], ()):
                    if u != v and (u, v) not in self.scores:
                        yield u, v

    def solve(self, s: int, t: int) -> int:
        """The size of the largest order-keeping match of two trees; the scores below it are then known."""
        stack = [(s, t, self.missing(s, t))]
        while stack:
            p, q, todo = stack[-1]
            pair = next(todo, None)
            if pair is not None:
                stack.append((*pair, self.missing(*pair)))
                continue
            stack.pop()
            if p != q and self.label[p] == self.label[q]:
                self.scores[p, q] = 1 + aligned(self.below[p], self.below[q], self, False)[0]
        return self.score(s, t)


def aligned(x: tuple[int, ...], y: tuple[int, ...], shapes: Shapes, traced: bool = True) -> tuple[int, list]:
    """The best order-keeping match of two lists of shapes: its size and, if traced, the matched places; of equal ones that of the earliest places.

    A common beginning is matched as it stands: no other partner of a shape is worth more than an equal one.
    """
    k = 0
    while k < len(x) and k < len(y) and x[k] == y[k]:
        k += 1
    head, pairs = sum(shapes.size[s] for s in x[:k]), [(i, i) for i in range(k)] if traced else []
    x, y = x[k:], y[k:]
    if not x or not y:
        return head, pairs
    if len(x) * len(y) > SMALL:
        size, rest = _wide(np.array(x), np.array(y), shapes, traced)
        return head + size, pairs + [(i + k, j + k) for i, j in rest]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, s in enumerate(x, 1):
        above, row = best[i - 1], best[i]
        for j, t in enumerate(y, 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + shapes.score(s, t))
    i, j, rest = len(x), len(y), []
    while traced and i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            rest.append((i + k, j + k))
    return head + best[len(x)][len(y)], pairs + rest[::-1]


def _wide(x: np.ndarray, y: np.ndarray, shapes: Shapes, traced: bool) -> tuple[int, list]:
    """The same table, a row at a time and in memory that follows the lists.

    A way through the table that skips more than ``slack`` of the smaller list's weight cannot reach a match of all but
    ``slack`` of it. So only the band that such ways leave is filled; it is widened until the match found proves it wide enough.
    """
    size = np.array(shapes.size)
    kinds, kind = np.unique(y, return_inverse=True)
    worth: dict[int, np.ndarray] = {}
    sx, sy = np.r_[0, np.cumsum(size[x])], np.r_[0, np.cumsum(size[y])]
    least, slack = min(int(sx[-1]), int(sy[-1])), 64

    def step(row: np.ndarray, i: int) -> None:
        """Row i - 1 becomes row i."""
        s, a, b = int(x[i - 1]), max(int(lo[i]), 1), int(hi[i]) + 1
        if b <= a:
            return
        w = worth.get(s)
        if w is None:
            w = np.array([shapes.score(s, int(t)) for t in kinds], np.int64)
            if (len(worth) + 1) * len(kinds) <= CELLS:
                worth[s] = w
        now = np.maximum(row[a:b], row[a - 1 : b - 1] + w[kind[a - 1 : b - 1]])
        now[0] = max(now[0], row[a - 1])
        np.maximum.accumulate(now, out=row[a:b])

    while True:
        goal = max(least - slack, 0)
        lo, hi = np.searchsorted(sy, sx - (sx[-1] - goal)), np.searchsorted(sy, sx + (sy[-1] - goal), "right") - 1
        row = np.zeros(len(y) + 1, np.int64)
        for i in range(1, len(x) + 1):
            step(row, i)
        total = int(row[-1])
        if total >= goal:
            break
        slack *= 4
    pairs: list[tuple[int, int]] = []

    def back(a: int, b: int, row: np.ndarray, j: int) -> int:
        """Traces from place j of row b to row a, whose values are given; returns the place there."""
        first, end = max(int(lo[a]) - 1, 0), int(hi[b]) + 1
        if (b - a) * (end - first) <= CELLS or b - a == 1:
            held = [row[first:end].copy()]
            for i in range(a + 1, b + 1):
                step(row, i)
                held.append(row[first:end].copy())
            i = b
            while i > a and j:
                now, above = held[i - a], held[i - a - 1]
                if now[j - first] == above[j - first]:
                    i -= 1
                elif now[j - first] == now[j - 1 - first]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
            return j
        cuts = [a + (b - a) * c // 16 for c in range(17)]
        parts = []
        for c, d in zip(cuts, cuts[1:], strict=False):
            if c < d:
                parts.append((c, d, row.copy()))
                for i in range(c + 1, d + 1) if d < b else ():
                    step(row, i)
        while parts and j:
            c, d, start = parts.pop()
            j = back(c, d, start, j)
        return j

    if traced:
        back(0, len(x), np.zeros(len(y) + 1, np.int64), len(y))
    return total, pairs[::-1]


def match(a: Node, b: Node, memo: dict) -> tuple[int, list]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and the matched slots below. memo keeps what is found."""
    shapes = memo.setdefault("shapes", Shapes())
    if a.label != b.label:
        return 0, []
    s, t = shapes.of(a), shapes.of(b)
    size = shapes.size[s] if s == t else shapes.scores.get((s, t)) or shapes.solve(s, t)
    return size, aligned(shapes.below[s], shapes.below[t], shapes)[1]


def blocks(node: Node, skip=frozenset()) -> list[str]:
    """The texts of the blocks below a node, in order, without furniture and without the nodes of skip."""
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif x is None:
            out.append([])
        elif not (x is not node and x.furniture or id(x) in skip):
            if x.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.children))
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def text_of(node: Node, skip=frozenset()) -> str:
    return " ".join(blocks(node, skip))


def key_of(node: Node) -> bytes:
    """A digest of the shown text below a node, block by block; empty without text."""
    stack = [node]
    while stack:
        x = stack[-1]
        if x.key is None:
            todo = [] if x.furniture else [c for c in x.children if isinstance(c, Node) and c.key is None]
            if todo:
                stack += todo
                continue
            parts = [] if x.furniture else [c.key if isinstance(c, Node) else " ".join(c.split()).encode() for c in x.children]
            parts = [c for c in parts if c]
            x.key = hashlib.sha1(b"\0".join(parts)).digest() if parts else b""
        stack.pop()
    return node.key


def articles(root: Node) -> list[Node]:
    """The outermost article elements outside furniture, or else the outermost main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack: list = [(root, False, False)]
    while stack:
        x, in_article, in_main = stack.pop()
        if x.furniture:
            continue
        if x.tag == "article" and not in_article:
            found["article"].append(x)
        if x.tag == "main" and not in_main:
            found["main"].append(x)
        stack.extend((c, in_article or x.tag == "article", in_main or x.tag == "main") for c in reversed(x.children) if isinstance(c, Node))
    return found["article"] or found["main"]


def induce(pages: list[Node]) -> list[str]:
    """The main texts of a batch of pages of one host."""
    if not pages:
        return []
    # the pivot: the page with the most slots
    pivot = max(pages, key=lambda p: sum(1 for _ in walk(p)))
    slots: dict[tuple[int, int], int] = {}
    memo: dict = {}
    found = [align(pivot, p, slots, memo) for p in pages]  # for each page: pivot slot -> the page's nodes
    filled: Counter = Counter()
    common: Counter = Counter()
    for a in found:
        for slot, nodes in a.items():
            keys = {k for x in nodes if (k := key_of(x))}
            filled[slot] += bool(keys)
            common.update((slot, k) for k in keys)
    template = {k for k, n in common.items() if n >= MIN_PAGES and n >= CONSTANT_SHARE * filled[k[0]]}
    skips = [{id(x) for slot, nodes in a.items() for x in nodes if (slot, x.key) in template and not (x.in_content and x.tag in TEXT_TAGS)} for a in found]
    # what would take most of the article or main elements is a repeated body, not template
    bodies = [articles(p) for p in pages]
    whole = sum(len(text_of(x)) for held in bodies for x in held)
    left = sum(len(text_of(x, skip)) for held, skip in zip(bodies, skips, strict=True) for x in held)
    if 2 * left < whole:
        skips = [skip - {id(x) for body in held for x in (*below(body), *above(body))} for held, skip in zip(bodies, skips, strict=True)]
    # all that is neither template nor furniture varies, so it is kept wherever it stands
    return [text_of(page, skip) or text_of(page) for page, skip in zip(pages, skips, strict=True)]


def below(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in x.children if isinstance(c, Node))


def above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(n for _, slot in fold(x) for n in slot[:1])


def align(pivot: Node, page: Node, slots: dict[tuple[int, int], int], memo: dict) -> dict[int, list[Node]]:
    """Nodes of a page by the pivot slot that they match. slots numbers (slot above, place in it), from 1; the page is 0."""
    out: dict[int, list[Node]] = {}
    if "shapes" in memo and len(memo["shapes"].scores) > SCORES:
        memo["shapes"].scores.clear()
    stack = [(0, pivot, page)]
    while stack:
        above, a, b = stack.pop()
        for i, j in match(a, b, memo)[1]:
            slot = slots.setdefault((above, i), len(slots) + 1)
            out[slot] = fold(b)[j][1]
            stack.append((slot, fold(a)[i][1][0], fold(b)[j][1][0]))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    host, _ = parts(F.col("url"))
    rows = pages.select(*id_parts(F.col("page_id"), "page_id"), "url", "html").withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    sizes = Scratch(spark).table(sizes, "hosts")
    heavy = sizes.select("host", F.greatest(F.ceil(F.col("n") / HEAVY), F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("salts")).where("salts > 1")
    rows = rows.join(checked_broadcast(heavy), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))))
    count = max(parallelism(spark), -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES))
    dealt = rows.select("page_id", "no_id", "url", "html", "host", "salt").repartition(count, "host", "salt").sortWithinPartitions("host", "salt", "no_id", "page_id", F.xxhash64("url"))

    def run(batches):
        held: list = []
        key = None

        def done(rows):
            texts = induce([parse(r[2] or "") for r in rows])
            return pd.DataFrame({"page_id": [r[0] for r in rows], "no_id": [r[3] for r in rows], "url": [r[1] for r in rows], "text": texts, "n_chars": [len(t) for t in texts]})

        for pdf in batches:
            for page_id, no_id, url, source, h, salt in zip(pdf["page_id"].tolist(), pdf["no_id"].tolist(), pdf["url"], pdf["html"], pdf["host"], pdf["salt"], strict=True):
                if held and (h, salt) != key:
                    yield done(held)
                    held = []
                elif len(held) == 2 * BATCH:  # a host's last batch is never a short one
                    yield done(held[:BATCH])
                    held = held[BATCH:]
                key = (h, salt)
                held.append((page_id, url, source, no_id))
        if held:
            yield done(held)

    out = dealt.mapInPandas(run, "page_id long, no_id boolean, url string, text string, n_chars long")
    return out.select(id_back("page_id"), "url", "text", "n_chars")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
