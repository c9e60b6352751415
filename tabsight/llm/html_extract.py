"""Main-text extraction by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block the cost of
calling it content and that of calling it boilerplate; they are the capacities of
its two terminal edges. Blocks that follow each other, and siblings in the DOM,
are joined by smoothness edges, which are strong inside one container and weak
across the border of containers. The minimum cut, found by maximum flow, is the
cheapest labelling; the blocks on the source's side are the text.

Pages are handled one by one inside Arrow batches: a page is one row and never
meets another."""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z][\w:.-]*)""")

#: Element names of HTML by what they mean here.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img picture source math mrow mi mo mn ms mtext mspace msup msub "
                   "msubsup mfrac msqrt mroot mstyle mover munder munderover mmultiscripts mtable mtr mtd mfenced menclose mpadded "
                   "mphantom merror semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes".split())
#: Of these, the ones that HTML reads to the end of the page if no end tag follows.
TO_THE_END = frozenset("script style textarea title".split())
#: Elements with text of their own or for browsers that can't show them. One that is
#: never closed says nothing about the text after it.
CLOSED = frozenset("button select object canvas audio video svg annotation annotation-xml".split())
#: Their text isn't shown.
UNSHOWN = CLOSED - {"button", "select"}
#: Tags that leave a head open; any other, or text, ends it.
HEAD = frozenset("html title meta link base basefont bgsound style script noscript template noframes".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main nav ol p pre section table ul".split())
BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "fieldset": 6.0, "label": 4.0,
            "header": 4.0, "button": 4.0, "select": 6.0}
GOOD_TAGS = {"article": 4.0, "main": 3.0}
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline caption-ad comment "
                      "comments consent cookie cookies copyright dialog disclaimer disqus footer footnav form gdpr login masthead menu "
                      "modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
                      "promoted promotion recommended related reply replies respond response search share sharing sidebar signin "
                      "signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets alert feedback "
                      "discussion discussions".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
GOOD_WORDS = frozenset("article content main story post entry body text prose blog".split())
CUES = re.compile(r"©|\(c\) \d{4}|\b(?:cookies?|all rights reserved|privacy policy|terms of (?:use|service)|newsletter|subscribe|"
                  r"sign (?:in|up)|log ?in|advertisement|sponsored|read more|share this|related (?:posts|articles)|leave a (?:reply|comment))\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    """An open or closed element: its evidence for content (> 0) or boilerplate (< 0)."""
    name: str
    parent: Node | None
    evidence: float
    depth: int


@dataclass
class Block:
    text: str
    link_chars: int
    node: Node
    forced: bool = False
    edges: list = field(default_factory=list)


def _evidence(name: str, attrs: str) -> float:
    if name in ("html", "body"):
        return 0.0
    if name in UNSHOWN:
        return -50.0
    score = GOOD_TAGS.get(name, 0.0) - BAD_TAGS.get(name, 0.0)
    if attrs:
        for key, a, b, c, alone in _ATTR.findall(attrs):
            key, value = (key or alone).lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return -50.0
            if key == "role":
                score += -6.0 if value in BAD_ROLES else 4.0 if value in ("main", "article") else 0.0
            if key in ("class", "id"):
                words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
                if BAD_WORDS.intersection(words):
                    score -= 6.0
                elif GOOD_WORDS.intersection(words):
                    score += 2.0
    return score


def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A)


_ENDS = {name: _end_tag(name) for name in RAW}
_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I | re.A) for name in CLOSED}


def closed_tags(page: str, name: str) -> set[int]:
    """Where the start tags of an element stand that have an end tag. Buttons and
    selections don't lie inside each other: a second one ends the first."""
    found, open_at = set(), []
    for m in _TAGS[name].finditer(page):
        if m[1]:
            if open_at:
                found.add(open_at.pop())
        elif m[0][-2] != "/":
            if name not in UNSHOWN:
                open_at.clear()
            open_at.append(m.start())
    return found


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, white space turned into single spaces."""
    out: list[Block] = []
    root = Node("", None, 0.0, 0)
    node, texts, in_link, link_chars, at = root, [], 0, 0, 0
    in_head = False

    def flush() -> None:
        nonlocal texts, link_chars
        words = "".join(texts).split()
        if words:
            out.append(Block(" ".join(words), link_chars, node))
        texts, link_chars = [], 0

    def say(piece: str) -> None:
        nonlocal link_chars
        if piece and not in_head:
            piece = html.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if in_link:
                link_chars += len(piece.strip())

    def close_to(name: str, stop: frozenset) -> None:
        nonlocal node
        n = node
        while n.parent is not None and n.name != name:
            if n.name in stop:
                return
            n = n.parent
        if n.parent is not None:
            node = n.parent

    closed: dict[str, set[int]] = {}
    endless: set[str] = set()
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            in_head = in_head and not page[at:].strip()
            say(page[at:])
            break
        if in_head and page[at:m.start()].strip():
            in_head = False
        say(page[at:m.start()])
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        is_end = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW and not is_end:
            close = None if name in endless else _ENDS[name].search(page, at)
            if close:
                at = close.end()
            else:
                endless.add(name)
                at = len(page) if name in TO_THE_END else at
            if in_head and name in ("iframe", "textarea"):
                in_head = False
            texts.append(" ")
            continue
        if name == "head":
            in_head = not is_end and not out
            continue
        if in_head and not is_end and name not in HEAD:
            in_head = False
        if name in CLOSED and not is_end:
            if name not in closed:
                closed[name] = closed_tags(page, name)
            if m.start() not in closed[name]:
                texts.append(" ")
                continue
        if name == "br":
            texts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = max(0, in_link + (-1 if is_end else 1))
            continue
        flush()
        in_link = 0
        if is_end:
            close_to(name, frozenset())
            continue
        if name in CLOSES_P:
            close_to("p", frozenset(("table", "td", "div", "article", "section", "li")))
        if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close_to(name, frozenset(("ul", "ol", "dl", "table", "select")))
        if name in VOID:
            continue
        if not attrs.rstrip().endswith("/"):
            node = Node(name, node, _evidence(name, attrs), node.depth + 1)
    flush()
    return out


def unary(b: Block) -> float:
    """Cost of calling the block boilerplate minus that of calling it content: the
    nearest element with evidence counts in full, those around it less and less."""
    score, weight, n = 0.0, 1.0, b.node
    while n is not None:
        if n.evidence:
            if n.evidence <= -50:
                return -50.0
            score += weight * n.evidence
            weight *= 0.3
        n = n.parent
    words = b.text.count(" ") + 1
    dense = b.link_chars / max(1, len(b.text))
    score += min(2.0, words / 20) - 3.0 * (dense > 0.5) - 0.6 * (words < 4)
    if b.node.name in ("p", "blockquote", "pre", "article") or b.node.name in HEADINGS:
        score += 0.8
    if words < 40 and CUES.search(b.text):
        score -= 2.5
    return score


def holder(b: Block) -> Node | None:
    """The nearest element with evidence: the container a block belongs to."""
    n = b.node
    while n is not None and not n.evidence:
        n = n.parent
    return n


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, weight): following blocks, and following siblings under one parent."""
    edges, last = [], {}
    for j, b in enumerate(blocks):
        same_parent = last.get(id(b.node.parent))
        for i in {j - 1, same_parent}:
            if i is not None and i >= 0:
                a = blocks[i]
                near = holder(a) is holder(b)
                apart = abs(a.node.depth - b.node.depth)
                edges.append((i, j, (1.0 if near else 0.15) / (1 + 0.5 * apart)))
        last[id(b.node.parent)] = j
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side. A node with a positive score hangs on
    the source with that capacity, one with a negative score on the sink. Maximum
    flow by shortest augmenting paths over level graphs."""
    n = len(scores)
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def link(u: int, v: int, forth: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(forth)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            link(s, i, x, 0.0)
        else:
            link(i, t, -x, 0.0)
    for i, j, w in edges:
        link(i, j, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(adj[u]):
                e = adj[u][at[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(adj[u]):
                path.append(adj[u][at[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def labelled(page: str | None) -> list[tuple[str, bool]]:
    """(text, is content) of each block of a page in order."""
    blocks = blocks_of(page or "")
    if not blocks:
        return []
    return list(zip([b.text for b in blocks], min_cut([unary(b) for b in blocks], smoothness(blocks)), strict=True))


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    return " ".join(text for text, good in labelled(page) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (its code points) for each
    row of ``pages`` (page_id, url, html).

    A null or empty html has no text. Null ids and urls pass through, repeated rows
    are rows of their own, an empty table gives an empty result, other columns are
    not read. Broken markup is read as far as it goes: an element left open ends
    with the page, a tag cut off by the page's end is dropped."""
    prepare(pages)

    def run(batches):
        for b in batches:
            text = [main_text(p) for p in b.column("html").to_pylist()]
            yield b, None, {"text": text, "n_chars": [len(t) for t in text]}

    return map_arrow(pages.select("page_id", "url", F.col("html")), ["page_id", "url"],
                     {"text": T.StringType(), "n_chars": T.LongType()}, run)
