"""HTML extraction by minimum-cut labelling.

A page is read once into blocks of text (what stands between block-level tags, and inline elements whose name tells), each with its
innermost element. A logistic classifier, trained on the marked pages of `html_seed`, gives each block the log-odds of being content from bounded features: its
length, its share of link text, its closing mark, its tag, the nearest landmark (article, nav, ...), and the names (class, id, role) of the
elements around it. A block's log-odds are the capacity of its edge to one of the two terminals. Blocks that follow
each other are joined by an edge, and so are blocks that follow each other under one parent; an edge is weaker the
further apart the blocks are in the tree, and the more what the landmarks or named elements around them tell differs. The minimum cut separates content from boilerplate.
What it decides are the blocks whose own features are weak: headings, captions, short paragraphs and list items take the side of their surroundings. Blocks whose
cost outweighs all their edges keep their label in every minimum cut and are joined to their terminal first; a maximum flow is worked out over the others,
one connected part after the other.

The text is the content blocks, character references decoded, white space to single spaces, joined by a space. Inline elements that are
dropped leave no trace, those that are kept stay glued to the text around them.

Defined results: null and empty html give an empty text; unclosed tags, comments and scripts end with the page; hidden elements are not content;
repeated rows are each extracted; an empty table gives an empty one. Reading a page takes time in proportion to its length, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import importable
from granary.llm.html_seed import PAGES

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is never text of the page.
RAW = frozenset("script style textarea title noscript iframe template object audio video canvas svg select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul button label".split()
)
CLOSE_P = BREAKS - {"br", "body", "html", "head", "option", "button", "label", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "figcaption"}
P_SCOPE = frozenset("p td th li div article section main button".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": set()}
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset label search".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adv banner promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar rail widget widgets menu nav navbar navigation navigate breadcrumb breadcrumbs "
    "footer foot copyright comment comments commentlist reply replies respond disqus pagination pager toolbar search masthead topbar skip tags header head "
    "discussion discussions guestbook kommentar kommentare commentaire commentaires comentario comentarios seitenleiste randspalte werbung anzeige anzeigen fusszeile kopfzeile "
    "publicite pied entete publicidad lateral cabecera".split()
)
GOOD_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion discussions guestbook kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Words for the shape of an element: behind another word they leave it what it is (share-buttons); other words make it theirs (share-prices).
SHAPES = frozenset(
    "box block bar area section panel pane wrap wrapper container inner outer left right top bottom list item items slot unit link links button buttons icon icons form field fields group row rows "
    "col column columns title label text body content posts stories articles count meta zone region holder module message info line strip".split()
)
#: What follows these in a name says what the element comes with, not what it is.
MODIFIERS = frozenset("with has no without hide show is".split())
FEATURES = ("one", "length", "short", "linked", "closed", "paragraph", "heading", "item", "landmark", "landmark_around", "name_within", "name_same", "name_around", "comment")
#: Ridge of the fit.
RIDGE = 0.02
#: Certain labels.
HIDDEN = -1000.0
#: Edges: between blocks of one parent, and what two that follow each other have besides.
CLOSE, NEXT = 1.8, 0.6


class Element:
    """`landmark` and `name` are those of the nearest element (itself included) that has one, with that element's depth; `region` is the nearest
    element that has either, and `tells` what it says (-1 to 1)."""

    __slots__ = ("tag", "parent", "depth", "landmark", "landmark_depth", "name", "name_depth", "comment", "hidden", "region", "tells", "opened")

    def __init__(self, tag: str, parent: Element | None, landmark: int = 0, name: float = 0.0, comment: bool = False, hidden: bool = False):
        self.tag, self.parent, self.opened = tag, parent, 0
        if parent is None:
            self.depth, self.landmark, self.landmark_depth, self.name, self.name_depth, self.comment, self.hidden, self.region, self.tells = 0, 0, -1, 0.0, -1, False, False, self, 0.0
            return
        self.depth = d = parent.depth + 1
        self.landmark, self.landmark_depth = (landmark, d) if landmark else (parent.landmark, parent.landmark_depth)
        self.name, self.name_depth = (name, d) if name else (parent.name, parent.name_depth)
        self.comment, self.hidden = comment or parent.comment, hidden or parent.hidden
        self.region = self if landmark or name or hidden else parent.region
        self.tells = (landmark + name) / (2 if landmark and name else 1) if landmark or name else parent.tells


def name_value(name: str) -> float:
    """-1 to 1 for one name: the share of its words that tell; what holds good and bad words is bad by half (comment-content). A name is about its last words: a bad
    word before others tells only if these are shapes (menu-bar, not menu-planning), unless it is about readers."""
    words = [x.lower() for x in WORD.findall(name)]
    for k, w in enumerate(words):
        if w in MODIFIERS:
            words = words[:k]
            break
    good, bad = [k for k, w in enumerate(words) if w in GOOD_WORDS], [k for k, w in enumerate(words) if w in BAD_WORDS]
    if bad and not any(w in COMMENT_WORDS for w in words) and any(w not in SHAPES and not w.isdigit() for w in words[bad[-1] + 1 :]):
        return 0.0  # the last word says what it is, and it is none of these
    if good and bad:
        return -0.5
    return (len(good) - len(bad)) / len(words) if words else 0.0


@lru_cache(maxsize=4096)
def telling(tag: str, attributes: str) -> tuple[int, float, bool, bool]:
    """Landmark (-1, 0, 1), value of the names (-1 to 1), whether it holds reader comments, whether it is hidden."""
    landmark = -1 if tag in BAD_TAGS else 1 if tag in GOOD_TAGS else 0
    values, comment, hidden = [], False, False
    if "=" in attributes or "hidden" in attributes:
        for m in NAMED.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden":
                hidden = True
            elif kind == "style":
                hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif kind == "role":
                if value.lower() in BAD_ROLES:
                    landmark = -1
                elif value.lower() in ("main", "article"):
                    landmark = 1
            else:
                for x in value.split():
                    v = name_value(x)
                    if v:
                        values.append(v)
                        comment = comment or v < 0 and any(w.lower() in COMMENT_WORDS for w in WORD.findall(x))
    if tag in ("html", "body"):  # their names are about the whole page
        return 0, 0.0, False, hidden
    return landmark, sum(values) / len(values) if values else 0.0, comment, hidden


class Piece:
    """A stretch of text with one innermost element; pieces of one block (number) are glued."""

    __slots__ = ("block", "raw", "text", "element", "linked")

    def __init__(self, block: int, raw: str, element: Element, linked: int):
        self.block, self.raw, self.element = block, raw, element
        self.text = " ".join(raw.split())
        self.linked = min(1.0, linked / len(self.text)) if self.text else 0.0


def pieces(html: str) -> list[Piece]:
    """The page's stretches of text. A form that holds most of the text is the page's frame, not a form."""
    out, forms = _pieces(html, frozenset())
    if forms:
        size = {id(e): 0 for e in forms}
        for p in out:
            e = p.element
            while e is not None:
                if id(e) in size:
                    size[id(e)] += len(p.text)
                e = e.parent
        frames = frozenset(k for k, e in enumerate(forms) if 2 * size[id(e)] > sum(len(p.text) for p in out))
        if frames:
            return _pieces(html, frames)[0]
    return out


def _pieces(html: str, frames: frozenset[int]) -> tuple[list[Piece], list[Element]]:
    """Pieces and the forms of the page; those with a number in `frames` tell nothing."""
    forms: list[Element] = []
    out: list[Piece] = []
    root = top = Element("", None)
    text: list[str] = []
    open_: dict[str, int] = {}
    linked = in_link = at = block = 0

    def flush(new_block: bool = True) -> None:
        nonlocal linked, block
        if text:
            raw = unescape("".join(text))
            if raw.strip():
                out.append(Piece(block, raw, top, linked))
            elif out and out[-1].block == block:
                out[-1].raw += " "
            text.clear()
        linked = 0
        block += new_block

    def close(e: Element) -> None:
        """e and what is open inside it."""
        nonlocal top
        while top is not e:
            open_[top.tag] -= 1
            top = top.parent
        open_[e.tag] -= 1
        top = e.parent

    while True:
        m = TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BREAKS:
                flush()
                if open_.get(tag):
                    e = top
                    while e.tag != tag:
                        e = e.parent
                    close(e)
            elif top.tag == tag and top is not root:  # an inline element that tells
                if top.opened:
                    top.opened -= 1
                else:
                    flush(False)
                    close(top)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
                at = end.end()
            continue
        if tag == "a":
            in_link = 1
        if tag not in BREAKS:
            if tag in VOID or m[3].endswith("/"):
                continue
            landmark, name, comment, hidden = telling(tag, m[3]) if m[3] else (0, 0.0, False, False)
            if hidden or name < 0 or landmark < 0:
                flush(False)
                top = Element(tag, top, landmark, name, comment, hidden)
                open_[tag] = open_.get(tag, 0) + 1
            elif top.tag == tag:
                top.opened += 1
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSE_P and open_.get("p"):
            e = top
            while e is not root and e.tag not in P_SCOPE:
                e = e.parent
            if e.tag == "p":
                close(e)
        if tag in SAME and any(open_.get(x) for x in SAME[tag]):
            e = top
            while e is not root and e.tag not in SAME[tag] and e.tag not in HOLDS[tag]:
                e = e.parent
            if e is not root and e.tag in SAME[tag]:
                close(e)
        landmark, name, comment, hidden = telling(tag, m[3])
        if tag == "header" and top.landmark <= 0:
            landmark = -1
        if tag == "form" and len(forms) in frames:
            landmark, name = 0, 0.0
        top = Element(tag, top, landmark, name, comment, hidden)
        if tag == "form":
            forms.append(top)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out, forms


def features(p: Piece) -> list[float]:
    e, n = p.element, len(p.text)
    where = 0 if e.name_depth > e.landmark_depth else 1 if e.name_depth == e.landmark_depth else 2
    return [
        1.0, min(n, 240) / 240, float(n < 25), p.linked, float(p.text[-1] in ".!?:\"”»…。！？"), float(e.tag in ("p", "blockquote", "pre")), float(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(e.tag in ("li", "dd", "dt", "td", "th", "figcaption")),
        float(e.landmark) if where else 0.0, 0.0 if where else float(e.landmark), *[e.name if where == k else 0.0 for k in range(3)], float(e.comment),
    ]


def fit(pages=PAGES, ridge: float = RIDGE, rounds: int = 30) -> list[float]:
    """Weights of a logistic model on marked pages: the text of each block starts with + (content) or -. Newton steps on the ridge loss."""
    rows, marks = [], []
    for page in pages:
        for p in pieces(page):
            marks.append(p.text[0] == "+")
            assert p.text[0] in "+-", p.text
            p.text = p.text[2:]
            rows.append(features(p))
    x, y = np.array(rows), np.array(marks, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge * len(y) / 10 * np.eye(len(w)), x.T @ (q - y) + ridge * len(y) / 10 * w)
    return w.tolist()


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    return tuple(fit())


def cost(p: Piece, w: tuple[float, ...]) -> float:
    """Log-odds of content: its size is what the wrong label costs."""
    return HIDDEN if p.element.hidden else sum(a * b for a, b in zip(w, features(p), strict=True))


def near(a: Element, b: Element) -> float:
    """Weight of an edge: halves with each step of the tree between two blocks."""
    steps = 0
    while a is not b and steps < 7:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return CLOSE / (1 << max(0, min(steps, 7) - 1))


def kinship(a: Element, b: Element) -> float:
    """What is left of an edge between two regions, by how far what they tell differs."""
    return 1.0 if a.region is b.region else max(0.0, 1.0 - abs(a.tells - b.tells)) * 0.8


def cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of a minimum cut (True: content); of several one with most content among what the flow decides."""
    n = len(score)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        beside[i][j] = beside[i].get(j, 0) + w
        beside[j][i] = beside[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    own = list(score)
    open_ = list(range(n))
    while open_:  # blocks that their cost decides, and then those that the decided ones decide
        i = open_.pop()
        if label[i] is None and abs(own[i]) >= sum(beside[i].values()):
            label[i] = own[i] >= 0
            for j, w in beside[i].items():
                del beside[j][i]
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    open_.append(j)
            beside[i] = {}
    for i in range(n):  # the others, one connected part after the other
        if label[i] is None:
            part, seen = [i], {i}
            for x in part:
                for y in beside[x]:
                    if y not in seen:
                        seen.add(y)
                        part.append(y)
            place = {x: k for k, x in enumerate(part)}
            for x, content in zip(part, maximum_flow([own[x] for x in part], [{place[y]: w for y, w in beside[x].items()} for x in part]), strict=True):
                label[x] = content
    return [bool(x) for x in label]


def maximum_flow(own: list[float], beside: list[dict[int, float]]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut: by blocking flows along shortest paths; those that can't reach the boilerplate terminal any more."""
    s, t = len(own), len(own) + 1
    room: list[dict[int, float]] = [dict(d) for d in beside] + [{}, {}]
    for k, c in enumerate(own):
        if c > 0:
            room[s][k], room[k][s] = c, 0.0
        elif c < 0:
            room[k][t], room[t][k] = -c, 0.0
    while True:
        level = {s: 0}
        queue = [s]
        for x in queue:
            for y, c in room[x].items():
                if c > 1e-9 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if t not in level:
            break
        ways = {x: iter(list(room[x])) for x in level}
        path = [s]
        while path:
            x = path[-1]
            if x == t:
                least = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                back = 0
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                    if room[a][b] <= 1e-9 and not back:
                        back = k + 1
                del path[back:]
                continue
            for y in ways[x]:
                if level.get(y) == level[x] + 1 and room[x][y] > 1e-9:
                    path.append(y)
                    break
            else:
                path.pop()
                level[x] = -1
    reach = {t}
    queue = [t]
    for y in queue:
        for x in room[y]:
            if x not in reach and room[x].get(y, 0.0) > 1e-9:
                reach.add(x)
                queue.append(x)
    return [k not in reach for k in range(len(own))]


def labelled(found: list[Piece], w: tuple[float, ...]) -> list[bool]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, p in enumerate(found):
        e = p.element
        if i:
            edges[i - 1, i] = kinship(found[i - 1].element, e) * (NEXT + near(found[i - 1].element, e))
        parent = id(e.parent) if e.parent is not None else 0
        j = last.get(parent, i - 1)
        if j != i - 1:
            edges[j, i] = kinship(found[j].element, e) * near(found[j].element, e)
        last[parent] = i
    return cut([cost(p, w) for p in found], edges)


def main_text(html: str | None, w: tuple[float, ...] | None = None) -> str:
    found = pieces(html) if html else []
    if not found:
        return ""
    out: list[list[str]] = []
    block = -1
    for p, keep in zip(found, labelled(found, w or weights()), strict=True):
        if keep:
            if p.block != block:
                out.append([])
                block = p.block
            out[-1].append(p.raw)
    return " ".join(" ".join("".join(x).split()) for x in out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    importable(pages.sparkSession)
    w = weights()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), w) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
