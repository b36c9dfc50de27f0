"""HTML extraction by minimum-cut labelling.

A page's text blocks and the elements that hold them are the nodes of a graph. Log-linear classifiers give the costs
of labelling each content and boilerplate, which become terminal capacities. DOM proximity (element and child) and adjacency
(neighbouring blocks) become smoothness edges. The minimum cut labels all nodes; blocks on the source's side stay.

The classifier of blocks is trained on the pages themselves: blocks that their page's own elements call an article's
are examples of content, those below menus, footers, forms and the like of boilerplate, and what a block looks like
(its element, words, links, depth, last character) must tell the two apart. So blocks that no element speaks for are judged
by their likes. What an element's name says is stated below; its classes are one more word against it.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import map_texts

#: Comments, raw elements with all they hold, tags and declarations. A tag whose quotes don't close ends at its first '>' or before the next '<'.
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|select|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)(?:((?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*+)>|([^<>]*)(?:>|(?=<)|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ALONE = frozenset("p li tr td th dt dd option".split())
#: Weights of an element's log odds for content, by its name.
_ELEMENT = {"article": 5.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "button": -9.0, "dialog": -9.0, "menu": -9.0, "noscript": -9.0, "svg": -9.0, "header": -6.0, "head": -20.0, "title": -20.0}
#: A class, id or role speaks against content if it is such a word, or joins such a word with a word for a part of a page.
_HINT = "ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|cookie|cookies|consent|notice|alert|popup|modal|newsletter|subscribe|signup|comment|comments|replies|disqus|related|share|sharing|social|widget|login|search"
_PART = r"bar|box|block|area|container|wrap|wrapper|section|list|links?|form|item|items|banner|text|inner|outer|top|bottom|left|right|main|site|page|post|article|content|slot|unit|widget|buttons?|icons?|thread|\d+"
_CLASS = re.compile(rf"(?:(?:{_PART})[_-])*(?:{_HINT})(?:[_-](?:{_PART}|{_HINT}))*", re.I)
#: Words that speak against an element wherever they stand in a class, id or role; the last ones against an article too: that of a reader.
_STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo disqus cookie cookies newsletter comment comments reply replies responses".split())
_READERS = frozenset("comment comments reply replies responses".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HINT_WEIGHT = -9.0
#: Log odds of a block lie between these, so that one in an article stays by what the article's edges cost; and what speaks against a block beside a page's article.
_LEAST, _MOST, _BESIDE = -4.5, 3.0, -6.0
#: Smoothness. What it costs to keep a child of boilerplate, and to leave out a child of content: a block below a sure
#: element, a block elsewhere, an element of no evidence. Then for neighbouring blocks of one element, and of two.
#: What holds for elements counts once for each block below them, so an element's evidence weighs as much as its blocks'.
_DOWN, _SURE, _LOOSE, _SAME, _NEAR, _ADJACENT = 12.0, 5.0, 0.3, 3.0, 1.0, 0.2
_SPACE = re.compile(r"\s+")


#: What a block looks like: its element, words, links, depth, last character; how many values each may take.
_LOOKS = (6, 7, 3, 5, 2)
_KINDS = {"p": 0, "li": 2, "dd": 2, "dt": 2, "td": 3, "th": 3, "div": 4, "section": 4}


def looks(name: str, text: str, linked: int, depth: int) -> tuple[int, ...]:
    """A block as a tuple of small numbers, one below each of _LOOKS."""
    kind = 1 if len(name) == 2 and name[0] == "h" and name[1].isdigit() else _KINDS.get(name, 5)
    share = 0 if not linked else 2 if linked > len(text) / 2 else 1
    return (kind, min((text.count(" ", 0, 400) + 1).bit_length(), 6), share, min(depth // 2, 4), int(text[-1] in ".!?…:;\"”»"))


class Model:
    """Log odds of content by what a block looks like: a weight for each value, fitted by Newton steps to counts of examples.

    Both labels weigh alike, whatever their numbers. Without examples of both, blocks of many words without links are
    content.
    """

    def __init__(self, counts: list[tuple[tuple[int, ...], bool, int]]):
        starts = np.concatenate([[0], np.cumsum(_LOOKS)])
        self.starts, size = starts[:-1].tolist(), int(starts[-1]) + 1
        total = [sum(n for _, label, n in counts if label is bool(v)) for v in (0, 1)]
        w = np.zeros(size)
        if not all(total):
            w[-1] = -1.0
            w[self.starts[1] : self.starts[1] + _LOOKS[1]] = [0.0, 0.4, 1.0, 2.0, 3.0, 4.0, 4.0]
            w[self.starts[0]] = 1.0
            w[self.starts[2] + 2] = -4.0
            self.w = w.tolist()
            return
        x = np.zeros((len(counts), size))
        x[:, -1] = 1.0
        for i, (look, _, _) in enumerate(counts):
            x[i, [a + v for a, v in zip(self.starts, look, strict=True)]] = 1.0
        y = np.array([label for _, label, _ in counts], float)
        weight = np.array([n / total[label] for _, label, n in counts]) * 500
        for _ in range(25):
            odds = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * odds * (1 - odds))[:, None]).T @ x + np.eye(size), x.T @ (weight * (y - odds)) - w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.w = np.round(w, 9).tolist()

    def odds(self, look: tuple[int, ...]) -> float:
        return min(max(self.w[-1] + sum(self.w[a + v] for a, v in zip(self.starts, look, strict=True)), _LEAST), _MOST)


def _against(attrs: str, article: bool) -> bool:
    """Whether a class, id or role speaks against an element; of an article only what names it a reader's."""
    for c in " ".join("".join(v) for v in _NAMED.findall(attrs)).split():
        words = {w.lower() for w in _WORD.findall(c)}
        if words & (_READERS if article else _STRONG) or not article and _CLASS.fullmatch(c):
            return True
    return False


class Graph:
    """Text blocks and elements of a page, with the log odds of each and edges (a, b, cost if only a is content, cost if only b is)."""

    def __init__(self, page: str, model: Model):
        self.examples: list[tuple[tuple[int, ...], bool]] = []  # blocks that elements above them speak for or against
        outside: list[int] = []  # blocks below no article and nothing that speaks against them
        inside = False
        self.odds: list[float] = [0.0]  # node 0 is the page
        self.edges: list[tuple[int, int, float, float]] = []
        self.texts: list[str] = []
        self.nodes: list[int] = []  # the node of each text
        above: list[tuple[int, int, float]] = []  # elements that hold something: node, parent, what leaving it out costs
        held: list[int] = []  # the element of each block
        parts: list[str] = []
        linked = 0
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, node, below an article, below what speaks against it
        at, link, last = 0, 0, None

        def text(raw: str) -> None:
            nonlocal linked
            if raw:
                raw = html.unescape(raw)
                parts.append(raw)
                if link:
                    linked += len(raw)

        def close() -> None:
            nonlocal linked, last, inside
            got = _SPACE.sub(" ", "".join(parts)).strip() if parts else ""
            if got:
                name, parent, sure, against = stack[-1]
                node = len(self.odds)
                look = looks(name, got, linked, len(stack))
                self.odds.append(model.odds(look))
                if sure or against:
                    self.examples.append((look, not against))
                    inside = inside or not against
                else:
                    outside.append(node)
                self.edges.append((parent, node, _SURE if sure else _LOOSE, _DOWN))
                held.append(parent)
                if last:
                    near = _NEAR if last[1] == parent else _ADJACENT
                    self.edges.append((last[0], node, near, near))
                last = (node, parent)
                self.texts.append(got)
                self.nodes.append(node)
            parts.clear()
            linked = 0

        for m in _PIECE.finditer(page):
            text(page[at : m.start()])
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                continue
            if name == "a":
                link = 0 if m[2] else 1
            if name in _INLINE:
                if name == "br" and parts:
                    parts.append(" ")
                continue
            close()
            if m[2]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in _VOID:
                if name in _ALONE and stack[-1][0] == name:
                    stack.pop()
                _, parent, sure, against = stack[-1]
                weight = 0.0 if name == "header" and sure else _ELEMENT.get(name, 0.0)  # an article's own head
                attrs = m[4] or m[5]
                if attrs and name not in ("html", "body", "main") and _against(attrs, name == "article"):
                    weight = min(weight, 0.0) + _HINT_WEIGHT
                if weight or name not in _ALONE and not re.fullmatch("h[1-6]", name):
                    node = len(self.odds)
                    self.odds.append(weight)
                    # An element with evidence of its own may differ from content that holds it for nothing.
                    above.append((node, parent, 0.0 if weight else _SAME if sure else _LOOSE))
                    stack.append((name, node, weight > 0 or sure and not weight, against or weight < 0))
                else:  # a paragraph is no node of its own
                    stack.append((name, parent, sure, against))
        text(page[at:])
        close()
        if inside:
            for node in outside:
                self.odds[node] += _BESIDE
        blocks = [0] * len(self.odds)
        for parent in held:
            blocks[parent] += 1
        for node, parent, _ in reversed(above):  # a parent's number is the smaller one
            blocks[parent] += blocks[node]
        for node, parent, cost in above:
            self.odds[node] *= blocks[node]
            self.edges.append((parent, node, cost * blocks[node], _DOWN * blocks[node]))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; of several, of that with the fewest such nodes.

    Node i has terminal capacities max(odds, 0) and max(-odds, 0); an edge (a, b, c, d) costs c if only a is on the
    source's side, d if only b is. Nodes whose odds outweigh all of their edges are settled first, which moves the
    edges' costs to their neighbours; level graphs and blocking flows (Dinic) settle the rest.
    """
    n = len(odds)
    odds, near = list(odds), [[] for _ in range(n)]
    for a, b, c, d in edges:
        near[a].append((b, c, d))
        near[b].append((a, d, c))
    side: list[bool | None] = [None] * n
    keep, lose = [sum(c for _, c, _ in x) for x in near], [sum(d for _, _, d in x) for x in near]
    todo = deque(range(n))
    while todo:
        a = todo.popleft()
        if side[a] is not None:
            continue
        if odds[a] > keep[a]:
            side[a] = True
        elif -odds[a] >= lose[a]:
            side[a] = False
        else:
            continue
        for b, c, d in near[a]:
            if side[b] is None:
                # (c: only a, d: only b) Now a is known, its edge is a capacity of b.
                odds[b] += c if side[a] else -d
                keep[b] -= d
                lose[b] -= c
                todo.append(b)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(x) for x in side]
    # What is left: arcs as parallel lists, an arc and its reverse side by side.
    number = {i: k for k, i in enumerate(rest)}
    m = len(rest)
    heads: list[list[int]] = [[] for _ in range(m + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, c: float, d: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(c)
        heads[b].append(len(to))
        to.append(a)
        room.append(d)

    for i in rest:
        if odds[i] > 0:
            arc(m, number[i], odds[i], 0.0)
        elif odds[i] < 0:
            arc(number[i], m + 1, -odds[i], 0.0)
    for a, b, c, d in edges:
        if side[a] is None and side[b] is None and (c or d):
            arc(number[a], number[b], c, d)
    while True:
        level = [-1] * (m + 2)
        level[m] = 0
        queue = deque([m])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[m + 1] < 0:
            break
        nxt = [0] * (m + 2)
        path: list[int] = []
        a = m
        while True:
            if a == m + 1:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                while room[path[-1]] > 1e-9 or any(room[e] <= 1e-9 for e in path[:-1]):
                    path.pop()
                a = to[path.pop() ^ 1]
                continue
            for k in range(nxt[a], len(heads[a])):
                e = heads[a][k]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    nxt[a] = k
                    path.append(e)
                    a = to[e]
                    break
            else:
                nxt[a] = len(heads[a])
                if a == m:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
    for i in rest:
        side[i] = level[number[i]] >= 0
    return [bool(x) for x in side]


def main_text(page: str | None, model: Model | None = None) -> str:
    """The main text: content blocks in page order, joined by newlines; a null or empty page has none."""
    graph = Graph(page or "", model or Model([]))
    if not graph.texts:
        return ""
    keep = minimum_cut(graph.odds, graph.edges)
    return "\n".join(t for t, i in zip(graph.texts, graph.nodes, strict=True) if keep[i])


def train(pages: DataFrame, column: str = "html") -> Model:
    """The classifier of blocks, from all of `pages`: examples are counted by what they look like, which takes a few hundred values, and the counts are what it is fitted to."""

    def count(batches):
        blank = Model([])
        for batch in batches:
            n: dict = {}
            for i in range(batch.num_rows):
                page = batch.column(0)[i].as_py()
                for example in Graph(page, blank).examples if page else ():
                    n[example] = n.get(example, 0) + 1
            keys = sorted(n)
            yield pa.RecordBatch.from_arrays([pa.array([list(look) for look, _ in keys], pa.list_(pa.int32())), pa.array([label for _, label in keys], pa.bool_()), pa.array([n[k] for k in keys], pa.int64())], ["look", "label", "n"])

    rows = pages.select(column).mapInArrow(count, "look array<int>, label boolean, n long").groupBy("look", "label").agg(F.sum("n").alias("n")).collect()
    return Model(sorted((tuple(r.look), r.label, r.n) for r in rows))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with text and n_chars; a row in gives a row out.

    The classifier is trained on all of `pages` first. A block beside a page's article is boilerplate unless its looks say otherwise very
    surely; on a page without one, its looks and neighbours decide.

    A null or empty page, and one of markup only, gives an empty text. Broken markup never fails: tags that aren't
    closed end with the page, quotes that aren't closed end with their tag. Pages of any length go through whole;
    memory follows the longest. Repeated rows give equal texts; columns named text or n_chars give way, others stay.
    An empty table gives an empty table, and pages without examples are judged by words and links alone.
    """
    model = train(pages, column)

    def make():
        def f(got, _):
            out = [main_text(p, model) for p in got]
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

        return f

    return map_texts(pages, make, [("text", T.StringType()), ("n_chars", T.LongType())], column=column, rows=256)
