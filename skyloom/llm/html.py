"""Main text of web pages by minimum cuts.

A page is cut into blocks of text. A logistic classifier, trained here on generated pages
with a fixed seed, gives each block the costs of calling it content and of calling it
boilerplate; these are the capacities of its edges to the two terminals. Edges between
neighbours, and between the nearest blocks under the same element, make a change of label
between them cost something. The minimum cut, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Capacities of the edges between blocks that follow each other, and between blocks of one parent.
NEXT_TO, SIBLINGS = 0.4, 0.6
#: Elements whose text is never shown, that hold no content of their own, that end a
#: block of text, that are never closed, and that an opening tag of a block closes.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title"}
CONTROLS = {"form", "button", "select", "option", "textarea", "input", "label", "fieldset", "legend", "dialog", "menu"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that speak against and for content.
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|foot(?:er)?|gdpr|head(?:er)?|login|masthead|menus?|meta"
    r"|modal|nav(?:bar|igation)?|newsletter|notices?|pager|pagination|popup|promo\w*|recommend\w*|related|repl(?:y|ies)|search|share|sharing|side(?:bar)?"
    r"|signup|skip|social|sponsor\w*|subscri\w+|tags?|toolbar|widgets?|reviews?|discussion|responses?|alert|outbrain|taboola|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|prose)(?:$|[\s_-])", re.IGNORECASE)
_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>|<[/A-Za-z!?][^>]*\Z|[^<]+|<", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Fixed value: elements that may stand in a head; any other that opens, and text, ends it.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
N_FEATURES = 14


@dataclass
class Element:
    tag: str
    number: int
    bad: bool
    good: bool
    hidden: bool


@dataclass
class Block:
    text: str
    path: tuple[Element, ...]
    linked: int = 0
    features: list[float] = field(default_factory=list)


def _element(tag: str, raw: str, number: int) -> Element:
    bad = good = hidden = False
    if len(raw) > len(tag) + 2:
        for m in _ATTRIBUTE.finditer(raw, len(tag) + 1, len(raw) - 1):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style":
                hidden = hidden or "display:none" in value.replace(" ", "").lower()
            elif name in ("class", "id", "role") and tag not in ("html", "body"):
                bad, good = bad or bool(BAD.search(value)), good or bool(GOOD.search(value))
    return Element(tag, number, bad, good, hidden or tag in HIDDEN)


def blocks_of(html: str) -> list[Block]:
    """The shown blocks of text of a page, in order; character references are decoded and white space is single."""
    stack: list[Element] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = number = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e.tag in BLOCKS or e.bad or e.good), min(linked, len(text))))
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal links, hidden
        gone = stack.pop()
        links -= gone.tag == "a"
        hidden -= gone.hidden

    for m in _PARTS.finditer(html):
        part = m[0]
        if part[0] != "<" or part == "<":
            if stack and stack[-1].tag == "head" and part.strip():
                pop()
            if not hidden:
                text = unescape(part)
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        if m[1] or not (tag := _TAG.match(part)) or part[-1] != ">":
            continue
        name = tag[2].lower()
        if not tag[1] and name not in IN_HEAD:
            while stack and (stack[-1].tag == "head" or name == "body" and any(e.tag == "head" for e in stack)):
                pop()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if tag[1]:
            if any(e.tag == name for e in stack):
                while stack[-1].tag != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            closed = CLOSES.get(name, set()) | {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                tag_there = stack[depth].tag
                if tag_there in closed:
                    while len(stack) > depth:
                        pop()
                    if tag_there == "p":
                        break
                elif tag_there in BLOCKS:
                    break
        if part.endswith("/>") and name not in BLOCKS:
            continue
        number += 1
        e = _element(name, part, number)
        stack.append(e)
        links += name == "a"
        hidden += e.hidden
    flush()
    return out


def featured(blocks: list[Block]) -> np.ndarray:
    """A row of features for each block."""
    rows = []
    for b in blocks:
        tags = {e.tag for e in b.path}
        last = b.path[-1].tag if b.path else ""
        words = b.text.count(" ") + 1
        bad = any(e.bad for e in b.path)
        rows.append([
            1.0,
            float(bad),
            float(any(e.good for e in b.path) and not bad),
            float(bool(tags & {"article", "main"})),
            float(bool(tags & {"nav", "aside", "footer"})),
            float("header" in tags and "article" not in tags and "main" not in tags),
            float(bool(tags & CONTROLS)),
            b.linked / max(1, len(b.text)),
            min(words, 60) / 60,
            float(words < 5),
            float(last == "p" or last in ("blockquote", "pre", "figcaption")),
            float(last[:1] == "h" and last[1:].isdigit()),
            float(last == "li" or last in ("td", "th", "dt", "dd")),
            min(5, sum(b.text.count(c) for c in ".,;")) / 5,
        ])
    return np.array(rows).reshape(len(blocks), N_FEATURES)


class Flow:
    """Maximum flow by shortest augmenting layers (Dinic), without recursion."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Whether each node is on the source's side of the minimum cut."""
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            node = s
            while True:
                if node == t:
                    least = min(self.room[e] for e in path)
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    full = next(k for k, e in enumerate(path) if self.room[e] <= 1e-12)
                    node = self.to[path[full] ^ 1]
                    del path[full:]
                while at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[node] + 1:
                        path.append(e)
                        node = self.to[e]
                        break
                    at[node] += 1
                else:
                    if not path:
                        break
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
        return [x >= 0 for x in level]


def cut_labels(scores: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks the cheapest labelling calls content; ``scores`` are log odds, ``edges`` (i, j, capacity)."""
    n = len(scores)
    flow = Flow(n + 2)
    for i, x in enumerate(scores.tolist()):
        if x > 0:
            flow.edge(n, i, x)
        elif x < 0:
            flow.edge(i, n + 1, -x)
    for i, j, c in edges:
        flow.edge(i, j, c, c)
    return flow.source_side(n, n + 1)[:n]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker the less of their paths they share, and between the nearest blocks of a parent."""
    edges = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].path, blocks[i].path
        shared = 0
        for x, y in zip(a, b, strict=False):
            if x.number != y.number:
                break
            shared += 1
        edges.append((i - 1, i, NEXT_TO * shared / max(1, len(a), len(b))))
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.path[-2].number if len(b.path) > 1 else 0
        if parent in last:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    return edges


def _generated(rng: np.random.Generator) -> Iterator[tuple[str, list[bool]]]:
    """Pages whose blocks bear the marks + (content) and - (boilerplate) in front."""
    n = rng.integers

    def words(a: int, b: int) -> str:
        return " ".join("abcdefghij"[: n(1, 9)] for _ in range(n(a, b))) + ".," [n(2)]

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">-{words(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    bad = ("ad", "sidebar", "cookie-notice", "comments", "related", "share", "newsletter", "menu", "site-header", "promo", "advert", "footer", "widget", "comment")
    for _ in range(160):
        page = ""
        if n(4):
            page += f"<nav>{links(n(2, 8))}</nav>"
        if n(3) == 0:
            page += f"<header><div>-{words(1, 6)}</div></header>"
        for _ in range(n(0, 3)):
            page += f'<div class="{bad[n(len(bad))]}">' + "".join(f"<p>-{words(3, 60)}</p>" for _ in range(n(1, 4))) + "</div>"
        body = f"<h1>+{words(2, 10)}</h1>"
        for _ in range(n(1, 10)):
            kind = n(12)
            if kind == 0:
                body += f"<h2>+{words(1, 6)}</h2>"
            elif kind == 1:
                body += "<ul>" + "".join(f"<li>+{words(2, 14)}</li>" for _ in range(n(2, 5))) + "</ul>"
            elif kind == 2:
                body += f'<div class="{bad[n(len(bad))]}">-{words(2, 25)}</div>'
            elif kind == 3:
                body += f"<form><p>-{words(1, 20)}</p></form>"
            elif kind == 4:
                body += f"<aside><p>-{words(2, 30)}</p></aside>"
            elif kind == 5:
                body += f"<blockquote>+{words(4, 30)}</blockquote>"
            else:
                body += f"<p>+{words(1, 80)}</p>"
        page += (f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="content">{body}</div>', f"<article>{body}</article>")[n(4)]
        for _ in range(n(0, 3)):
            page += f'<section class="{bad[n(len(bad))]}">' + "".join(f"<p>-{words(3, 60)}</p>" for _ in range(n(1, 4))) + "</section>"
        if n(4):
            page += f"<footer><p>-{words(3, 20)}</p></footer>"
        yield page, []


@lru_cache(maxsize=2)
def trained_weights(seed: int = 6, rounds: int = 400) -> np.ndarray:
    """Weights of the features, by penalised maximum likelihood on generated pages."""
    xs, ys = [], []
    for page, _ in _generated(np.random.default_rng(seed)):
        found = blocks_of(page)
        ys += [b.text[0] == "+" for b in found]
        for b in found:
            b.text = b.text[1:]
        xs.append(featured(found))
    x, y = np.concatenate(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def main_text(html: str, weights: np.ndarray) -> str:
    """The content blocks of a page in order, one a line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = cut_labels(featured(blocks) @ weights, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract_main_text(df: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``df`` (page_id, url, html).

    A null or empty html, and a page without content, has the text ''. Tags that are cut off at
    the end, never closed or closed twice are taken as browsers do, roughly. Whole pages of any
    length are read, repeated rows one by one; other columns are not looked at.
    """
    weights = trained_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return df.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
