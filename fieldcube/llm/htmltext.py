"""Main text of web pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import html
import random
import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .util import append_columns, table

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never counts; the content of the first ones is not markup.
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select menu dialog svg object canvas audio video".split())
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr caption blockquote pre figure figcaption address hr fieldset details summary center hgroup".split()) | DROPPED
CLOSES_P = BLOCKS - frozenset(["button", "script", "style", "noscript", "template", "svg", "canvas", "object", "audio", "video", "iframe", "select"])
SCOPES = frozenset("html body article main section div table blockquote figure".split()) | (DROPPED - RAW)
#: Words in a class or id that speak against or for an element.
AGAINST = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar copyright legal tags".split()
)
FOR = frozenset("article content main post entry story body text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """Text pieces of one block, where it stands in the tree, and how many characters are links."""

    tag: str
    parent: int
    depth: int
    marks: frozenset[str]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marks(tag: str, attrs: str, outer: frozenset[str]) -> frozenset[str]:
    """What a tag and its attributes tell of the text inside, added to what the elements around it tell."""
    found = set(outer)
    if tag in DROPPED and not (tag == "header" and "article" in outer):
        found.add("dropped")
    if tag in ("article", "main"):
        found.add("article")
    for m in ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = {w.lower() for w in WORDS.findall(value)}
            if words & AGAINST and tag not in ("body", "html", "article", "main"):
                found.add("against")
            if words & FOR:
                found.add("for")
        elif name == "role":
            found |= {"dropped"} if value.lower() in ROLES else {"article"} if value.lower() in ("main", "article") else set()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.add("dropped")
    return outer if len(found) == len(outer) else frozenset(found)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; broken markup is read as far as it goes."""
    # Open elements: tag, number, marks, inside a link.
    stack: list[tuple[str, int, frozenset[str], bool]] = [("", 0, frozenset(), False)]
    out: list[Block] = []
    block: Block | None = None
    number, at = 0, 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece or (block is None and piece.isspace()):
            return
        if block is None:
            near = next((e for e in reversed(stack) if e[0] in BLOCKS), stack[0])
            depth = sum(e[0] in BLOCKS for e in stack)
            top = stack[-1]
            block = Block(near[0], stack[max(0, len(stack) - 2)][1] if near is stack[-1] else near[1], depth, top[2])
            out.append(block)
        block.pieces.append(piece)
        if stack[-1][3]:
            block.linked += len(piece)

    while at < len(page):
        m = MARKUP.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br" or (tag in ("td", "th", "img", "option") and block is not None):
            text(" ")
        if tag in BLOCKS:
            block = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break  # an inner close tag without an open one
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag not in ("noscript", "template"):
                at = end.end() if end else len(page)
                continue
        if tag in CLOSES_P or tag == "li":
            close = {"p"} | ({"li"} if tag == "li" else set()) | ({tag} if tag in ("tr", "dt", "dd") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in close:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES or stack[k][0] in ("ul", "ol"):
                    break
        number += 1
        up = stack[-1]
        stack.append((tag, number, _marks(tag, attrs, up[2]), up[3] or tag == "a"))
    for b in out:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
    return [b for b in out if b.text]


#: The features of a block, and the most that one or all of them may weigh, so that neighbours can outvote a block.
FEATURES = ("one", "words", "linked", "sentence", "commas", "p", "heading", "item", "depth", "dropped", "article", "against", "for")
#: Text features weigh up to the first, what elements around a block tell up to the second.
MOST_WEIGHT, MOST_MARK, MOST_COST = 4.0, 1.5, 5.0


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: length, links, punctuation, tag, depth and marks of the elements around it; nothing of its neighbours, which are the cut's part."""
    words = np.array([b.text.count(" ") + 1 for b in blocks])
    return np.array(
        [
            (1, min(np.log(n), 5) / 2, min(1, b.linked / len(b.text)), b.text[-1] in ".!?:…\"'", min(1, 5 * b.text.count(",") / n), b.tag in ("p", "blockquote", "pre"), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "dt", "dd", "td", "th"), min(b.depth, 12) / 6, *(m in b.marks for m in FEATURES[-4:]))
            for b, n in zip(blocks, words.tolist(), strict=True)
        ],
        float,
    )


def _page(r: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the texts of its content blocks: semantic tags, telling or opaque class names."""
    said: set[str] = set()
    style = r.choice(["tags", "names", "mixed", "opaque"])

    def word() -> str:
        return "".join(r.choice(["ta", "re", "mo", "li", "su", "na", "ke", "di", "vor", "esch", "ción", "eu"]) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentences(n: int) -> str:
        return " ".join(words(2, 14).capitalize() + r.choice(["", "", f", {words(1, 6)}"]) + r.choice([".", ".", "!", "?"]) for _ in range(n))

    def box(tag: str, names: list[str], inside: str) -> str:
        kind = r.choice(["tags", "names"]) if style == "mixed" else style
        if kind == "tags" and tag != "div":
            return f"<{tag}>{inside}</{tag}>"
        name = r.choice(names) if kind != "opaque" else f"x{r.randint(1, 99)}"
        return f'<div {r.choice(["class", "id"])}="{name}">{inside}</div>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def content(text: str) -> str:
        said.add(" ".join(text.split()))
        return text

    title = f"<h1>{content(words(1, 9))}</h1>"
    parts = []
    for _ in range(r.randint(1, 14)):
        u = r.random()
        if u < 0.08:
            parts.append(f"<h2>{content(words(1, 5))}</h2>")
        elif u < 0.14:
            parts.append("<ul>" + "".join(f"<li>{content(words(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif u < 0.18:
            parts.append(f"<blockquote>{content(sentences(r.randint(1, 3)))}</blockquote>")
        else:
            parts.append(f"<p>{content(words(1, 3) + '.' if r.random() < 0.15 else sentences(r.randint(1, 8)))}</p>")
    before = [box("nav", ["menu", "nav main-nav", "navbar"], links(r.randint(3, 12)))]
    if r.random() < 0.5:
        before.append(box("div", ["ad", "advert", "sponsored"], sentences(1)))
    if r.random() < 0.5:
        before.append(box("div", ["cookie-notice", "consent banner", "alert"], f"<p>{sentences(r.randint(1, 2))}</p>"))
    after = [box("footer", ["footer", "site-footer copyright"], f"<p>{words(2, 8)} {r.randint(1990, 2030)}</p>" + r.choice(["", links(3)]))]
    if r.random() < 0.5:
        after.insert(0, box("aside", ["sidebar", "related", "widget"], f"<h3>{words(1, 3)}</h3>" + links(r.randint(2, 6))))
    if r.random() < 0.4:
        after.insert(0, f'<div class="{r.choice(["comments", "replies", "comment-list"])}">' + "".join(f"<p>{words(1, 2)}</p><p>{sentences(r.randint(1, 3))}</p>" for _ in range(r.randint(1, 4))) + "</div>")
    if r.random() < 0.3:
        after.insert(0, box("form", ["newsletter", "subscribe"], f"<p>{words(2, 6)}</p>"))
    body = "".join([*before, box("article", ["article", "post content", "entry", "story-body"], title + "".join(parts)), *after])
    return f"<html><body>{body}</body></html>", said


def labelled(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of ``n`` made-up pages, and which of them are content."""
    r, out = random.Random(seed), []
    for _ in range(n):
        page, said = _page(r)
        blocks = blocks_of(page)
        out.append((blocks, np.array([b.text in said for b in blocks])))
    return out


def train(pages: int = 400, seed: int = 3, penalty: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic classifier, fitted to the blocks of ``pages`` made-up pages (a fixed number) by Newton steps, each weight within its bound."""
    made = labelled(pages, seed)
    x, y = np.vstack([features(b) for b, _ in made]), np.concatenate([t for _, t in made]).astype(float)
    w, most = np.zeros(x.shape[1]), np.r_[[MOST_WEIGHT] * (x.shape[1] - 4), [MOST_MARK] * 4]
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = np.clip(w, -most, most)
    return tuple(w.tolist())


def content_costs(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """The classifier: log odds that each block is content, bounded."""
    return np.clip(features(blocks) @ np.array(weights), -MOST_COST, MOST_COST).tolist() if blocks else []


class Cut:
    """A minimum cut of a graph with source and sink capacities a node (Dinic)."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.out = n, [], [], [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, cap: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, back]

    def source_side(self) -> list[bool]:
        """After the maximum flow, the nodes that the source still reaches."""
        s, t, to, cap, out = self.n, self.n + 1, self.to, self.cap, self.out
        while True:
            level = [-1] * (self.n + 2)
            level[s] = 0
            todo = deque([s])
            while todo:
                a = todo.popleft()
                for e in out[a]:
                    if cap[e] > 1e-9 and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        todo.append(to[e])
            if level[t] < 0:
                return [x >= 0 for x in level[: self.n]]
            turn = [0] * (self.n + 2)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    flow = min(cap[e] for e in path)
                    back = 0
                    for k, e in enumerate(path):
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                        if cap[e] <= 1e-9 and not back:
                            back = k + 1
                    a = to[path[back - 1] ^ 1]
                    del path[back - 1 :]
                    continue
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(out[a]):
                    path.append(out[a][turn[a]])
                    a = to[path[-1]]
                elif path:
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                else:
                    break


def label(blocks: list[Block], weights: tuple[float, ...], near: float = 1.0, sibling: float = 0.5) -> list[bool]:
    """Whether each block is content: the cheapest labelling under classifier costs and smoothness.

    Neighbours in the page are joined the stronger the closer they stand in the
    tree, and so are consecutive blocks of one parent.
    """
    z = content_costs(blocks, weights)
    if all(x > 0 for x in z) or not any(x > 0 for x in z):
        return [x > 0 for x in z]  # no edge is cut, so the costs alone decide
    g = Cut(len(blocks))
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if z[i] > 0:
            g.edge(g.n, i, z[i])
        elif z[i] < 0:
            g.edge(i, g.n + 1, -z[i])
        if i:
            far = abs(b.depth - blocks[i - 1].depth) + (b.parent != blocks[i - 1].parent)
            g.edge(i - 1, i, near / (1 + far), near / (1 + far))
        j = last.get(b.parent)
        if j is not None and j != i - 1:
            g.edge(j, i, sibling, sibling)
        last[b.parent] = i
    return g.source_side()


@lru_cache(maxsize=1)
def _own_weights() -> tuple[float, ...]:
    """Weights for single pages given without any; ``extract`` fits its own in each call."""
    return train()


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The content blocks of a page in order, one a line; "" for a null or empty page or one without content."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, ok in zip(blocks, label(blocks, weights or _own_weights()), strict=True) if ok)


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``text`` (the main text, one line a block) and ``n_chars``; a null or empty page has the text "".

    Each row is read whole and for itself, so repeated rows get equal texts and an
    empty table gives an empty one; columns ``text`` and ``n_chars`` of ``df`` are
    replaced.  A block is labelled by its page's blocks alone; a tie between the
    two labels goes to boilerplate.
    """
    weights = train()

    def factory():
        def run(pages: list) -> list:
            texts = [main_text(p, weights) for p in pages]
            return [texts, [len(t) for t in texts]]

        return run

    return append_columns(df, html_col, factory, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
