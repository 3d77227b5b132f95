"""Main text of web pages by a graphical model on the DOM tree.

Every element and every block of text has a hidden mark: content or not. A node's
own look (tag, class words, links, length, place) and its parent's mark give its
potentials; both are counted on labelled pages. Sum-product messages, once up
the tree and once down, give each node's exact marginal. Blocks that are more
likely content than not make up the text, in page order.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtledger.llm.texts import slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title button select option optgroup textarea datalist canvas audio video map".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table select body html".split())

# A tag with a quote that is never closed ends at the next ``>`` all the same; an inline one opens nothing.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

KEPT = 0.5
SMOOTH = 0.5


class Node:
    __slots__ = ("parent", "tag", "features", "text", "link", "children")

    def __init__(self, parent: int, tag: str, features: list[str]):
        self.parent, self.tag, self.features = parent, tag, features
        self.text: list[str] = []
        self.link = 0  # characters inside links
        self.children = 0


def _features(tag: str, attributes: str) -> list[str]:
    found = ["tag:" + tag]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found += [f"name:{w.lower()}" for w in NAME_PART.findall(a or b or c)] if name else []
    return found


def parse(page: str) -> list[Node]:
    """Elements and text blocks, parents first. A block is the text between block elements' edges."""
    nodes = [Node(-1, "root", ["tag:root"])]
    stack = [0]  # block elements
    inline: list[str] = []
    block: int | None = None
    at, end = 0, len(page)
    opened: Counter = Counter()  # block elements on the stack, by tag
    within: Counter = Counter()  # inline elements that are open, by tag
    never_closed: set[str] = set()

    def leave(depth: int) -> None:
        """Close the block elements from a depth of the stack on."""
        for k in stack[depth:]:
            opened[nodes[k].tag] -= 1
        del stack[depth:]

    def leave_one(tag: str) -> None:
        """Close the innermost open element of a tag and all inside it."""
        depth = len(stack) - 1
        while nodes[stack[depth]].tag != tag:
            depth -= 1
        leave(depth)

    def after_close(tag: str, nested: bool) -> int | None:
        """Where an element whose contents are not read ends; None if it is never closed."""
        if tag in never_closed:
            return None
        depth = 1
        for edge in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            depth += -1 if edge.group(1) else nested
            if depth == 0:
                return edge.end()
        never_closed.add(tag)
        return None

    def text_to(words: str) -> None:
        nonlocal block
        if block is None:
            if not words.strip():
                return
            block = len(nodes)
            nodes[stack[-1]].children += 1
            nodes.append(Node(stack[-1], "text", []))
        nodes[block].text.append(words)
        if within["a"] > 0:
            nodes[block].link += len(words.strip())

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = (m["end"], m["tag"], m["rest"]) if m["tag"] else (m["end2"], m["tag2"], m["rest2"])
        if tag is None:
            piece = m.group(0)
            if piece[0] != "<" or len(piece) == 1:
                text_to(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if not closing and not attributes.rstrip().endswith("/"):
                close = after_close(tag, tag not in RAW)
                at = close if close is not None else (end if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag == "br":
            text_to("\n") if block is not None else None
            continue
        if tag in INLINE:
            if closing:
                while within[tag] > 0:
                    within[last := inline.pop()] -= 1
                    if last == tag:
                        break
            elif tag not in VOID and m["tag"]:
                inline.append(tag)
                within[tag] += 1
            continue
        block = None
        if closing:
            if opened[tag] > 0:
                leave_one(tag)
                inline.clear()
                within.clear()
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            leave_one("p")
        if any(opened[name] > 0 for name in SIBLINGS.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                name = nodes[stack[k]].tag
                if name in SIBLINGS[tag]:
                    leave(k)
                    break
                if name in SCOPES and name not in ("table",):
                    break
        if tag in VOID or tag == "body" and opened["body"] > 0:
            continue
        nodes[stack[-1]].children += 1
        nodes.append(Node(stack[-1], tag, _features(tag, attributes)))
        if not attributes.endswith("/") or tag in CLOSES_P:
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    return nodes


def block_text(node: Node) -> str:
    return " ".join("".join(node.text).split())


def _describe(nodes: list[Node]) -> tuple[list[list[str]], list[str]]:
    """The look of every node, and the text of the blocks."""
    texts = [block_text(n) if n.tag == "text" else "" for n in nodes]
    looks = []
    for n, text in zip(nodes, texts, strict=True):
        if n.tag != "text":
            looks.append(n.features)
            continue
        share = n.link / max(1, len(text))
        looks.append(["links:" + ("none" if n.link == 0 else "some" if share < 0.5 else "most"), "size:" + ("short" if len(text) < 40 else "middle" if len(text) < 160 else "long")])
    return looks, texts


def _kind(nodes: list[Node], node: Node) -> str:
    """What the chances of a mark given the parent's depend on: the tag, and whether the page is the parent."""
    top = node.parent >= 0 and nodes[node.parent].tag in ("root", "html", "body")
    return ("top " if top else "") + node.tag


class Model:
    """Log-odds of looks, and the chances of a mark given the parent's, by kind of child."""

    def __init__(self, pages: list[str]):
        """pages: html in which the class ``qqin`` marks an element as content, ``qqout`` as other; the rest is as its parent."""
        look = [Counter(), Counter()]
        pair: dict[str, np.ndarray] = {}
        total = [0, 0]
        for page in pages:
            nodes = parse(page)
            marks: list[int] = []
            for n in nodes:
                names = set(n.features)
                mark = 0 if n.parent < 0 or "name:qqout" in names else 1 if "name:qqin" in names else marks[n.parent]
                marks.append(mark)
                n.features = [f for f in n.features if f not in ("name:qqin", "name:qqout")]
            looks, _ = _describe(nodes)
            for n, features, mark in zip(nodes, looks, marks, strict=True):
                total[mark] += 1
                look[mark].update(set(features))
                if n.parent >= 0:
                    pair.setdefault(_kind(nodes, n), np.full((2, 2), SMOOTH))[marks[n.parent], mark] += 1
        self.look = {}
        for f in set(look[0]) | set(look[1]):
            # A shared tag or name says little; one seen on one side only says much.
            p = [(look[k][f] + SMOOTH) / (total[k] + 2 * SMOOTH) for k in (0, 1)]
            self.look[f] = float(np.clip(np.log(p[1] / p[0]), -6, 6))
        every = np.full((2, 2), SMOOTH)
        for counts in pair.values():
            every += counts
        self.any_pair = (every / every.sum(axis=1, keepdims=True)).tolist()
        self.pair = {k: (c / c.sum(axis=1, keepdims=True)).tolist() for k, c in pair.items()}

    def marginals(self, nodes: list[Node], looks: list[list[str]]) -> list[float]:
        """The probability of content of every node: messages up, then down."""
        odds = [math.exp(max(-8.0, min(8.0, sum([self.look.get(f, 0.0) for f in features])))) for features in looks]
        below = [(1 / (1 + o), o / (1 + o)) for o in odds]  # what a node and all below it say: other, content
        pairs = [self.pair.get(_kind(nodes, node), self.any_pair) for node in nodes]
        up = [(0.5, 0.5)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            (oo, oc), (co, cc) = pairs[k]
            o, c = below[k]
            up[k] = message = _shares(oo * o + oc * c, co * o + cc * c)
            parent = nodes[k].parent
            below[parent] = _shares(below[parent][0] * message[0], below[parent][1] * message[1])
        belief = [_shares(0.99 * below[0][0], 0.01 * below[0][1])]  # the page itself is not content
        for k in range(1, len(nodes)):
            (oo, oc), (co, cc) = pairs[k]
            (po, pc), (mo, mc) = belief[nodes[k].parent], up[k]
            o, c = _shares(po / mo, pc / mc)  # the parent without this node
            belief.append(_shares((o * oo + c * co) * below[k][0], (o * oc + c * cc) * below[k][1]))
        return [c for _, c in belief]


def _shares(other: float, content: float) -> tuple[float, float]:
    """Two weights as shares, neither of them nothing."""
    total = other + content
    return max(other / total, 1e-300), max(content / total, 1e-300)


def labelled_pages(n: int = 500, seed: int = 1) -> list[str]:
    """Pages made by rule, their content marked by class names: the training set."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def links(k: int) -> str:
        return "".join(f"<li><a href='#'>{words(1, 3)}</a></li>" for _ in range(k))

    def paragraph() -> str:
        low, high = r.choice([(1, 3), (3, 12), (10, 60), (40, 120)])
        inner = words(low, high)
        return r.choice([f"<p>{inner}</p>"] * 6 + [f"<p>{inner} <a href='#'>{words(1, 3)}</a> {words(2, 9)}</p>", f"<blockquote><p>{inner}</p></blockquote>", f"<h2>{words(1, 6)}</h2>", f"<h3>{words(1, 6)}</h3>", f"<pre>{inner}</pre>", f"<ul><li>{inner}</li><li>{words(1, 30)}</li></ul>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<section><h2>{words(1, 5)}</h2><p>{inner}</p></section>", f"<figure><figcaption>{words(2, 9)}</figcaption></figure>", f"<div>{inner}</div>"])

    def other(name: str, tag: str = "div", inner: str | None = None) -> str:
        inner = inner or r.choice([words(2, 30), words(20, 90), f"<p>{words(2, 40)}</p>", f"<p>{words(20, 120)}</p>", f"<ul>{links(3)}</ul>", f"<h3>{words(1, 3)}</h3><p>{words(2, 20)}</p>"])
        return f"<{tag} class='qqout {name}'>{inner}</{tag}>"

    names = "ad ads advert advertisement banner promo sponsored sponsor sidebar menu navigation navbar nav breadcrumb breadcrumbs footer copyright cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended comments comment reply respond disqus toolbar widget tags pagination pager masthead topbar search skip".split()
    mains = ["article", "main", "div class='qqin content", "div class='qqin post", "div class='qqin entry", "div class='qqin article body", "div class='qqin story", "section class='qqin main"]
    pages = []
    for _ in range(n):
        body = "".join(paragraph() for _ in range(r.randint(1, 14)))
        inside = [other(r.choice(names), r.choice(["div", "aside", "section", "p"])) for _ in range(r.randint(0, 2))]
        remark = f"<p>{words(2, 30)}</p>"
        inside += [other("comments", "section", r.choice([None, None, f"<article>{remark}</article>", f"<ol><li>{remark}</li></ol>"]))] * r.randint(0, 1)
        head = r.choice([f"<h1>{words(1, 9)}</h1>", f"<header><h1>{words(1, 9)}</h1></header>", f"<header><h1>{words(1, 9)}</h1><p>{words(2, 12)}</p></header>", ""])
        main = r.choice(mains)
        tag = main.split(" ")[0]
        opening = f"<{main}'>" if "class" in main else f"<{tag} class='qqin'>"
        content = f"{opening}{head}{body}{''.join(inside)}</{tag}>"
        if r.random() < 0.1:
            content = "".join(f"<{t} class='qqin'>{words(1, 60)}</{t}>" for t in ["h1", *["p"] * r.randint(1, 9)])
        elif r.random() < 0.2 and tag != "main":
            content = f"<main>{content}</main>" if r.random() < 0.5 else f"<div class='container wrapper'>{content}</div>"
        before = [other("", "nav", f"<ul>{links(r.randint(2, 7))}</ul>")] if r.random() < 0.9 else []
        before += [other(r.choice(["site", "", "top"]), "header", f"<p>{words(1, 6)}</p>")] * r.randint(0, 1) + [other(r.choice(names)) for _ in range(r.randint(0, 3))]
        after = [other("comments", "section", f"<article>{remark}</article>")] * (r.random() < 0.1)
        after += [other("", "aside", f"<h3>{words(1, 3)}</h3><ul>{links(3)}</ul>")] * r.randint(0, 1) + [other(r.choice(names), r.choice(["div", "section"])) for _ in range(r.randint(0, 3))]
        after += [other("", "form", f"<p>{words(1, 6)}</p><label>{words(1, 2)}</label>")] * r.randint(0, 1) + [other("", "footer", r.choice([words(2, 15), f"<p>{words(2, 20)}</p>"]))] * r.choice([0, 1, 1, 1])
        r.shuffle(before)
        pages.append(f"<html><body>{''.join(before)}{content}{''.join(after)}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, trained once in each Python worker on the same labelled pages."""
    return Model(labelled_pages())


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    looks, texts = _describe(nodes)
    chance = model.marginals(nodes, looks)
    return "\n\n".join(t for n, t, p in zip(nodes, texts, chance, strict=True) if n.tag == "text" and t and p > KEPT)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    pages: page_id, url, html; other columns are ignored. One row per input row.
    Null or empty html, and pages without content, have an empty text of 0
    characters; null ids and urls stay null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
