"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that respects the tree.

A page is cut into tags and texts in one pass, and a node is kept for every block-level element. A node's features are
its tag's kind, the tokens of its class, id and role (hashed into TOKEN_BITS flags, and counts of known words), densities of its
subtree (words, links, sentences, form fields), its depth, its place among its siblings, and the kinds and tokens of its ancestors. Boosted trees give each node the log-odds
that it holds main text. Decoding then picks the best set of nodes in which no kept node has a dropped ancestor: a
node is worth its log-odds plus what its children are worth, or nothing if it is dropped with all below it.

Training takes a bounded sample (TRAIN_PAGES, chosen by a hash) of the pages. Article and main elements tell which blocks are
main text, but for menus, side columns, forms, notices, adverts and comments in them; on a page without such elements it is the smallest
node that holds nearly all dense runs (long, in sentences, with few links, outside menus and the like; or else its longest run). These blocks are
set again into made-up layouts (semantic tags, divisions with class names or without, menus, notices, adverts, forms, side columns,
related lists, reader comments, footers, around the article and inside it), whose truth is known. The model is some dozens of small trees, whatever
the input. Extraction is one scan without a shuffle.

A page is read in time proportional to its length, whatever its markup is (``Tags``).

Text after the end of the body belongs to the body. Text outside all block-level elements gets a node of its own below the root, one for each run, and is kept or dropped by its odds.
Elements that hold no text of the page are skipped up to their end tag; a self-closed one ends at once. Without an end tag, script and
style reach to the end of the page, as in HTML; a title, form field or option reaches to the next tag; others hold nothing.

Defined results: a null, empty or text-free page gives an empty text of 0 characters; repeated pages are extracted row by row;
without pages nothing is trained and nothing returned; extra columns are kept by ``extract_text``, one
named like its own under another name. Pages are never cut. White space is
any Unicode white space; a line break element counts as white space inside its block.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import set_aside, table

#: Expected number of pages trained on, at most; made-up layouts of each; nodes of a page or layout, drawn at random, at most.
TRAIN_PAGES, LAYOUTS, TRAIN_NODES = 300, 5, 2000
#: Made-up layouts of all pages together, at least.
LEAST_LAYOUTS = 300
TREES, DEPTH, BINS, RATE, LEAF_L2, LEAF_MIN = 40, 4, 32, 0.25, 1.0, 20

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
QUOTE = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements by kind (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option object canvas".split())
#: Of these, those with plain text inside, which do not nest, and those whose text goes up to the next tag where the end tag is missing.
CODE, PLAIN, LABEL = ("script", "style"), frozenset("script style noscript textarea title iframe".split()), ("textarea", "title", "select", "option")
NESTING = frozenset("template svg select object canvas".split())
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input picture button output meter progress audio video map".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("table ul ol dl div section article body td th main aside nav".split())
KINDS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("div", "section")]
KIND = {t: k for k, tags in enumerate(KINDS) for t in tags}
GOOD = frozenset("article content main post entry story body text prose blog page".split())
BAD = frozenset("ad ads advert advertisement banner nav menu navbar sidebar side footer header masthead comment comments reply replies cookie cookies notice consent gdpr alert promo promotion share social related recommended subscribe newsletter widget breadcrumb breadcrumbs pager pagination modal popup login signin search sponsor sponsored disclaimer copyright toolbar topbar rail teaser tags meta form signup overlay disqus respond dialog".split())
INHERITED = 6  # kinds from 0 to 5 that are handed down
TOKEN_BITS = 32
#: Share of a page's dense text that its main node holds, where no tag tells.
HOLDS = 0.85
#: Share of menus, headers and footers of made-up layouts that are divisions without any attribute.
UNMARKED = 0.2
#: Share of made-up layouts with text outside all block-level elements.
BARE = 0.1


class Tags:
    """The tags of a page in turn, in time proportional to its length whatever its quotes are.

    A tag ends at the first ``>`` outside quotes, or, where none follows, at the first ``>``. Where a search for that fails, the places
    at which it left a quote are noted, and no later search goes on from one of them.
    """

    def __init__(self, source: str):
        self.source, self.last, self.lost = source, source.rfind(">"), set()

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` has its ``>``."""
        left, place = [], at
        while (m := QUOTE.search(self.source, place)) and m[0] != ">":
            place = self.source.find(m[0], m.end()) + 1
            if not place or place in self.lost:
                m = None
                break
            left.append(place)
        if m:
            return m.start()
        self.lost.update(left)
        return self.source.find(">", at)

    def following(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, name, attributes) of the first tag from ``at`` on; the name is None for comments and the like."""
        m = OPENING.search(self.source, at)
        if m and m[0] == "<!--":
            end = self.source.find("-->", m.end())
            return m.start(), end + 3 if end >= 0 else len(self.source), False, None, ""
        if not m or self.last < m.start():
            return None
        if m[2] is None:
            return m.start(), self.source.find(">", m.end()) + 1, False, None, ""
        end = self.end(m.end())
        return m.start(), end + 1, bool(m[1]), m[2].lower(), self.source[m.end() : end]


def _ends(source: str, at: int) -> dict[int, int]:
    """Where each nesting element without text from ``at`` on ends, by the end of its start tag; those without an end tag are left out."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    tags = Tags(source)
    while tag := tags.following(at):
        _, at, closing, name, attributes = tag
        if name in CODE and not closing:
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = close.end() if close else len(source)
        elif name in NESTING:
            held = opened.setdefault(name, [])
            if not closing:
                if not CLOSED.search(attributes):
                    held.append(at)
            elif held:
                found[held.pop()] = at
    return found


class Page:
    """Block-level nodes of a page in document order, and its runs of text, each in one node."""

    __slots__ = ("parent", "kind", "tag", "good", "bad", "truth", "runs", "links", "fields", "depth", "tokens")

    def __init__(self, source: str):
        self.parent, self.kind, self.tag, self.good, self.bad, self.truth, self.depth, self.tokens = [-1], [len(KINDS)], ["#"], [0], [0], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.links, self.fields = [0], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements and their block node
        texts: list[str] = []
        at, end, in_link = 0, len(source), 0
        ends: dict[int, int] | None = None
        tags = Tags(source)
        places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
        scopes: list[int] = [0]
        unclosed: set[str] = set()  # tags without an end tag in the rest of the page

        def add(tag: str, parent: int, good: int = 0, bad: int = 0, truth: int = 0, links: int = 0, fields: int = 0, tokens: int = 0) -> int:
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.tag.append(tag)
            self.kind.append(KIND.get(tag, len(KINDS)))
            self.good.append(good)
            self.bad.append(bad)
            self.truth.append(truth)
            self.links.append(links)
            self.fields.append(fields)
            self.tokens.append(tokens)
            return len(self.parent) - 1

        def flush() -> None:
            if texts:
                text = " ".join(html.unescape("".join(texts)).split())
                texts.clear()
                if text:
                    node = stack[-1][1]
                    if not node:  # a node of its own, with what the root holds so far
                        node = add("#text", 0, links=self.links[0], fields=self.fields[0])
                        self.links[0] = self.fields[0] = 0
                    self.runs.append((node, text))

        def after(tag: str, attributes: str, at: int) -> int:
            """Where the page goes on after an element without text whose start tag ends at ``at``."""
            nonlocal ends
            if CLOSED.search(attributes):
                return at
            if tag in PLAIN:
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if close:
                    return close.end()
                unclosed.add(tag)
                if tag in CODE:
                    return end
            elif tag != "option":
                if ends is None:
                    ends = _ends(source, began)
                if at in ends:
                    return ends[at]
            if tag in LABEL:
                following = tags.following(at)
                return following[0] if following else end
            return at

        def push(tag: str, node: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append((tag, node))

        def pop_to(k: int) -> None:
            nonlocal in_link
            if any(t not in INLINE for t, _ in stack[k:]):
                flush()
            for t, _ in stack[k:]:
                places[t].pop()
                in_link -= t == "a"
            while scopes[-1] >= k:
                scopes.pop()
            del stack[k:]

        def close(*names: str) -> None:
            """End the last open one of these elements, unless one that keeps it from this was opened since."""
            k = max((places[t][-1] for t in names if places.get(t)), default=0)
            if k and k >= scopes[-1]:
                pop_to(k)

        while at < end:
            found = tags.following(at)
            if found is None:
                texts.append(source[at:])
                break
            began, tag_end, closing, tag, attributes = found
            if began > at:
                texts.append(source[at:began])
                if in_link:
                    self.links[stack[-1][1]] += len(source[at:began].split())
            at = tag_end
            if tag is None:
                continue
            if closing:
                if places.get(tag):
                    if tag in ("html", "body"):  # text after these belongs to the body, as in HTML
                        flush()
                    if tag != "html":
                        pop_to(places[tag][-1] + (tag == "body"))
                continue
            if tag in RAW:
                at = after(tag, attributes, at)
                self.fields[stack[-1][1]] += tag in ("select", "textarea")
                continue
            if tag == "br":
                texts.append(" ")
                continue
            if tag in ("input", "button"):
                self.fields[stack[-1][1]] += 1
            if tag in CLOSES_P:
                close("p")
            if tag in SIBLING:
                close(*SIBLING[tag])
            if tag in INLINE:
                if tag not in VOID:
                    push(tag, stack[-1][1])
                    in_link += tag == "a"
                continue
            flush()
            if tag in VOID:
                continue
            tokens = [t.lower() for a in ATTRIBUTE.finditer(attributes) for t in TOKEN.findall(a[2] or a[3] or a[4] or "")]
            good, bad = sum(t in GOOD for t in tokens), sum(t in BAD for t in tokens)
            flags = reduce(or_, (1 << crc32(t.encode()) % TOKEN_BITS for t in tokens), 0)
            push(tag, add(tag, stack[-1][1], good, bad, int('data-truth="1"' in attributes), tokens=flags))
        flush()


def node_features(page: Page) -> np.ndarray:
    """A row of features for each node."""
    n = len(page.parent)
    parent, kind = np.array(page.parent), np.array(page.kind)
    words, chars, stops, runs = (np.zeros(n) for _ in range(4))
    for node, text in page.runs:
        words[node] += text.count(" ") + 1
        chars[node] += len(text)
        stops[node] += text.count(".") + text.count("?") + text.count("!")
        runs[node] += 1
    own = words.copy()
    links, fields, paragraphs, below = np.array(page.links, float), np.array(page.fields, float), (kind == 6).astype(float), np.ones(n)
    sums = (words, chars, stops, runs, links, fields, paragraphs, below)
    for i in range(n - 1, 0, -1):
        for s in sums:
            s[parent[i]] += s[i]
    children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    place, before = np.zeros(n), np.zeros(n)
    count = [0] * n
    handed = np.zeros((n, INHERITED))
    good, bad = np.array(page.good, float), np.array(page.bad, float)
    up_good, up_bad, read, words_before = np.zeros(n), np.zeros(n), 0.0, np.zeros(n)
    tokens, up_tokens = np.array(page.tokens, np.uint32), np.zeros(n, np.uint32)
    for i in range(1, n):
        p = parent[i]
        place[i], count[p] = count[p], count[p] + 1
        handed[i] = handed[p]
        if kind[p] < INHERITED:
            handed[i, kind[p]] = 1
        up_good[i], up_bad[i] = up_good[p] + good[p], up_bad[p] + bad[p]
        up_tokens[i] = up_tokens[p] | tokens[p]
        words_before[i] = read
        read += own[i]
    total, one = max(1.0, words[0]), np.maximum(words, 1)
    siblings = np.where(parent >= 0, children[parent], 1)
    before = words_before / total
    kinds = np.zeros((n, len(KINDS)))
    known = kind < len(KINDS)
    kinds[np.flatnonzero(known), kind[known]] = 1
    columns = [
        np.minimum(good, 3), np.minimum(bad, 3), np.minimum(up_good, 3), np.minimum(up_bad, 3), np.log1p(words), np.log1p(own), chars / one, stops / one,
        links / one, words / np.maximum(runs, 1), words / below, fields, np.log1p(paragraphs), np.array(page.depth), place, siblings,
        place / np.maximum(siblings, 1), words / np.maximum(1, words[np.maximum(parent, 0)]), words / total, before, children,
    ]
    above = np.maximum(parent, 0)
    columns += [np.log1p(words[above]), links[above] / one[above], words / np.maximum(1, words[above] - words), np.log1p(total - words_before - words)]
    flags = [v[:, None] >> np.arange(TOKEN_BITS, dtype=np.uint32) & np.uint32(1) for v in (tokens, up_tokens)]
    return np.column_stack([*columns, kinds, handed, *flags]).astype(np.float32)


class Trees:
    """Boosted trees of one depth as arrays: feature and bin of every inner node, value of every leaf."""

    def __init__(self, cuts: np.ndarray, features: np.ndarray, bins: np.ndarray, values: np.ndarray, base: float):
        self.cuts, self.features, self.bins, self.values, self.base = cuts, features, bins, values, base

    def binned(self, x: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
        """The bin of every value; of the ``used`` features only, if given."""
        out = np.zeros(x.shape, np.int16)
        for j in range(x.shape[1]) if used is None else used:
            out[:, j] = np.searchsorted(self.cuts[j], x[:, j], side="left")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x, np.unique(self.features[self.bins < BINS])), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.bins, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Second-order boosting of the logistic loss over binned features, level by level.

        Sums over bins are counted for graded features; for flags, which have one split, they are a product of matrices.
        """
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        flag = ((x == 0) | (x == 1)).all(axis=0)
        graded, flags = np.flatnonzero(~flag), np.flatnonzero(flag)
        cuts = np.full((x.shape[1], BINS - 1), 0.5)
        for j in graded:
            cuts[j] = np.quantile(x[:, j], grid)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        model = cls(cuts, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH)), float(np.log(rate / (1 - rate))))
        b, width, odds = model.binned(x), x.shape[1], np.full(len(x), model.base)
        shifted, is_set = (np.arange(len(graded)) * BINS + b[:, graded]).astype(np.int64), x[:, flags].astype(np.float64)
        rows = np.arange(len(x))
        features, bins, values = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = p - y, p * (1 - p)
            f, c = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
            at = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                nodes, low = 2**level, 2**level - 1
                cell = ((at - low)[:, None] * (len(graded) * BINS) + shifted).ravel()
                size = nodes * len(graded) * BINS
                left, total = [], []
                for v in (g, h, np.ones(len(x))):
                    inside = np.zeros((len(x), nodes))
                    inside[rows, at - low] = v
                    all_ = inside.sum(axis=0)[:, None, None]
                    below = np.zeros((nodes, width, BINS))
                    below[:, graded] = np.bincount(cell, np.repeat(v, len(graded)), size).reshape(nodes, len(graded), BINS).cumsum(axis=2)
                    below[:, flags, 0] = all_[:, :, 0] - inside.T @ is_set
                    left.append(below), total.append(all_)
                (gl, hl, nl), (gt, ht, nt) = left, total
                gain = gl**2 / (hl + LEAF_L2) + (gt - gl) ** 2 / (ht - hl + LEAF_L2) - gt**2 / (ht + LEAF_L2)
                gain = np.where((nl >= LEAF_MIN) & (nt - nl >= LEAF_MIN), gain, 0).reshape(nodes, -1)
                best = gain.argmax(axis=1)
                f[low : low + nodes] = best // BINS
                c[low : low + nodes] = np.where(gain.max(axis=1) > 1e-9, best % BINS, BINS)
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            leaf = at - (2**DEPTH - 1)
            v = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + LEAF_L2)
            odds += v[leaf]
            features.append(f), bins.append(c), values.append(v)
        return cls(cuts, np.array(features), np.array(bins), np.array(values), model.base)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best set in which no kept node has a dropped ancestor."""
    worth = odds.copy()
    worth[0] = 0
    for i in range(len(parent) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    keep = worth > 0
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] &= keep[parent[i]]
    return keep


def main_text(page: Page, odds: np.ndarray) -> str:
    keep = decode(page.parent, odds)
    return "\n".join(text for node, text in page.runs if keep[node])


# -- training


def _dense(page: Page) -> list[bool]:
    """Which runs stand for the main text where no tag tells: those of the smallest node that holds nearly all dense runs.

    Dense runs have words in sentences and few links and lie outside menus and the like; without any, the longest run counts as dense. The
    node's other runs (titles, short lines) count too, but for those in menus and the like.
    """
    n = len(page.parent)
    aside, words = [False] * n, [0] * n
    for i in range(1, n):
        aside[i] = aside[page.parent[i]] or 0 < page.kind[i] < INHERITED or page.bad[i] > page.good[i]
    for at, t in page.runs:
        words[at] += t.count(" ") + 1
    linked = [4 * page.links[at] > words[at] for at, _ in page.runs]
    found = [not aside[at] and t.count(" ") > 6 and any(c in t for c in ".?!。？！") and not far for (at, t), far in zip(page.runs, linked, strict=True)]
    if not any(found):
        longest = max((len(t) for _, t in page.runs), default=0)
        found = [len(t) == longest for _, t in page.runs]
    held = [0] * n
    for (at, t), dense in zip(page.runs, found, strict=True):
        held[at] += len(t) * dense
    for i in range(n - 1, 0, -1):
        held[page.parent[i]] += held[i]
    node = 0
    for i in range(1, n):  # nodes come in the order of the page, so a chain of containers is met from the outside
        if page.parent[i] == node and held[i] >= HOLDS * held[0] and page.kind[i] != KIND["p"]:
            node = i
    inside = [False] * n
    inside[node] = True
    for i in range(node + 1, n):
        inside[i] = inside[page.parent[i]]
    return [dense or (inside[at] and not aside[at] and not far) for (at, _), far, dense in zip(page.runs, linked, found, strict=True)]


def _inside(page: Page) -> list[bool]:
    """Which nodes lie in an article or main element, and not in a part of it that is no main text (a menu, footer, side column or form, or one
    whose tokens tell of a notice, advert or comments)."""
    inside = [False] * len(page.parent)
    for i in range(1, len(page.parent)):
        left_out = page.kind[i] in (KIND["nav"], KIND["footer"], KIND["aside"], KIND["form"]) or page.bad[i] > page.good[i]
        inside[i] = page.kind[i] == KIND["article"] or (inside[page.parent[i]] and not left_out)
    return inside


def _layout(page: Page, rng: random.Random) -> str | None:
    """The page's main blocks (those of its article or main element, or else the dense ones) in a made-up layout, marked with the truth."""
    if KIND["article"] in page.kind:
        inside = _inside(page)
        chosen = [inside[n] for n, _ in page.runs]
    else:
        chosen = _dense(page)
    main = [(page.tag[n], html.escape(t)) for (n, t), yes in zip(page.runs, chosen, strict=True) if yes]
    other = [html.escape(t) for (_, t), yes in zip(page.runs, chosen, strict=True) if not yes]
    if not main:
        return None
    words = " ".join(t for _, t in main).split() or ["x"]
    if rng.random() < 0.4:  # a short article
        main = [(tag, " ".join(t.split()[: rng.randint(1, 25)])) for tag, t in main[: rng.randint(1, 3)]]

    def some(low: int, high: int) -> str:
        k, i = rng.randint(low, high), rng.randrange(len(words))
        return " ".join((words[i:] + words)[:k]) + rng.choice([".", ""])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def box(tag: str, names: str, body: str) -> str:
        plain = rng.random()
        if tag in ("nav", "header", "footer") and plain < UNMARKED:
            return f"<div>{body}</div>"
        if plain < 0.45 and tag not in ("div", "section"):
            return f"<{tag}>{body}</{tag}>"
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "js-", "c-"])}{rng.choice(names.split())}">{body}</div>'

    def comment() -> str:
        return f"<div><p>{some(5, 40)}</p></div>"

    parts = {
        "nav": lambda: box("nav", "nav menu navbar breadcrumb topbar", links(rng.randint(3, 8))),
        "header": lambda: box("header", "header masthead banner", f"<p>{some(2, 8)}</p>" + (links(3) if rng.random() < 0.5 else "")),
        "ad": lambda: box("div", "ad ads advert sponsored promo", f"<p>{some(3, 30)}</p>" if rng.random() < 0.5 else (rng.choice(other) if other else some(3, 12))),
        "notice": lambda: box("div", "cookie notice consent alert gdpr", f"<p>{some(5, 40)}</p><button>OK</button>"),
        "form": lambda: box("form", "newsletter subscribe login search signup", f"<p>{some(3, 15)}</p><input type=text><button>{some(1, 2)}</button>"),
        "aside": lambda: box("aside", "sidebar side related recommended widget rail", (f"<h3>{some(1, 4)}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{some(8, 50)}</p>"))),
        "comments": lambda: box("section", "comments comment replies disqus respond", f"<h3>{some(1, 3)}</h3>" + "".join(comment() for _ in range(rng.randint(1, 6)))),
        "share": lambda: box("div", "share social tags pager", links(3)),
        "footer": lambda: box("footer", "footer copyright disclaimer", rng.choice([f"&copy; {some(4, 20)}", f"<p>{some(6, 30)}</p>" + links(3)])),
    }
    pick = lambda *names: "".join(parts[n]() for n in names if rng.random() < 0.45)
    mark = ' data-truth="1"'
    if rng.random() < BARE:  # text outside all blocks, or links there before the blocks
        text = f" {rng.choice(['<br>', ' '])} ".join(t for _, t in main)
        menu = " ".join(f'<a href="/x">{some(1, 4)}</a>' for _ in range(rng.randint(2, 6)))
        return text if rng.random() < 0.5 else menu + "".join(f"<p{mark}>{t}</p>" for _, t in main)
    wraps = rng.choice([["article"], ["main"], ["main", "article"], ["div"], ["div", "div"], ["section", "div"]])
    names = rng.choice(["content", "article-body", "post", "entry-content", "main", "story text", ""])
    body = []
    for k, (tag, text) in enumerate(main):
        tag = tag if tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td") else rng.choice(["p", "p", "div"])
        tag = "p" if tag in ("li", "td") else tag
        body.append(f"<{tag}{mark}>{text}</{tag}>" if rng.random() < 0.97 else f"<ul{mark}><li{mark}>{text}</li></ul>")
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):  # what is no main text inside the article, between its blocks or after them
        body.insert(rng.randint(1, len(body)), parts[rng.choice(["ad", "aside", "aside", "share", "form", "notice", "comments", "nav"])]())
    inner = "".join(body) + (parts[rng.choice(["comments", "comments", "form", "aside", "share"])]() if rng.random() < 0.35 else "")
    for tag in reversed(wraps):
        inner = f'<{tag}{mark}{f" class={names.split()[0]!r}" if names and rng.random() < 0.7 else ""}>{inner}</{tag}>'
    if rng.random() < 0.4:
        inner = f'<div{mark} class="{rng.choice(["container", "wrapper", "row", "layout"])}">{pick("nav", "aside")}{inner}{pick("aside", "comments")}</div>'
    return f"<html><head><title>x</title></head><body{mark}>{pick('notice', 'header', 'nav', 'ad', 'form')}{inner}{pick('share', 'comments', 'aside', 'ad', 'form', 'notice')}{pick('footer', 'footer')}</body></html>"


def _examples(source: str, seed: int, layouts: int = LAYOUTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    page, rng = Page(source), random.Random(seed)

    def some(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = slice(None) if len(y) <= TRAIN_NODES else sorted(random.Random(seed).sample(range(len(y)), TRAIN_NODES))
        return x[at], y[at]

    if page.runs and KIND["article"] in page.kind:
        holds = np.array(_inside(page), np.int8)
        for i in range(len(page.parent) - 1, 0, -1):
            holds[page.parent[i]] |= holds[i]
        yield some(node_features(page)[1:], holds[1:])
    for _ in range(layouts):
        made = _layout(page, rng)
        if made:
            other = Page(made)
            words = np.zeros(len(other.parent))
            for node, text in other.runs:
                words[node] += text.count(" ") + 1
            bare = np.array([t == "#text" for t in other.tag]) & (2 * np.array(other.links) < words)
            truth = np.array(other.truth, np.int8) | bare
            for i in range(len(other.parent) - 1, 0, -1):
                truth[other.parent[i]] |= truth[i]
            yield some(node_features(other)[1:], truth[1:])


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Trees | None:
    """Trees from about ``rows`` pages at most; None without any main text to learn from."""
    known = pages.where("html IS NOT NULL").select("page_id")
    n = known.count()
    share = min(1.0, rows / max(1, n))
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("training pages"), "page_id"), 33)
    sample = pages.where("html IS NOT NULL").withColumn("turn", turn).where(F.col("turn") < F.lit(int(share * (1 << 31))))

    few = -(-LEAST_LAYOUTS // max(1, min(n, rows)))  # layouts of each page where a small sample has to give enough nodes

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for turn, source in zip(b.turn, b.html, strict=True):
                for x, y in _examples(source, int(turn), max(LAYOUTS, few)):
                    yield pd.DataFrame({"turn": [int(turn)], "x": [x.tobytes()], "y": [y.tobytes()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["turn", "x"])
        y = np.concatenate([np.frombuffer(v, np.int8) for v in rows.y]).astype(float)
        if not 0 < y.mean() < 1:
            return
        t = Trees.fit(np.frombuffer(b"".join(rows.x), np.float32).reshape(len(y), -1), y)
        yield pd.DataFrame({"part": ["cuts", "features", "bins", "values", "base"], "data": [np.asarray(v, float).tobytes() for v in (t.cuts, t.features, t.bins, t.values, t.base)]})

    python_workers(pages.sparkSession)
    made = sample.select("turn", "html").mapInPandas(make, "turn long, x binary, y binary")
    got = {r.part: np.frombuffer(r.data) for r in made.repartition(1).mapInPandas(learn, "part string, data binary").collect()}  # of a fixed size
    if not got:
        return None
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    return Trees(got["cuts"].reshape(-1, BINS - 1), got["features"].astype(int).reshape(-1, inner), got["bins"].astype(int).reshape(-1, inner), got["values"].reshape(-1, leaves), float(got["base"][0]))


def extract_text(pages: DataFrame, trees: Trees | None, source: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)  # of a fixed size

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parsed = [Page(h or "") for h in batch]
            if sent.value is None or not parsed:
                yield pd.Series(["" for _ in parsed], dtype=object)
                continue
            x = [node_features(p) for p in parsed]
            odds = np.split(sent.value.log_odds(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
            yield pd.Series([main_text(p, o) for p, o in zip(parsed, odds, strict=True)], dtype=object)

    python_workers(pages.sparkSession, 500)
    return set_aside(pages, column).withColumn(column, extract(F.coalesce(F.col(source), F.lit(""))))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract_text(pages, train(pages)).drop("html")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
