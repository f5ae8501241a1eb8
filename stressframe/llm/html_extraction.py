"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements. Each element has a hidden state (content or not), a
unary potential from its features (tag, words of class, id and role, amount of text, share
of text in links, punctuation), and a potential for each parent-child pair of states,
apart for children that start a new section. One upward and one downward sum-product pass
give exact marginals; the weights are trained by the exact gradient of the likelihood of
labelled pages, which a small generator lays out in many ways.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Elements of HTML by the role they have here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("article aside body div footer form header main nav section table ul ol dl".split())
CLOSES_P = BLOCK - frozenset("body caption head html td th tr tbody thead tfoot li dd dt option optgroup legend summary figcaption".split())
#: Elements that an opening tag ends, and where the search for them stops.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
NEVER = frozenset("head title script style noscript template textarea select iframe svg object form button".split())
#: Parameter: a form with this share of the page's text, and a paragraph or section in it, is the page's frame and no form of its own.
FRAME = 0.9

NAMED = re.compile(r"<(/?)[a-zA-Z]")
AFTER_NAME = re.compile(r"[\s/>\x00]")
MARKS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """An element; ``parts`` holds its text runs and children in page order."""

    tag: str
    parent: int
    words: tuple[str, ...] = ()
    parts: list = field(default_factory=list)
    text: int = 0  # characters below
    linked: int = 0  # of those, in links
    stops: int = 0  # of those, full stops, commas and the like
    label: int = 0


class Tags:
    """Tags, comments and declarations of a page, found in one pass.

    A tag ends at the first '>' outside quotes; a '<' whose tag never ends is text. Whether
    it ends depends on the place alone, so places from which there is no end are kept and
    each mark of the page is looked at once, however many tags are left open.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.marks: list[int] | None = None  # places of '>' and quotes, listed when first needed
        self.endless: set[int] = set()  # of those, the ones after which, outside quotes, no '>' comes
        self.last = page.rfind(">")
        self.run = (0, 0)  # a run of characters without an end of a name

    def name_end(self, at: int) -> int:
        """Where a name that has a character at ``at`` ends."""
        if not self.run[0] <= at < self.run[1]:
            found = AFTER_NAME.search(self.page, at)
            self.run = (at, found.start() if found else len(self.page))
        return self.run[1]

    def tag(self, name: int) -> tuple[int, int]:
        """(end of the name, place of the '>') of the tag whose name begins at ``name``; -1 if it never ends. A name ends before a quote where it otherwise has no end."""
        stop = self.name_end(name)
        close = self.end(stop)
        if close < 0 and self.marks is not None:
            k = bisect_left(self.marks, name)
            if k < len(self.marks) and self.marks[k] < stop:
                return self.marks[k], self.end(self.marks[k])
        return stop, close

    def end(self, at: int) -> int:
        """Place of the '>' that ends a tag whose name ends at ``at``, -1 if there is none."""
        page = self.page
        if at > self.last:
            return -1
        found = page.find(">", at)
        if not ('"' in page[at:found] or "'" in page[at:found]) if found - at < 1 << 12 else False:
            return found
        if self.marks is None:
            self.marks = [m.start() for m in MARKS.finditer(page)]
        k, seen = bisect_left(self.marks, at), []
        while k < len(self.marks) and self.marks[k] not in self.endless:
            mark = self.marks[k]
            if page[mark] == ">":
                return mark
            seen.append(mark)
            close = page.find(page[mark], mark + 1)
            if close < 0:
                break
            k = bisect_left(self.marks, close) + 1
        self.endless.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, '/' of an end tag, name, attributes) in page order; comments and declarations have no name."""
        page, at = self.page, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                return
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                stop, slash, name, rest = (len(page) if close < 0 else close + 3), "", "", ""
            elif after in ("!", "?"):
                close = page.find(">", at + 1) if at < self.last else -1
                stop, slash, name, rest = close + 1, "", "", ""
            else:
                found = NAMED.match(page, at)
                named, close = self.tag(found.end() - 1) if found else (0, -1)
                stop, slash, name, rest = close + 1, *((found[1], page[found.end() - 1 : named].lower(), page[named:close]) if close >= 0 else ("", "", ""))
            if not stop:
                at += 1
                continue
            skip = yield at, stop, slash, name, rest
            at = stop if skip is None else skip


def _words(attributes: str) -> tuple[str, ...]:
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if "hidden" in name and (value or "true") != "false":
            out.append(name)
        else:
            out += re.findall(r"[a-z]+", value.lower())
    return tuple(out)


class Open:
    """The elements that are open, and for each tag and for blocks where the innermost stands."""

    def __init__(self) -> None:
        self.stack, self.tags = [0], [""]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def innermost(self, tags) -> int:
        return max((p[-1] for p in map(self.places.get, tags) if p), default=-1)

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.tags.append(tag)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.stack.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def closed(self, tag: str) -> None:
        """An end tag: closes the innermost such element; an inline one never closes a block."""
        depth = self.innermost((tag,))
        if depth > 0 and (tag in BLOCK or not self.blocks or depth > self.blocks[-1]):
            self.pop_to(depth)

    def opened(self, tag: str) -> None:
        """What a start tag ends."""
        if tag in CLOSES_P and self.blocks and self.tags[self.blocks[-1]] == "p":
            self.pop_to(self.blocks[-1])
        if tag in ENDED_BY:
            ended, stops = ENDED_BY[tag]
            depth = self.innermost(ended)
            if depth > self.innermost(stops):
                self.pop_to(depth)


def parse(page: str) -> list[Node]:
    """Elements in page order, the first a root without a tag. Never fails: unclosed elements end with their parent, stray end tags go. Takes time in proportion to the page, however broken."""
    nodes, held, at = [Node("", -1)], Open(), 0

    def add_text(run: str) -> None:
        if run:
            nodes[held.stack[-1]].parts.append(run)

    tags = iter(Tags(page))
    found = next(tags, None)
    while found:
        start, stop, slash, tag, attributes = found
        add_text(html.unescape(page[at:start]))
        at, skip = stop, None
        if slash:
            held.closed(tag)
        elif tag:
            held.opened(tag)
            nodes.append(Node(tag, held.stack[-1], _words(attributes) if attributes else ()))
            nodes[held.stack[-1]].parts.append(len(nodes) - 1)
            if tag in RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if at < (close.start() if close else len(page)):
                    nodes[-1].parts.append(page[at : close.start()] if close else page[at:])
                at = skip = close.end() if close else len(page)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                held.push(len(nodes) - 1, tag)
        found = _sent(tags, skip)
    add_text(html.unescape(page[at:]))
    _measured(nodes)
    return nodes


def _sent(tags, skip: int | None):
    try:
        return tags.send(skip)
    except StopIteration:
        return None


def _measured(nodes: list[Node]) -> None:
    """Amounts of text below each element; a form that is the page's frame becomes a plain block."""
    framed = [n.tag in ("p", "article", "main", "section") for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag not in NEVER or n.tag == "form":
            for part in n.parts:
                if isinstance(part, str):
                    size = len(part.strip())
                    n.text += size
                    n.stops += sum(part.count(c) for c in ".,;:!?") if size else 0
        if n.tag == "a":
            n.linked = n.text
        if n.parent >= 0:
            up = nodes[n.parent]
            framed[n.parent] |= framed[i]
            up.text, up.linked, up.stops = up.text + n.text, up.linked + n.linked, up.stops + n.stops
    for i, n in enumerate(nodes):
        if n.tag == "form" and framed[i] and n.text >= FRAME * nodes[0].text:
            n.tag = "div"


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def looks(nodes: list[Node]) -> list[tuple]:
    """What the features of each element depend on."""
    out = []
    for n in nodes:
        up = nodes[n.parent].tag if n.parent >= 0 else ""
        if n.text:
            out.append((n.tag, _bucket(n.text, (1, 25, 80, 250, 1000)), _bucket(n.linked / n.text, (0.05, 0.3, 0.7)), _bucket(n.stops / n.text, (0.004, 0.02, 0.1)), up, n.words))
        else:
            out.append((n.tag, 0, 9, 9, up, n.words))
    return out


def features(look: tuple) -> list[str]:
    """Names of the features of an element; all count 1."""
    tag, size, links, stops, up, words = look
    return ["bias", f"t:{tag}", f"s:{size}", f"l:{links}", f"s:{size},l:{links}", f"d:{stops}", f"u:{up},{tag}" if up in SECTIONS else "u:", *(f"c:{w}" for w in words)]


def boundary(node: Node) -> int:
    return int(node.tag in SECTIONS)


@dataclass
class TreeModel:
    """Weights of features for the state content, and of pairs: (section, parent state, child state)."""

    unary: dict[str, float]
    pair: dict[tuple[int, int, int], float]
    known: dict[tuple, float] = field(default_factory=dict)  # potentials by look

    def potential(self, look: tuple) -> float:
        found = self.known.get(look)
        if found is None:
            found = math.exp(min(30.0, max(-30.0, sum(self.unary.get(f, 0.0) for f in features(look)))))
            if len(self.known) < 100_000:
                self.known[look] = found
        return found

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Probability of content of each element, and of each pair of states (parent, child) with its parent."""
        n = len(nodes)
        pair = {k: math.exp(v) for k, v in self.pair.items()}
        edge = [[(pair[s, 0, 0], pair[s, 0, 1]), (pair[s, 1, 0], pair[s, 1, 1])] for s in (0, 1)]
        own = [self.potential(look) for look in looks(nodes)]
        up0, up1 = [1.0] * n, own[:]  # own potential times the messages of the children
        to0, to1 = [1.0] * n, [1.0] * n  # messages to the parent
        for i in range(n - 1, 0, -1):
            e = edge[boundary(nodes[i])]
            a, b = up0[i], up1[i]
            z = a + b
            a, b = a / z, b / z
            up0[i], up1[i] = a, b
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            z = m0 + m1
            to0[i], to1[i] = m0 / z, m1 / z
            p = nodes[i].parent
            up0[p] *= 2 * to0[i]
            up1[p] *= 2 * to1[i]
            z = up0[p] + up1[p]
            up0[p], up1[p] = up0[p] / z, up1[p] / z
        full0, full1 = up0[:], up1[:]
        joint = [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            p, e = nodes[i].parent, edge[boundary(nodes[i])]
            c0, c1 = full0[p] / max(to0[i], 1e-300), full1[p] / max(to1[i], 1e-300)
            j = (c0 * e[0][0] * up0[i], c0 * e[0][1] * up1[i], c1 * e[1][0] * up0[i], c1 * e[1][1] * up1[i])
            z = sum(j) or 1.0
            joint[i] = j = tuple(v / z for v in j)
            full0[i], full1[i] = j[0] + j[2], j[1] + j[3]
        return [b / ((a + b) or 1.0) for a, b in zip(full0, full1, strict=True)], joint


def train(pages: list[list[Node]], steps: int = 60, rate: float = 1.0, l2: float = 0.02) -> TreeModel:
    """Likelihood ascent (AdaGrad) with exact marginals; ``label`` of every element is known."""
    named = [[features(look) for look in looks(nodes)] for nodes in pages]
    model = TreeModel({}, {(s, a, b): (0.5 if a == b else -0.5) for s in (0, 1) for a in (0, 1) for b in (0, 1)})
    past: dict = {}
    for _ in range(steps):
        slope: dict = {}
        for nodes, names in zip(pages, named, strict=True):
            p, joint = model.marginals(nodes)
            for i, n in enumerate(nodes):
                for f in names[i]:
                    slope[f] = slope.get(f, 0.0) + n.label - p[i]
                if i:
                    s, truth = boundary(n), 2 * nodes[n.parent].label + n.label
                    for k in range(4):
                        key = (s, k >> 1, k & 1)
                        slope[key] = slope.get(key, 0.0) + (k == truth) - joint[i][k]
        for key, g in slope.items():
            weights = model.pair if isinstance(key, tuple) else model.unary
            w = weights.get(key, 0.0)
            g -= l2 * w
            past[key] = past.get(key, 0.0) + g * g
            weights[key] = w + rate * g / (math.sqrt(past[key]) + 1e-8)
        model.known.clear()
    return model


#: Names that boilerplate and content containers go by.
BOILERPLATE = {"nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc links".split(), "header": "header masthead topbar banner branding logo".split(), "footer": "footer copyright legal colophon bottom".split(), "aside": "sidebar aside related widget popular recommended trending tags share social".split(), "ad": "ad ads advert advertisement sponsored promo sponsor banner adsbygoogle".split(), "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup login".split(), "comments": "comments comment replies reply discussion disqus respond".split()}
CONTAINERS = ["article", "main", "div class='content'", "div id='main-content'", "div class='post entry'", "div class='article-body story text'", "section class='post-content'", "div"]


def labelled_pages(n: int = 96, seed: int = 5) -> list[list[Node]]:
    """Labelled pages laid out by a seeded generator: content stands in elements that carry the attribute-free mark <x-c> while it is built."""
    rng = random.Random(seed)
    syllables = "an be co di er fo ga hi in jo ka le mi no or pa qu re so ta un ve wi za".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join(words(rng.randint(4, 14)).capitalize() + rng.choice("...!?") for _ in range(k))

    def links(k: int) -> str:
        return "<ul>" + "".join(f"<li><a href='#'>{words(rng.randint(1, 3))}</a></li>" for _ in range(k)) + "</ul>"

    def boilerplate(kind: str) -> str:
        name = rng.choice(BOILERPLATE[kind])
        attribute = rng.choice([f'class="{name}"', f'id="{name}"', f'class="site-{name} x"', f'class="{name}-box"'])
        tag = kind if kind in ("nav", "header", "footer", "aside") and rng.random() < 0.6 else "div" if rng.random() < 0.8 else "section"
        attribute = "" if tag == kind and rng.random() < 0.6 else attribute
        body = {"nav": lambda: links(rng.randint(2, 9)), "header": lambda: f"<h1>{words(3)}</h1>" * (rng.random() < 0.5) + links(3) * (rng.random() < 0.5) + words(4), "footer": lambda: f"&copy; {words(2)} &middot; {sentences(rng.randint(0, 3))}" + links(4) * (rng.random() < 0.3), "aside": lambda: f"<h3>{words(2)}</h3>" + links(4) + f"<p>{sentences(rng.randint(0, 4))}</p>", "ad": lambda: sentences(rng.randint(1, 5)) if rng.random() < 0.6 else f"<p>{sentences(2)} <a href='#'>{words(2)}</a></p>", "notice": lambda: f"<p>{sentences(rng.randint(1, 3))}</p><button>OK</button>" if rng.random() < 0.5 else sentences(2), "comments": lambda: f"<h3>{words(1)}</h3>" * (rng.random() < 0.6) + "".join(f"<div class='comment'><b>{words(1)}</b><p>{sentences(rng.randint(1, 5))}</p></div>" if rng.random() < 0.7 else f"<p>{sentences(rng.randint(1, 4))}</p>" for _ in range(rng.randint(1, 5)))}[kind]()
        return f"<{tag} {attribute}>{body}</{tag}>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.66:
            return f"<p>{sentences(rng.randint(1, 7))}" + (f" <a href='#'>{words(2)}</a> {sentences(1)}" if rng.random() < 0.2 else "") + (f"<b>{words(2)}</b> {words(3)}." if rng.random() < 0.2 else "") + ("</p>" if rng.random() < 0.8 else "")
        if kind < 0.76:
            return f"<h2>{words(3)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{words(rng.randint(3, 9))}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{sentences(2)}</p></blockquote>"
        if kind < 0.95:
            return f"<table><tr><th>{words(1)}</th><td>{words(2)}</td></tr><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>"
        return f"<p><b>{words(5)}<br><p>{sentences(2)}</p>"

    out = []
    for _ in range(n):
        container = rng.choice(CONTAINERS)
        parts = [f"<h1>{words(4)}</h1>"] * (rng.random() < 0.85) + [block() for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(1, len(parts)), f"<x-b>{boilerplate(rng.choice(['ad', 'ad', 'aside', 'notice', 'nav', 'comments']))}</x-b>")
        article = f"<{container}>{''.join(parts)}" + (f"</{container.split()[0]}>" if rng.random() < 0.85 or container == "div" else "")
        before = [boilerplate(k) for k in ("header", "nav", "ad", "notice", "aside", "nav") if rng.random() < 0.5]
        after = [boilerplate(k) for k in ("comments", "aside", "ad", "footer", "notice", "footer") if rng.random() < 0.45]
        form = f"<form action='#'><label>{words(2)}</label><input><p>{sentences(1)}</p></form>" if rng.random() < 0.2 else ""
        page = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{''.join(before)}<x-a>{article}</x-a>{form}{''.join(after)}</body></html>"
        out.append(_labelled(parse(page)))
    return out


def _labelled(nodes: list[Node]) -> list[Node]:
    """Labels from the marks x-a and x-b, which are then taken out of the tree."""
    state, new, kept = [0] * len(nodes), [0] * len(nodes), []
    for i, n in enumerate(nodes):
        up = state[n.parent] if n.parent >= 0 else 0
        state[i] = 1 if n.tag == "x-a" else 0 if n.tag == "x-b" or n.tag in NEVER else up
        if n.tag in ("x-a", "x-b"):
            new[i] = new[n.parent]
        else:
            kept.append(Node(n.tag, new[n.parent] if n.parent >= 0 else -1, n.words, [], n.text, n.linked, n.stops, state[i]))
            new[i] = len(kept) - 1
    return kept


def extract(page: str | None, model: TreeModel) -> str:
    """Blocks of content, joined by newlines."""
    if not page:
        return ""
    nodes = parse(page)
    p, _ = model.marginals(nodes)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    work: list[tuple[int, int]] = [(0, 0)]  # (element, next of its parts): no recursion, trees may be deep
    while work:
        i, k = work.pop()
        n = nodes[i]
        if k == 0 and n.tag in BLOCK:
            flush()
        if k == len(n.parts):
            if n.tag in BLOCK:
                flush()
            elif n.tag == "br":
                run.append(" ")
            continue
        work.append((i, k + 1))
        part = n.parts[k]
        if isinstance(part, int):
            if nodes[part].tag not in NEVER:
                work.append((part, 0))
        elif p[i] >= 0.5:
            run.append(part)
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, model: TreeModel) -> DataFrame:
    """text and n_chars for every row of ``pages`` (page_id, url, html), from the whole html.

    Null, empty or broken html gives the text that can be read, else an empty one; repeated
    rows each get a row, an empty table gives an empty one, and other columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [extract(h, held.value) for h in frame.pop("html")]
            yield frame.assign(text=text, n_chars=[len(t) for t in text])

    chosen = pages.select("page_id", "url", "html")
    return chosen.mapInPandas(run, f"page_id {chosen.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
