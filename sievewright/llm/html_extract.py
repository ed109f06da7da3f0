"""Main-text extraction: boosted trees over DOM-node features, then hierarchical decoding.

Each block element of a page is described by its tag, its attribute tokens (learned log-odds),
depth, subtree text and tag density, link density and sibling statistics. Boosted trees, fitted
here on generated pages whose content nodes are known, give the probability that the node is
content. A tree pass then picks the likeliest labelling in which a node is outside (above the
main text), content, or excluded within content; outside may lead to content, content to
excluded, and excluded to nothing else (each new content region costs BEGIN), so no ancestor and descendant contradict each other.

Text is the whole page: nothing is dropped or capped but what is labelled. Character references
are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a
line feed. A line break element is white space.

Cases: null or empty html gives empty text; cut-off tags are dropped; unclosed elements end with
their parent; repeated rows are kept; an empty table gives no rows; nesting beyond MAX_DEPTH is
read as lying at that depth. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_module
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Boosted

MAX_DEPTH = 400
TRAINING_PAGES = 500
#: Log-likelihood that a content region must win to begin: a page has few.
BEGIN = 4.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
TAGS = {t: k for k, group in enumerate(["article main", "section", "div", "p", "ul ol dl menu", "li dt dd", "h1 h2 h3 h4 h5 h6", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html"]) for t in group.split()}
KINDS = 16
TOKEN = re.compile(r"[a-z]+|[0-9]+")
#: Raw-text elements and comments whole, then tags; a cut-off one runs to the end.
#: An svg closed in its own tag is empty; a longer name, as of <svg-icon>, is another element.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(script|style|textarea|title|noscript|template|iframe|svg)(?=[\s/>]|\Z)[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Page:
    """Block elements in page order, and the text events that they hold."""

    __slots__ = ("tag", "parent", "depth", "tokens", "own", "link", "stops", "events", "controls")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["#root"], [-1], [0], [()]
        self.own, self.link, self.stops, self.controls = [0], [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text; None: a block edge)
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [("#root", 0)]  # (tag, its block node)
        links = 0
        done = 0
        events = self.events
        for m in MARKUP.finditer(source):
            at, end = m.span()
            if at > done:
                self._text(source[done:at], stack[-1][1], links)
            done = end
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                if any(t == name for t, _ in stack[1:]):
                    while True:
                        t, node = stack.pop()
                        if t == "a":
                            links -= 1
                        if t not in INLINE:
                            events.append((stack[-1][1], None))
                        if t == name:
                            break
                elif name == "p" or name not in INLINE:
                    events.append((stack[-1][1], None))
                continue
            if name in CLOSES_P and any(t == "p" for t, _ in stack[1:]):
                while True:
                    t, _ = stack.pop()
                    links -= t == "a"
                    if t == "p":
                        break
            elif name == "li" or name in ("dt", "dd", "tr", "td", "th", "option"):
                mates = {"li": ("li",), "tr": ("tr", "td", "th"), "option": ("option",)}.get(name, ("dt", "dd") if name[0] == "d" else ("td", "th"))
                stop = ("ul", "ol", "dl", "table", "menu", "#root")
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in mates and stack[k][0] not in stop:
                    k -= 1
                if stack[k][0] in mates:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
            if name in ("input", "select", "button", "textarea"):
                self.controls[stack[-1][1]] += 1
            if name == "br":
                events.append((stack[-1][1], " "))
                continue
            node = stack[-1][1]
            if name not in INLINE:
                events.append((node, None))
                if name in VOID:
                    continue
                raw = m[4]
                tokens = tuple(x for _, v in ATTRIBUTE.findall(raw) for x in TOKEN.findall(v.lower())) if raw and "=" in raw else ()
                if len(stack) < MAX_DEPTH:
                    self.tag.append(name)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.tokens.append(tokens)
                    for c in (self.own, self.link, self.stops, self.controls):
                        c.append(0)
                    node = len(self.tag) - 1
                stack.append((name, node))
            elif name not in VOID and len(stack) < 2 * MAX_DEPTH:
                links += name == "a"
                stack.append((name, node))
        if done < len(source):
            self._text(source[done:], stack[-1][1], links)

    def _text(self, raw: str, node: int, links: int) -> None:
        text = html_module.unescape(raw) if "&" in raw else raw
        self.events.append((node, text))
        n = len(text)
        self.own[node] += n
        if links > 0:
            self.link[node] += n
        self.stops[node] += text.count(".") + text.count(",")

    def features(self, odds: dict[str, float]) -> np.ndarray:
        n = len(self.tag)
        size, link, stops, tags, paras, controls = list(self.own), list(self.link), list(self.stops), [1] * n, [t == "p" for t in self.tag], list(self.controls)
        kids, place, parent = [0] * n, [0] * n, self.parent
        for i in range(1, n):
            place[i] = kids[parent[i]]
            kids[parent[i]] += 1
        before, seen = [0] * n, 0
        for i in range(n):
            before[i] = seen
            seen += self.own[i]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            size[p] += size[i]
            link[p] += link[i]
            stops[p] += stops[i]
            tags[p] += tags[i]
            paras[p] += paras[i]
            controls[p] += controls[i]
        total = size[0] + 1
        out = np.zeros((n, 16 + 2 * KINDS))
        score, least, most, above = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
        rows = []
        for i in range(n):
            p = parent[i]
            kind = TAGS.get(self.tag[i], KINDS - 1)
            s = sum(odds.get(t, 0.0) for t in self.tokens[i])
            score[i] = s
            if p >= 0:
                least[i], most[i] = min(least[p], s), max(most[p], s)
                above[i] = above[p] | 1 << kind
            z = size[i]
            rows.append((self.depth[i], self.own[i], z, link[i] / (z + 1), z / total, z / (size[p] + 1) if p >= 0 else 1.0, place[i] / (kids[p] or 1) if p >= 0 else 0.0, kids[p] if p >= 0 else 1, tags[i], z / tags[i], 100 * stops[i] / (z + 1), paras[i], before[i] / total, s, least[i], most[i]))
            out[i, 16 + kind] = 1
        out[:, :16] = rows
        bits = np.array(above, dtype=np.int64)
        out[:, 16 + KINDS :] = bits[:, None] >> np.arange(KINDS) & 1
        return out

    def decode(self, p: np.ndarray) -> list[int]:
        """0 outside, 1 content, 2 excluded: the likeliest labelling without contradictions."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
        n, parent = len(yes), self.parent
        out, con, exc = list(no), list(yes), list(no)
        for i in range(n - 1, 0, -1):
            q = parent[i]
            out[q] += max(out[i], con[i] - BEGIN)
            con[q] += max(con[i], exc[i])
            exc[q] += exc[i]
        label = [0] * n
        for i in range(1, n):
            above = label[parent[i]]
            label[i] = 2 if above == 2 else (1 if con[i] >= exc[i] else 2) if above == 1 else (1 if con[i] - BEGIN > out[i] else 0)
        return label

    def text(self, label: list[int]) -> str:
        blocks, held = [], []
        for node, said in self.events:
            if said is None:
                if held:
                    blocks.append("".join(held))
                    held = []
            elif label[node] == 1:
                held.append(said)
        if held:
            blocks.append("".join(held))
        return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


class Extractor:
    """Attribute-token odds and boosted trees, fitted on generated pages."""

    def __init__(self, pages: int = TRAINING_PAGES, seed: int = 7):
        made = [generate(random.Random(seed * 100_003 + k)) for k in range(pages)]
        parsed = [(Page(source), marks) for source, marks in made]
        good, bad = Counter(), Counter()
        truth = []
        for page, marks in parsed:
            y = self._truth(page, marks)
            truth.append(y)
            for tokens, v in zip(page.tokens, y, strict=True):
                (good if v else bad).update(set(t for t in tokens if not t.startswith("truth")))
        g, b = sum(good.values()) + 1, sum(bad.values()) + 1
        self.odds = {t: math.log((good[t] + 0.5) / g) - math.log((bad[t] + 0.5) / b) for t in good | bad}
        x = np.concatenate([page.features(self.odds) for page, _ in parsed])
        self.model = Boosted().fit(x, np.concatenate(truth).astype(float))

    @staticmethod
    def _truth(page: Page, marks: list[bool]) -> list[bool]:
        """Generated pages list, in order of their start tags, which block elements are content."""
        return [False, *marks]

    def extract(self, sources: list[str | None]) -> list[str]:
        out, held, size = [""] * len(sources), [], 0

        def flush() -> None:
            p = self.model.predict(np.concatenate([f for _, _, f in held]))
            at = 0
            for k, page, f in held:
                out[k] = page.text(page.decode(p[at : at + len(f)]))
                at += len(f)
            held.clear()

        for k, source in enumerate(sources):
            if source:
                page = Page(source)
                held.append((k, page, page.features(self.odds)))
                size += len(held[-1][2])
                if size > 20_000:
                    flush()
                    size = 0
        if held:
            flush()
        return out


def generate(r: random.Random) -> tuple[str, list[bool]]:
    """A page in one of many layouts, and which of its block elements are main text."""
    out: list[str] = []
    marks: list[bool] = []
    words = ["".join(r.choice("aeiouéü" if k % 2 else "bcdlmnrst") for k in range(r.randint(1, 8))) for _ in range(60)]

    def prose(n: int) -> str:
        said = [r.choice(words) + (r.choice(". , , ;".split()) if r.random() < 0.12 else "") for _ in range(n)]
        if r.random() < 0.2 and n > 5:
            said[2] = f'<a href="/{said[2]}">{said[2]}</a>'
        return " ".join(said).capitalize() + r.choice([".", ".", "", "!"])

    def el(tag: str, content: bool, inner, *names: str, close: bool = True) -> None:
        marks.append(content)
        attrs = f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"' if names and r.random() < 0.85 else ""
        out.append(f"<{tag}{attrs}>")
        inner() if callable(inner) else out.append(inner)
        if close:
            out.append(f"</{tag}>")

    def links(content: bool = False) -> None:
        def items() -> None:
            for _ in range(r.randint(2, 9)):
                el("li", False, f'<a href="/{r.choice(words)}">{prose(r.randint(1, 3))}</a>')

        el("ul", False, items)

    def junk(where: str) -> None:
        kind = r.choice(["nav", "ad", "notice", "form", "side", "share", "related"])
        if kind == "nav":
            el(r.choice(["nav", "div"]), False, links, r.choice(["nav", "menu", "navigation", "breadcrumb", "topbar"]))
        elif kind == "ad":
            el("div", False, prose(r.randint(3, 30)), r.choice(["ad", "ads", "advert", "sponsored", "promo", "banner"]))
        elif kind == "notice":
            el(r.choice(["div", "section"]), False, lambda: el("p", False, prose(r.randint(5, 40))), r.choice(["cookie", "notice", "consent", "gdpr", "alert", "popup", "paywall", "newsletter"]))
        elif kind == "form":
            el("form", False, lambda: (out.append(f'<label>{prose(2)}</label><input name="q">'), el("button", False, prose(1))), r.choice(["search", "login", "subscribe", "signup"]))
        elif kind == "side":
            el(r.choice(["aside", "div"]), False, lambda: (el("h3", False, prose(2)), links()), r.choice(["sidebar", "widget", "aside", "side"]))
        elif kind == "share":
            el("div", False, links, r.choice(["share", "social", "tags", "toolbar"]))
        else:
            el("section" if r.random() < 0.5 else "div", False, lambda: (el("h3", False, prose(3)), links()), r.choice(["related", "recommended", "more", "popular"]))

    def comments() -> None:
        def one() -> None:
            for _ in range(r.randint(1, 5)):
                el(r.choice(["div", "article", "li"]), False, lambda: el("p", False, prose(r.randint(4, 50))), r.choice(["comment", "reply"]))

        el(r.choice(["section", "div"]), False, one, r.choice(["comments", "responses", "discussion", "disqus"]))

    def body() -> None:
        if r.random() < 0.85:
            el(r.choice(["h1", "h1", "h2"]), True, prose(r.randint(2, 12)))
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.7:
                el("p", True, ("<b>" if r.random() < 0.15 else "") + prose(int(r.choice([3, 8, 20, 40, 80, 150, 300]) * (0.5 + r.random()))) + ("<br>" if r.random() < 0.15 else ""))
            elif x < 0.76:
                el("h2", True, prose(r.randint(1, 6)))
            elif x < 0.82:
                el("blockquote", True, lambda: el("p", True, prose(r.randint(5, 40))))
            elif x < 0.88:
                el("ul", True, lambda: [el("li", True, prose(r.randint(2, 20))) for _ in range(r.randint(2, 6))])
            elif x < 0.91:
                el("table", True, lambda: el("tr", True, lambda: [el("td", True, prose(r.randint(1, 6))) for _ in range(3)]))
            elif x < 0.94:
                el("pre", True, prose(r.randint(4, 30)))
            else:
                junk("inside")

    def article() -> None:
        if r.random() < 0.6:
            el("article", True, body, *(["post"] if r.random() < 0.4 else []))
        else:
            el(r.choice(["div", "section", "main"]), True, body, r.choice(["content", "article", "post", "entry", "story", "text"]), *(["body"] if r.random() < 0.3 else []))

    def frame() -> None:
        if r.random() < 0.5:
            el("header", False, lambda: (el("h1" if r.random() < 0.2 else "p", False, prose(2)), links() if r.random() < 0.6 else None), r.choice(["header", "masthead", "top"]))
        if r.random() < 0.8:
            el("nav", False, links, "nav")
        for _ in range(r.randint(0, 3)):
            junk("top")
        if r.random() < 0.4:
            el(r.choice(["main", "div"]), False, lambda: (article(), comments() if r.random() < 0.4 else None, junk("side") if r.random() < 0.5 else None), r.choice(["wrapper", "container", "page", "layout"]))
        else:
            article()
            if r.random() < 0.4:
                comments()
        for _ in range(r.randint(0, 2)):
            junk("end")
        if r.random() < 0.85:
            el("footer" if r.random() < 0.8 else "div", False, (lambda: (el("p", False, "&copy; " + prose(r.randint(3, 25))), links() if r.random() < 0.4 else None)) if r.random() < 0.5 else "&copy; " + prose(r.randint(3, 25)), r.choice(["footer", "copyright", "bottom"]))

    el("html", False, lambda: el("body", False, frame))
    return "".join(out), marks


_fitted: dict[int, Extractor] = {}


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with ``text``: the main text of the whole page."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    # A few hundred kilobytes, however many pages there are.
    model = pages.sparkSession.sparkContext.broadcast(Extractor())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = model.value
        for b in batches:
            text = extractor.extract(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(text, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, F.col(html_col)).mapInArrow(run, f"{fields}, text string")
