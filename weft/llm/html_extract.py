"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding.

Every structural node gets features of its subtree (text, link and tag
density), its attribute tokens, its depth, its ancestors and its siblings.
Boosted trees give the log odds that it is main content. A dynamic program over
the tree then picks the best consistent states: outside, inside the main
content, or cut out of it. A node can only enter the content below an outside
node and nothing below a cut comes back, so ancestors and descendants never
contradict each other.

The trees are trained here on pages that ``sample_page`` composes from random
templates with known labels; no crawl is needed and training is deterministic.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import prepare

COMMENT, DECLARATION = r"<!--.*?(?:-->|\Z)", r"<(?:[!?]|/(?![a-zA-Z]))[^>]*>"
#: Quotes count directly after an equals sign only, and one without a partner is a letter like any other.
TAG = re.compile(COMMENT + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?)*+)>|""" + DECLARATION, re.S)
#: Tags that end at the first > whatever the quotes.
LOOSE = re.compile(COMMENT + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|" + DECLARATION, re.S)
OPENS = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math head select object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the same kind, and where the search for it stops.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
#: Words in class, id and role attributes that speak for a part of a page.
HINTS = {
    "advert": "ad ads advert adverts advertisement adsense banner promo promoted promotion sponsor sponsored dfp teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast dialog disclaimer paywall announcement",
    "sidebar": "sidebar side rail aside widget widgets related recommended recommendations popular trending more complementary secondary",
    "comments": "comment comments reply replies respond disqus discussion responses commentlist reviews thread",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager skip toc links tags share sharing social",
    "edge": "footer header masthead foot head top bottom topbar copyright legal colophon logo branding contentinfo",
    "form": "form login signup subscribe newsletter search register contact signin",
    "content": "article content post entry main body story text prose richtext page news blog",
}
HINTS = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
N_HINTS = 8
KINDS = {t: i for i, t in enumerate("article main section div p heading list li table cell quote pre nav header footer aside form body figure other".split())}
KINDS |= {f"h{i}": KINDS["heading"] for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), KINDS["list"]) | dict.fromkeys(("dt", "dd"), KINDS["li"]) | dict.fromkeys(("td", "th"), KINDS["cell"]) | dict.fromkeys(("tbody", "thead", "tr"), KINDS["table"]) | {"blockquote": KINDS["quote"], "figcaption": KINDS["figure"], "html": KINDS["body"]} | dict.fromkeys(("fieldset", "button", "input"), KINDS["form"])
N_KINDS = len(set(KINDS.values()))


class Page:
    """Structural nodes in document order and the text between block boundaries."""

    def __init__(self, source: str, keep: bool = False):
        """keep: hold the attributes too, for labels()."""
        self.keep = keep
        self.attributes: list[str] = [""]
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.hints: list[tuple[int, ...]] = [()]
        #: (node, text, inside a link); text None is a block boundary
        self.events: list[tuple[int, str | None, bool]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # tag and its structural node
        #: where the open elements of each tag stand in the stack, and where those stand that are not inline
        where: dict[str, list[int]] = {}
        blocks = [0]
        events = self.events
        at = 0
        rule = TAG

        def push(tag: str, node: int) -> None:
            where.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append((tag, node))

        def cut(i: int) -> None:
            """Close the element at place i and all in it: each is closed once."""
            while len(stack) > i:
                where[stack.pop()[0]].pop()
            while blocks[-1] >= i:
                blocks.pop()

        def last(tag: str) -> int:
            """The place of the innermost open element of that tag, else 0."""
            return where[tag][-1] if where.get(tag) else 0

        while True:
            lo = s.find("<", at)
            if lo > at or lo < 0 and at < len(s):
                events.append((stack[-1][1], s[at : lo if lo >= 0 else len(s)], bool(where.get("a"))))
            if lo < 0:
                return
            if not OPENS.match(s, lo):
                events.append((stack[-1][1], "<", bool(where.get("a"))))
                at = lo + 1
                continue
            m = rule.match(s, lo)
            if m is None:  # every later > stands in a quoted value of this tag; the rest of the page is read loosely, which keeps it linear
                rule = LOOSE
                m = rule.match(s, lo)
                if m is None:
                    return  # the page ends inside a tag
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                i = last(tag)
                if tag == "p" and not i:
                    events.append((stack[-1][1], None, False))
                if i and (tag not in INLINE or i >= blocks[-1]):
                    if blocks[-1] >= i:
                        events.append((stack[i][1], None, False))
                    cut(i)
                continue
            if tag in RAW:
                if tag == "head":  # what it holds are raw or void elements
                    continue
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at)
                    at = end.end() if end else len(s)
                continue
            if tag in VOID:
                events.append((stack[-1][1], " " if tag in ("br", "wbr", "img", "input") else None, False))
                continue
            if tag in CLOSES_P and (i := last("p")) and i >= blocks[-1]:
                cut(i)
            if tag in SIBLINGS:
                same, limit = SIBLINGS[tag]
                i = max(map(last, same))
                if i and i > max(map(last, limit)):
                    cut(i)
            if m[3].endswith("/") and tag not in INLINE and tag not in KINDS:
                continue
            if tag in INLINE:
                if m[3] and tag in ("span", "a", "small", "ins") and self._hints(m[3]):
                    push(tag, self._node(tag, m[3], stack[-1][1]))
                else:
                    push(tag, stack[-1][1])
                continue
            node = self._node(tag, m[3], stack[-1][1])
            events.append((node, None, False))
            push(tag, node)

    @staticmethod
    def _hints(attributes: str) -> tuple[int, ...]:
        found = set()
        if "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                found.update(h for t in TOKEN.findall(m[2] or m[3] or m[4] or "") if (h := HINTS.get(t.lower())) is not None)
        return tuple(found)

    def _node(self, tag: str, attributes: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.hints.append(self._hints(attributes))
        self.attributes.append(attributes if self.keep else "")
        return len(self.tag) - 1

    def labels(self) -> list[int]:
        """What the attribute y of a generated page says of each node; it passes to descendants. Pages that are extracted never get here."""
        out = [-1]
        for parent, attributes in zip(self.parent[1:], self.attributes[1:], strict=True):
            m = re.search(r" y=([01])", attributes)
            out.append(int(m[1]) if m else out[parent])
        return out

    def features(self) -> np.ndarray:
        """A row for each node but the root."""
        n = len(self.tag)
        own, links, stops, words, blocks = (np.zeros(n) for _ in range(5))
        for node, text, linked in self.events:
            if text is None:
                continue
            size = len(text) - text.count(" ") if len(text) < 64 else len(text)
            if size <= 0:
                continue
            own[node] += size
            links[node] += size if linked else 0
            stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            words[node] += text.count(" ") + 1
        direct = own.copy()
        parent = np.array(self.parent)
        tags, paragraphs, items, kids = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for i, t in enumerate(self.tag):
            if t == "p":
                paragraphs[i] = 1
            elif t == "li":
                items[i] = 1
        for i in range(n - 1, 0, -1):  # children follow their parents
            p = self.parent[i]
            kids[p] += 1
            own[p] += own[i]
            links[p] += links[i]
            stops[p] += stops[i]
            words[p] += words[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            items[p] += items[i]
        kind = np.array([KINDS.get(t, KINDS["other"]) for t in self.tag])
        hint = np.zeros((n, N_HINTS))
        for i, h in enumerate(self.hints):
            hint[i, list(h)] = 1
        above = np.zeros((n, N_HINTS))
        kinds_above = np.zeros((n, N_KINDS))
        index, prose = np.zeros(n), np.zeros(n)
        seen = np.zeros(n)
        for i in range(1, n):
            p = self.parent[i]
            above[i] = np.maximum(above[p], hint[p])
            kinds_above[i] = kinds_above[p]
            kinds_above[i, kind[p]] = 1
            index[i] = seen[p]
            seen[p] += 1
            if kind[i] == KINDS["p"]:
                prose[p] += direct[i]
        total = max(1.0, own[0])
        siblings = kids[parent]
        previous = np.zeros(n)
        last: dict[int, int] = {}
        for i in range(1, n):
            previous[i] = kind[last[parent[i]]] + 1 if parent[i] in last else 0
            last[parent[i]] = i
        one_hot = np.zeros((n, N_KINDS))
        one_hot[np.arange(n), kind] = 1
        dense = np.stack(
            [np.array(self.depth), np.log1p(own), links / np.maximum(1, own), own / tags, stops / np.maximum(1, words), np.log1p(paragraphs), np.log1p(items), kids, np.log1p(direct), own / total, own / np.maximum(1, own[parent]), index, index / np.maximum(1, siblings), siblings, prose / np.maximum(1, own), np.log1p(own[parent]), links[parent] / np.maximum(1, own[parent]), np.log1p(paragraphs[parent]), previous, words / np.maximum(1, tags)],
            axis=1,
        )
        return np.concatenate([dense, one_hot, kinds_above, hint, above], axis=1)[1:]

    def text(self, inside: np.ndarray) -> str:
        """Blocks of the nodes marked inside, in page order."""
        blocks, now = [], []

        def flush() -> None:
            if now:
                words = entities.unescape("".join(now)).split()
                if words:
                    blocks.append(" ".join(words))
                now.clear()

        for node, text, _ in self.events:
            if text is None:
                flush()
            elif inside[node]:
                now.append(text)
        flush()
        return "\n\n".join(blocks)


OUTSIDE, INSIDE, CUT = range(3)
ENTER, LEAVE = 0.3, 0.7


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The consistent states of the nodes (root first, outside) with the largest total log odds, less a price for each entry and each cut."""
    n = len(parent)
    gain = np.zeros((n, 3))
    gain[1:, INSIDE] = odds
    choice = np.zeros((n, 3), np.int64)
    best = gain.tolist()
    for i in range(n - 1, 0, -1):
        out, inn, cut = best[i]
        p = best[parent[i]]
        enter, leave = inn - ENTER, cut - LEAVE
        choice[i, OUTSIDE] = INSIDE if enter > out else OUTSIDE
        choice[i, INSIDE] = INSIDE if inn >= leave else CUT
        choice[i, CUT] = CUT
        p[OUTSIDE] += max(out, enter)
        p[INSIDE] += max(inn, leave)
        p[CUT] += cut
    state = [OUTSIDE] * n
    for i in range(1, n):
        state[i] = int(choice[i, state[parent[i]]])
    return np.array(state)


_SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve qu und ch ein ge ier aux ción ar os".split()
_CONTENT_NAMES = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "page-body", "blog-post", ""]


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) + r.choice([""] * 8 + [",", "."]) for _ in range(n)]
    return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!"])


def sample_page(r: random.Random) -> str:
    """A page of random make-up; attribute y tells content (1) from the rest (0) and passes to descendants."""

    def wrap(tag: str, body: str, name: str = "", y: int | None = None) -> str:
        mark = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{mark}{'' if y is None else f' y={y}'}>{body}</{tag}>"

    def prose() -> str:
        n = max(1, int(r.lognormvariate(3, 1.3)))
        text = _words(r, min(n, 250))
        if r.random() < 0.15:
            text += f' <a href="/x">{_words(r, r.randint(1, 5))}</a> {_words(r, 5)}'
        return text

    def paragraph() -> str:
        if r.random() < 0.1:
            return f"<p><b>{prose()}<br>"  # left open
        return wrap("p", prose(), r.choice([""] * 9 + ["intro", "lead", "text"]))

    def menu() -> str:
        items = "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(r.randint(2, 9)))
        return r.choice([wrap("nav", f"<ul>{items}</ul>"), wrap("div", f"<ul>{items}</ul>", r.choice(["menu", "navbar", "nav-links", "breadcrumbs"])), wrap("nav", items.replace("li>", "span>")), f"<ul>{items}</ul>"])

    def aside() -> str:
        body = r.choice([wrap("h3", _words(r, 2)) + menu(), wrap("h4", _words(r, 2)) + "".join(wrap("p", _words(r, r.randint(3, 40))) for _ in range(r.randint(1, 4))), wrap("p", _words(r, r.randint(2, 60)))])
        return r.choice([wrap("aside", body, r.choice(["", "related"])), wrap("div", body, r.choice(["sidebar", "side-rail", "widget", "related-posts", "recommended"]))])

    def advert() -> str:
        return wrap(r.choice(["div", "div", "aside", "section", "p"]), r.choice([_words(r, r.randint(2, 25)), wrap("p", _words(r, r.randint(2, 30))), f'<a href="/b">{_words(r, 6)}</a>']), r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-ad"]), 0)

    def notice() -> str:
        return wrap("div", wrap("p", _words(r, r.randint(5, 40))) + r.choice(["", "<button>OK</button>"]), r.choice(["cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "cookie-banner"]), 0)

    def form() -> str:
        return wrap("form", r.choice(["", wrap("p", _words(r, r.randint(3, 15)))]) + f"<label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button>", r.choice(["", "newsletter", "search", "login"]), 0)

    def comments() -> str:
        one = lambda: wrap(r.choice(["div", "li", "div", "li", "article"]), wrap(r.choice(["b", "h4", "span"]), _words(r, 1)) + "".join(wrap("p", _words(r, r.randint(2, 60))) for _ in range(r.randint(1, 2))), r.choice(["comment", "reply", "comment-body", ""]))
        return wrap(r.choice(["section", "div", "ol", "aside"]), r.choice(["", wrap("h3", _words(r, 2))]) + "".join(one() for _ in range(r.randint(1, 6))), r.choice(["comments", "commentlist", "discussion", "user-comments", "responses", "disqus_thread"]), 0)

    def top() -> str:
        body = r.choice([wrap("h2", _words(r, 2)), wrap("div", _words(r, 3), "logo"), wrap("p", _words(r, 6))]) + r.choice(["", menu()])
        return r.choice([wrap("header", body), wrap("div", body, r.choice(["header", "masthead", "topbar", "site-header"]))])

    def bottom() -> str:
        body = r.choice([f"&copy; {_words(r, r.randint(2, 12))}", wrap("p", f"&copy; {_words(r, 6)}") + r.choice(["", menu()]), "".join(wrap("p", _words(r, r.randint(3, 20))) for _ in range(2))])
        return r.choice([wrap("footer", body), wrap("footer", body), wrap("div", body, r.choice(["footer", "site-footer", "colophon", "copyright"]))])

    parts = [r.choice(["", wrap(r.choice(["h1", "h1", "h2"]), _words(r, r.randint(1, 12)))])]
    for _ in range(max(1, int(r.lognormvariate(1.0, 0.9)))):
        parts.append(paragraph())
        x = r.random()
        if x < 0.06:
            parts.append(wrap(r.choice(["h2", "h3"]), _words(r, r.randint(1, 6))))
        elif x < 0.1:
            parts.append(wrap(r.choice(["ul", "ol"]), "".join(wrap("li", _words(r, r.randint(1, 20))) for _ in range(r.randint(1, 5)))))
        elif x < 0.13:
            parts.append(wrap("blockquote", r.choice([_words(r, 15), wrap("p", _words(r, 20))])))
        elif x < 0.15:
            parts.append(wrap("table", "".join(wrap("tr", "".join(wrap("td", _words(r, r.randint(1, 4))) for _ in range(3))) for _ in range(r.randint(1, 4)))))
        elif x < 0.17:
            parts.append(wrap("pre", _words(r, 10)))
        elif x < 0.19:
            parts.append(wrap("figure", "<img src=x>" + wrap("figcaption", _words(r, 6))))
        elif x < 0.26:
            parts.append(advert())
        elif x < 0.28:
            parts.append(wrap("aside", wrap("p", _words(r, r.randint(3, 30))), r.choice(["", "related", "promo"]), 0))
        elif x < 0.30:
            parts.append(form())
    if r.random() < 0.12:
        parts.append(wrap("div", menu(), r.choice(["share", "tags", "social-links"]), 0))
    if r.random() < 0.12:
        parts.append(comments())
    body = "".join(parts)
    if r.random() < 0.1:
        body = wrap("header", parts[0], "", 1) + "".join(parts[1:])
    kind = r.random()
    if kind < 0.5:
        core = wrap("article", body, r.choice(["", "", *_CONTENT_NAMES]), 1)
        core = wrap("main", core) if r.random() < 0.3 else core
    elif kind < 0.65:
        core = wrap("main", body, r.choice(_CONTENT_NAMES), 1)
    elif kind < 0.9:
        core = wrap(r.choice(["div", "section"]), body, r.choice(_CONTENT_NAMES[:-1]), 1)
    else:
        core = wrap("div", body, "", 1)
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        core = wrap("div", core + (aside() if r.random() < 0.3 else ""), r.choice(["", "wrapper", "container", "row", "layout", "page"]))
    before = [f() for f, p in ((notice, 0.25), (top, 0.4), (menu, 0.7), (advert, 0.5), (form, 0.1), (aside, 0.15)) if r.random() < p]
    after = [f() for f, p in ((advert, 0.2), (comments, 0.3), (aside, 0.4), (form, 0.15), (menu, 0.15), (notice, 0.15), (bottom, 0.85)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    if r.random() < 0.06:
        core = ""
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body y=0>{''.join(before)}{core}{''.join(after)}</body></html>"


@functools.lru_cache(maxsize=2)
def train(pages: int = 1000, seed: int = 11) -> boosting.Boosted:
    r = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        page = Page(sample_page(r), keep=True)
        x.append(page.features())
        y.append([max(0, v) for v in page.labels()[1:]])
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(float))


def extract(pages: list[str | None], model: boosting.Boosted) -> Iterator[str]:
    """Main text of each page; null has none."""
    parsed = [Page(p or "") for p in pages]
    size = [len(p.tag) - 1 for p in parsed]
    if sum(size):
        odds = np.clip(model.log_odds(np.concatenate([p.features() for p in parsed if len(p.tag) > 1])), -6, 6)
    at = 0
    for page, n in zip(parsed, size, strict=True):
        if not n:
            yield page.text(np.array([False]))
            continue
        state = decode(page.parent, odds[at : at + n])
        at += n
        yield page.text(state == INSIDE)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row.

    pages needs page_id, url and html; other columns are ignored. Null, empty
    and tagless html give an empty text; blocks are joined by an empty line.
    Broken markup loses no text: a quote counts only directly after an equals
    sign, a tag whose quote has no partner ends at the next >, and elements that
    are left open end with their parent. Pages of any length are read whole, in
    time that grows with their length; repeated pages get a row each, and equal
    html gives equal text.
    """
    prepare(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(train())  # fixed size

    def work(batches):
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = list(extract(part.column(2).to_pylist(), model))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(work, "page_id long, url string, text string, n_chars long")
