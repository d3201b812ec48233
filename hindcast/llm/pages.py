"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text that no block
element parts. Each block is described by its ancestor tags (and words of their
class, id and role), its own text, its links and its place; a linear-chain CRF
labels the sequence as article or not, decoded by Viterbi. The labels of
neighbours count, so a short paragraph inside an article stays and a long one
inside a comment list goes.

Training: pages have no labels, so the field is trained on labelled pages that
are laid out here by a seeded rule: random layouts of the usual parts of a page
in varied markup, whose blocks are article or not by construction. Words and
languages play no part in the features, so that layouts are all it learns.

Nulls and edges: null or empty html gives an empty text; a page without
article blocks too; unclosed elements, truncated pages and stray end tags are
read as far as they go. Tags that may be left out end where a browser ends them: a
head at the first thing that is no metadata, an svg at the first element of a page.
Reading takes time in proportion to the page, however deep it is. Head, script, style, template, iframe and svg give no
text (no reader sees it as such). Formulas and what stands in for scripts, objects
and media are text like that of other inline elements; the field judges it.
`<br>` is white space inside a block.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import in_arrow, slices, table, unused

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td"
    " textarea tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head script style template title iframe svg".split())
INLINE = frozenset(
    "a abbr audio b bdi bdo canvas cite code data del dfn em font i ins kbd mark math noscript object q ruby s samp small span strong"
    " sub sup time tt u var video".split()
)
#: What a head may hold, and the elements of a page that an svg cannot hold.
METADATA = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre"
    " ruby s small span strike strong sub sup table tt u ul var".split()
)
PARTS = frozenset("nav header footer aside form article main section figure table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of the second kind (up to the nearest element of the third kind).
CLOSES = {
    **{t: (("p",), ("body", "html", "td", "th", "li", "button")) for t in BLOCKS - {"option", "html", "body", "label", "button", "select", "textarea"}},
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Kinds of page parts told by a word of a class, id or role.
HINTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs tabs pager pagination toc",
    "head": "header masthead banner topbar branding logo toolbar",
    "foot": "footer colophon copyright legal bottom",
    "side": "sidebar aside related recommended widget popular trending more rail teaser readmore promo",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promotion promoted dfp adsense",
    "note": "cookie cookies consent notice alert gdpr modal popup newsletter subscribe signup paywall disclaimer message",
    "form": "form search login field contact",
    "share": "share sharing social follow tags tag meta byline author date timestamp",
    "comment": "comment comments reply replies discussion disqus respond thread reader readers",
    "body": "article content entry post story main body text page articlebody entrycontent postcontent maincontent",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
SIZES = (3, 8, 15, 30, 60, 120)


@dataclass
class Block:
    text: str
    #: Known tags around it, each once, the innermost last.
    path: tuple[str, ...]
    hints: frozenset[str]
    #: The innermost ancestor that tells a part of a page by its name or tag.
    near: str
    linked: int
    label: int = 0


@dataclass(slots=True)
class Open:
    """An open element, and what its blocks inherit."""

    tag: str
    hints: frozenset[str]
    path: tuple[str, ...]
    near: str
    #: Whether its end ends a block; nothing does inside an element without text.
    parts_text: bool


class Leaves(HTMLParser):
    """The leaf blocks of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        #: Where in `open` each tag stands, ascending.
        self.at: dict[str, list[int]] = {}
        self.hints: Counter[str] = Counter()
        self.unseen = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            path, near = (self.open[-1].path, self.open[-1].near) if self.open else ((), "none")
            self.blocks.append(Block(text, path, frozenset(self.hints), near, self.linked))
        self.parts, self.linked = [], 0

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, or -1."""
        return self.at[tag][-1] if tag in self.at else -1

    def push(self, tag: str, hints: frozenset[str]) -> None:
        path, near = (self.open[-1].path, self.open[-1].near) if self.open else ((), "none")
        if (tag in BLOCKS or tag in INLINE) and path[-1:] != (tag,):
            path = (*(t for t in path if t != tag), tag)
        if hints or tag in PARTS:
            near = ",".join(sorted(hints)) or tag
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(Open(tag, hints, path, near, tag in BLOCKS and not self.unseen))
        self.hints.update(hints)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def pop(self, keep: int) -> None:
        """Close open elements down to `keep` of them."""
        if any(e.parts_text for e in self.open[keep:]):
            self.flush()
        while len(self.open) > keep:
            e = self.open.pop()
            self.at[e.tag].pop()
            if not self.at[e.tag]:
                del self.at[e.tag]
            for h in e.hints:
                self.hints[h] -= 1
                if not self.hints[h]:
                    del self.hints[h]
            self.unseen -= e.tag in UNSEEN
            self.links -= e.tag == "a"

    def end_unseen(self, tag: str) -> None:
        """Close what a start tag ends without an end tag: svg, head, and before a body whatever gives no text."""
        while tag in ENDS_SVG and self.last("svg") > self.last("foreignobject"):
            self.pop(self.last("svg"))
        if self.unseen == 1 and "head" in self.at and tag not in METADATA:
            self.pop(self.last("head"))
        if tag == "body" and self.unseen:
            self.pop(min(self.at[t][0] for t in UNSEEN if t in self.at))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            self.end_unseen(tag)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "head" and any(t != "html" for t in self.at):  # a page has one head, at its start
            return
        ended, until = CLOSES.get(tag, ((), ()))
        floor = max(map(self.last, (*until, "template", "foreignobject")))
        cuts = [self.at[t][k] for t in ended if t in self.at and (k := bisect_right(self.at[t], floor)) < len(self.at[t])]
        if cuts:
            self.pop(min(cuts))
        if tag in BLOCKS and not self.unseen:
            self.flush()
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.push(tag, frozenset(HINT_OF[w] for w in map(str.lower, WORDS.findall(named)) if w in HINT_OF))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.at:
            self.pop(self.last(tag))
        elif tag == "p":
            self.flush()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.unseen == 1 and self.open[-1].tag == "head" and data.strip():
            self.pop(len(self.open) - 1)
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    parser = Leaves()
    parser.feed(html)
    parser.close()
    parser.pop(0)
    parser.flush()
    return parser.blocks


def block_features(blocks: Sequence[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        size = len(b.text.split())
        own = b.path[-1] if b.path else "none"
        share = b.linked / max(1, len(b.text))
        names = ["always", f"tag:{own}", f"size:{sum(size >= s for s in SIZES)}", f"links:{sum(share > s for s in (0.1, 0.5, 0.9))}"]
        names += [f"under:{t}" for t in set(b.path) - {"html", "body"}] + [f"hint:{h}" for h in b.hints]
        if b.hints and "body" not in b.hints:
            names.append("hint:other")
        names += [f"near:{h}" for h in b.near.split(",")]
        names.append(f"place:{min(4, 5 * k // n)}")
        if b.text[-1] in ".!?…。\"”»":
            names.append("ends")
        if "©" in b.text or "·" in b.text:
            names.append("marks")
        out.append(names)
    return out


@dataclass
class Field:
    """Weights of features by label and of label pairs."""

    numbers: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, names: Sequence[Sequence[str]]) -> np.ndarray:
        out = np.zeros((len(names), 2))
        for k, own in enumerate(names):
            found = [self.numbers[f] for f in own if f in self.numbers]
            out[k] = self.weights[found].sum(0)
        return out

    def decode(self, names: Sequence[Sequence[str]]) -> list[int]:
        """The best labels of a page (Viterbi); ties go to `not article`."""
        scores = self.scores(names)
        best, back = scores[0], []
        for s in scores[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(0))
            best = paths.max(0) + s
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def train(pages: Sequence[Sequence[Block]], rounds: int = 50, step: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient steps; expectations by forward and backward sums over all pages at once."""
    pages = [p for p in pages if p]
    named = [block_features(p) for p in pages]
    numbers = {f: k for k, f in enumerate(sorted({f for page in named for own in page for f in own}))}
    rows = np.concatenate([np.full(len(own), k) for k, own in enumerate(x for page in named for x in page)])
    columns = np.array([numbers[f] for page in named for own in page for f in own])
    gold = np.array([b.label for p in pages for b in p])
    sizes = np.array([len(p) for p in pages])
    longest, n, total = int(sizes.max()), len(pages), len(gold)
    mask = np.arange(longest)[None, :] < sizes[:, None]
    model = Field(numbers, np.zeros((len(numbers), 2)))
    seen_pairs = np.zeros((2, 2))
    stops = np.cumsum(sizes)
    inner = np.ones(total, bool)
    inner[stops - sizes] = False
    np.add.at(seen_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    seen = np.zeros((len(numbers), 2))
    np.add.at(seen, (columns, gold[rows]), 1)
    slow = [np.zeros_like(model.weights), np.zeros((2, 2))]
    square = [np.zeros_like(model.weights), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        flat = np.stack([np.bincount(rows, weights=model.weights[columns, y], minlength=total) for y in (0, 1)], 1)
        score = np.zeros((n, longest, 2))
        score[mask] = flat
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + model.moves[None], axis=1) + score[:, t]
        for t in range(longest - 2, -1, -1):
            later = np.logaddexp.reduce(model.moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], later, 0)
        whole = np.logaddexp.reduce(ahead[np.arange(n), sizes - 1], axis=1)
        expected = np.exp(ahead + behind - whole[:, None, None])[mask]
        pairs = ahead[:, :-1, :, None] + model.moves + (score + behind)[:, 1:, None, :] - whole[:, None, None, None]
        pairs = np.exp(pairs[mask[:, 1:]]).sum(0)
        got = np.stack([np.bincount(columns, weights=expected[rows, y], minlength=len(numbers)) for y in (0, 1)], 1)
        for i, (value, grad) in enumerate(((model.weights, (seen - got) / n), (model.moves, (seen_pairs - pairs) / n))):
            grad -= ridge * value
            slow[i] = 0.9 * slow[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad**2
            value += step * (1 - (k - 1) / rounds) * (slow[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
    return model


def labelled_page(rng: np.random.Generator) -> str:
    """A page of random layout. Article blocks carry the mark \\x01 at their start."""

    def text(low: int, high: int, end: str = ".") -> str:
        return " ".join("w" * int(k) for k in rng.integers(1, 9, int(rng.integers(low, high + 1)))) + end

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def links(low: int, high: int) -> str:
        items = [f'<a href="/x">{text(1, 4, "")}</a>' for _ in range(int(rng.integers(low, high + 1)))]
        return pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items))

    def named(tag: str, *names: str) -> tuple[str, str]:
        name = pick(*names, "")
        return (f'<{tag} {pick("class", "id")}="{name}">' if name else f"<{tag}>"), f"</{tag}>"

    def part(kind: str) -> str:
        if kind == "nav":
            a, z = pick("1", "2") == "1" and named("nav", "menu", "main-nav") or ('<div class="' + pick("menu", "navbar", "breadcrumb", "topnav nav") + '">', "</div>")
            return a + links(3, 9) + z
        if kind == "header":
            a, z = pick("1", "2") == "1" and named("header", "site-header", "masthead") or ('<div class="' + pick("header", "banner", "masthead") + '">', "</div>")
            return a + pick(f"<h1>{text(1, 4, '')}</h1>", f"<p>{text(2, 8)}</p>", f"<a href='/'>{text(1, 3, '')}</a>", f"<div>{text(1, 5, '')}</div>") + z
        if kind == "footer":
            a, z = pick("1", "2") == "1" and named("footer", "site-footer", "footer") or ('<div class="' + pick("footer", "colophon", "site-footer") + '">', "</div>")
            return a + pick(f"&copy; {text(2, 12)}", f"<p>&copy; {text(3, 20)}</p>", f"<p>{text(4, 25)}</p>" + links(1, 5), f"&copy; x &middot; {text(5, 20)}") + z
        if kind == "side":
            a, z = pick("1", "2") == "1" and named("aside", "sidebar", "related") or ('<div class="' + pick("sidebar", "related", "widget popular", "recommended") + '">', "</div>")
            return a + f"<h3>{text(1, 4, '')}</h3>" + pick(links(2, 6), f"<p>{text(4, 30)}</p>", f"<p>{text(5, 40)}</p><p>{text(5, 20)}</p>") + z
        if kind == "ad":
            return f'<{pick("div", "aside", "section")} class="{pick("ad", "ads", "advert", "sponsored", "ad-banner", "promo")}">' + pick(text(4, 40), f"<p>{text(4, 40)}</p>", f"<a href='#'>{text(3, 12)}</a>") + pick("</div>", "</div>")
        if kind == "note":
            return f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "consent", "newsletter", "alert", "popup")}">' + pick(text(5, 40), f"<p>{text(5, 40)}</p><button>{text(1, 2, '')}</button>") + "</div>"
        if kind == "form":
            return f'<form action="/s"><label>{text(1, 4, "")}</label><input><button>{text(1, 2, "")}</button>' + pick("", f"<p>{text(4, 20)}</p>") + "</form>"
        if kind == "share":
            return f'<div class="{pick("share", "social", "tags", "byline", "post-meta")}">' + pick(links(2, 4), text(2, 8, "")) + "</div>"
        body = "".join(pick(f"<div class='comment'><p>{text(4, 60)}</p></div>", f"<li>{text(3, 50)}</li>", f"<p>{text(4, 60)}</p>") for _ in range(int(rng.integers(1, 6))))
        a, z = named(pick("section", "div", "ul"), *[pick("comments", "comment-list", "discussion", "reader-comments", "replies")] * 6)
        return (a if "=" in a else '<div class="comments">') + pick("", f"<h3>{text(1, 3, '')}</h3>") + body + (z if "=" in a else "</div>")

    def article() -> str:
        mark = "\x01"
        blocks = [f"<h1>{mark}{text(3, 14, pick('', '.'))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.7:
                size = (1, 6) if rng.random() < 0.15 else (8, 120)
                blocks.append(f"<p>{mark}{pick('', '<b>')}{text(*size)}" + pick("</p>", "</p>", "<br>", ""))
            elif kind < 0.8:
                blocks.append(f"<h2>{mark}{text(1, 8, '')}</h2>")
            elif kind < 0.87:
                blocks.append("<ul>" + "".join(f"<li>{mark}{text(2, 25)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.92:
                blocks.append(f"<blockquote>{mark}{text(5, 40)}</blockquote>")
            elif kind < 0.96:
                blocks.append(f"<p>{mark}{text(5, 30, '')} <a href='/y'>{text(1, 6, '')}</a> {text(3, 30)}</p>")
            else:
                blocks.append(f"<pre>{mark}{text(3, 30)}</pre>")
        for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.5 else 0):
            blocks.insert(int(rng.integers(1, len(blocks) + 1)), part(pick("ad", "ad", "share", "side", "note", "form")))
        if rng.random() < 0.15:
            blocks.append(part("comment"))
        a, z = pick("article", "article", "main", "div", "section"), ""
        a, z = (f"<{a}>" if a in ("article", "main") and rng.random() < 0.6 else f'<{a} {pick("class", "id")}="{pick("content", "post-content", "entry", "article-body", "story", "main")}">'), f"</{a}>"
        if rng.random() < 0.25:  # a container that tells nothing, or none
            name = pick("", "", "container", "wrapper", "row", "col", "inner")
            a, z = pick(("", ""), (f'<div class="{name}">' if name else "<div>", "</div>"))
        whole = a + "".join(blocks) + z
        if rng.random() < 0.3:
            whole = f"<main>{whole}{''.join(part(k) for k in ('side', 'share', 'ad', 'comment') if rng.random() < 0.4)}</main>"
        return whole

    before = [part(k) for k in ("header", "nav", "note", "ad", "form", "share", "side") if rng.random() < 0.4]
    after = [part(k) for k in ("share", "side", "ad", "comment", "form", "note") if rng.random() < 0.4] + [part("footer")] * (rng.random() < 0.85)
    layout = rng.random()
    if layout < 0.08:  # nothing but the article, in a page that names no parts
        before, after = [], []
    inside = article()
    if layout < 0.16:
        cells = ["".join(before), inside, "".join(after)]
        body = "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells if c) + "</tr></table>"
    else:
        body = "".join(before) + inside + "".join(after)
    if rng.random() < 0.1:  # a form around the whole page
        body = f'<form action="/page">{pick(body, f"<div>{body}</div>")}</form>'
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@lru_cache(maxsize=1)
def trained(n_pages: int = 1200, seed: int = 7) -> Field:
    rng = np.random.default_rng(seed)
    pages = []
    for _ in range(n_pages):
        blocks = leaf_blocks(labelled_page(rng))
        for b in blocks:
            b.label = int(b.text.startswith("\x01"))
            b.text = b.text.replace("\x01", "").strip() or "-"
        pages.append(blocks)
    return train(pages, rounds=120)


def main_text(html: str, model: Field) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = model.decode(block_features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, html: str = "html", out: str = "text", model: Field | None = None) -> DataFrame:
    """pages without html, with the main text in `out`."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    rest = [f for f in pages.schema.fields if f.name != html]
    name = unused(out, [f.name for f in rest])
    schema = T.StructType([*rest, T.StructField(name, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            texts = [main_text(h, sent.value) if h else "" for h in batch.column(html).to_pylist()]
            arrays = [batch.column(f.name) for f in rest] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return pages.transform(in_arrow, run, schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
