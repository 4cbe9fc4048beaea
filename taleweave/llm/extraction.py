"""HTML extraction: a tree-structured graphical model says which elements of a page are its main text.

Every block element is a node that is content or not. Its own evidence comes from its tag, the words of its class, id and
role, and its text (length, links, sentences); a potential for each kind of child ties it to its parent. Messages pass up
the tree and down again (sum-product), which gives each node's marginal; text of nodes whose marginal exceeds one half is
kept. Nodes of many pages are worked on together, level by level.

The model is trained by maximum likelihood on labelled pages. Where a page has an ``article`` element, that says what is
content; elsewhere the smallest element that holds most of the page's prose does (text that is long or ends a sentence, with
few links, outside of elements that say they are something else). Each page is learned from as it is, with the names and
tags of its content's containers taken away, and with its paragraphs laid out anew in other common page structures: in
containers of many names or of none, in table cells, or straight in the body.

Text comes from the whole page: character references are decoded, white space inside a block is one space, blocks stand
in page order, one a line. Parts of forms are never text. A null page is an empty one; a page without main text gives an
empty text. Where no page of the sample has any prose, nothing can be learned, and every page's text is empty. Rows that
repeat a page are read each. An empty table gives an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taleweave.llm.common import Adam, logistic, slices
from taleweave.llm.dom import Page, parse

#: Bounds of the learning sample: pages of the table, and characters of a page.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 30_000
#: Structures that each learned page's paragraphs are laid out in.
LAYOUTS = 6
#: Slots of hashed features.
SLOTS = 1 << 12
#: Tags whose ties to their parents are learned one by one.
KINDS = ("p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "li", "h1", "h2")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


_SLOT_OF: dict[str, int] = {}


def _hashed(feature: str) -> int:
    if feature not in _SLOT_OF:
        if len(_SLOT_OF) > 1 << 16:  # names of classes are without bound
            _SLOT_OF.clear()
        _SLOT_OF[feature] = _slot(feature)
    return _SLOT_OF[feature]


@dataclass
class Forest:
    """Nodes of several pages: parents (-1 for pages), depth, kind of tie, and features as (node, slot)."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    slot: np.ndarray
    first: np.ndarray  # first node of each page, one more entry than pages


def forest(pages: list[Page]) -> Forest:
    parent, depth, kind, at, slot, first = [], [], [], [], [], [0]
    kinds = {t: k for k, t in enumerate(KINDS)}
    base = 0
    for page in pages:
        texts = [""] * len(page.parent)
        for node, text in page.blocks:
            texts[node] = text
        for k, tag in enumerate(page.tag):
            up = page.parent[k]
            parent.append(up + base if up >= 0 else -1)
            kind.append(kinds.get(tag, len(KINDS)))
            chars, text = page.chars[k], texts[k]
            own = [f"t:{tag}", "bias"]
            own += [f"n:{w}" for w in page.names[k]]
            if up >= 0:
                own.append(f"u:{page.tag[up]}>{tag}")
                own += [f"un:{w}" for w in page.names[up]]
            if chars:
                own.append(f"c:{min(8, chars.bit_length())}")
                own.append(f"l:{min(4, 4 * page.linked[k] // chars)}")
                own.append("stop" if text[-1] in ".!?:;\"'" else "nostop")
                if "©" in text:
                    own.append("copyright")
            else:
                own.append("notext")
            at += [base + k] * len(own)
            slot += [_hashed(f) for f in own]
        depth += page.depth
        base += len(page.parent)
        first.append(base)
    as_array = lambda x: np.array(x, np.int64)
    return Forest(*map(as_array, (parent, depth, kind, at, slot, first)))


def _soft(x: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Log-odds that one end of a tie sends to the other: ``tie`` holds gains of (0,0), (0,1), (1,0), (1,1) by column."""
    return np.logaddexp(tie[:, 2], tie[:, 3] + x) - np.logaddexp(tie[:, 0], tie[:, 1] + x)


def messages(f: Forest, unary: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product on all trees: log-odds of each node from below, what it sends up, and what comes down to it.

    ``ties`` has a row for each node: gains of (parent, child) being 00, 01, 10, 11.
    """
    below, up, down = unary.copy(), np.zeros_like(unary), np.zeros_like(unary)
    order = np.argsort(f.depth, kind="stable")
    bounds = np.searchsorted(f.depth[order], np.arange(f.depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for level in reversed(levels[1:]):
        up[level] = _soft(below[level], ties[level])
        np.add.at(below, f.parent[level], up[level])
    flipped = ties[:, [0, 2, 1, 3]]
    for level in levels[1:]:
        over = f.parent[level]
        down[level] = _soft(below[over] + down[over] - up[level], flipped[level])
    return below, up, down


#: Elements whose text is never main text, nor that of anything inside them.
_FORM = frozenset("form fieldset legend label button select option search".split())


def in_form(page: Page) -> np.ndarray:
    out = np.zeros(len(page.parent), bool)
    for k, tag in enumerate(page.tag):
        out[k] = tag in _FORM or (page.parent[k] >= 0 and out[page.parent[k]])
    return out


@dataclass
class Model:
    weights: np.ndarray
    ties: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        unary = np.bincount(f.at, self.weights[f.slot], len(f.parent)) if len(f.at) else np.zeros(len(f.parent))
        below, _, down = messages(f, unary, self.ties[f.kind])
        return logistic(below + down)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        f = forest(pages)
        content = (self.marginals(f) > 0.5) & ~np.concatenate([np.zeros(0, bool), *map(in_form, pages)])
        return ["\n".join(t for node, t in p.blocks if content[b + node]) for p, b in zip(pages, f.first, strict=False)]


def fit(pages: list[Page], labels: list[np.ndarray], steps: int = 150) -> Model:
    """Gradients are differences of what the labels have and what the marginals of nodes and ties expect."""
    model = Model(np.zeros(SLOTS), np.zeros((len(KINDS) + 1, 4)))
    if not pages:
        return model
    f = forest(pages)
    y = np.concatenate(labels).astype(float)
    child = np.flatnonzero(f.parent >= 0)
    over = f.parent[child]
    pair = (2 * y[over] + y[child]).astype(int)
    adam = Adam([model.weights, model.ties], 0.1)
    n = len(pages)
    for _ in range(steps):
        unary = np.bincount(f.at, model.weights[f.slot], len(y))
        ties = model.ties[f.kind]
        below, up, down = messages(f, unary, ties)
        p = logistic(below + down)
        d_weights = np.bincount(f.slot, (p - y)[f.at], SLOTS) / n + 1e-3 * model.weights
        rest = below[over] + down[over] - up[child]
        joint = ties[child] + np.stack([0 * rest, below[child], rest, rest + below[child]], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        joint[np.arange(len(child)), pair] -= 1
        d_ties = np.zeros_like(model.ties)
        np.add.at(d_ties, f.kind[child], joint / n)
        adam.step([d_weights, d_ties + 1e-3 * model.ties])
    return model


# ---------------------------------------------------------------- labelled pages

#: Elements inside an article that are not its text.
_ASIDE = frozenset("nav aside footer form header button menu".split())

#: How pages of the common kinds name their parts, as opening tags.
CONTENT_PARTS = (
    '<article>', '<main>', '<div id="content">', '<div class="post-body">', '<div class="entry-content">',
    '<section class="article">', '<div class="article-text">', '<div role="main">', '<div class="story">', '<div>',
)
OTHER_PARTS = (
    '<nav>', '<header>', '<footer>', '<aside>', '<form>', '<div class="menu">', '<ul class="nav">', '<div id="header">',
    '<div id="footer">', '<div class="sidebar">', '<div class="ad">', '<div class="advert banner">',
    '<div class="cookie-notice">', '<div class="notice">', '<section id="comments">', '<div class="comments">',
    '<div class="comment">', '<ol class="comment-list">', '<div class="related">', '<div class="share social">',
    '<div class="newsletter subscribe">', '<div class="breadcrumb">', '<div role="navigation">', '<div class="promo">',
    '<div role="banner">', '<div class="popup modal">', '<div class="login">', '<div class="sponsored">',
)


def _end(part: str) -> str:
    return f"</{part[1:].split()[0].rstrip('>')}>"


#: Id of the elements that are content in a page laid out for learning; it is taken out before features are made.
_MARK = "goldmark"


def _marked(part: str) -> str:
    return part.replace(">", f' id="{_MARK}">', 1)


def _laid_out(rng: np.random.Generator, paragraphs: list[str]) -> str:
    """A page of these paragraphs in a structure drawn at random, its content marked."""
    pick = lambda x: x[rng.integers(len(x))]
    words = " ".join(paragraphs).split()

    def phrase(most: int) -> str:
        a = rng.integers(max(1, len(words)))
        return " ".join(words[a : a + 1 + rng.integers(most)])

    def other() -> str:
        part = pick((*OTHER_PARTS, "<div>", "<ul>"))
        if part in ("<div>", "<ul>"):  # without a name: a row of links or a few words
            links = [f'<a href="/x">{phrase(3)}</a>' for _ in range(2 + rng.integers(4))]
            if part == "<ul>":
                return f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>"
            return f"<div>{pick([' | '.join(links), phrase(4), '<br>'.join(links), '&copy; ' + phrase(6)])}</div>"
        inside = []
        for _ in range(1 + rng.integers(4)):
            link = f'<a href="/x">{phrase(3)}</a>'
            item = part.startswith(("<ul", "<ol"))
            inside.append(
                f"<li>{link}</li>" if item and rng.random() < 0.7
                else f"<li>{phrase(25)}</li>" if item
                else pick([link, f"<p>{phrase(30)}.</p>", phrase(12), f"<ul><li>{link}</li><li>{link}</li></ul>", f"<h3>{phrase(4)}</h3>", f"<div>{phrase(30)}.</div>", f"<button>{phrase(2)}</button>", f"<h1>{phrase(3)}</h1>"])
            )
        return part + "".join(inside) + _end(part)

    kept = [p for p in paragraphs if p][: 2 + rng.integers(12)]
    main = pick((*CONTENT_PARTS, "", "", "", "<td>", "<td>", "<div>", "<div>"))
    body = [f"<h1>{phrase(8)}</h1>"] if rng.random() < 0.8 else []
    for p in kept:
        forms = [f"<p>{p}</p>"] * 8 + [f"<p><b>{p}<br>", f"<blockquote>{p}</blockquote>", f"<h2>{phrase(6)}</h2>", f"<pre>{p}</pre>"]
        forms += [f"<div>{p}</div>", f"<div><p>{p}</p></div>", f"<section><h3>{phrase(5)}</h3><p>{p}</p></section>"]
        forms += [f"<ul><li>{phrase(12)}</li><li>{p}</li></ul>", f"<ol><li>{phrase(3)}</li><li>{phrase(20)}</li></ol>"]
        forms += [f"<table><tr><td>{phrase(3)}</td><td>{phrase(9)}</td></tr></table>", f"<figure><figcaption>{phrase(9)}</figcaption></figure>"]
        body.append(pick(forms))
    marked = [_marked(b) for b in body]
    for _ in range(rng.integers(3)):
        marked.insert(int(rng.integers(len(marked) + 1)), "</p>" + other())
    inner = "".join(marked) + "</p>"
    if main:
        inner = _marked(main) + inner + _end(main)
    if main == "<div>" and rng.random() < 0.5:
        inner = _marked("<div>") + inner + "</div>"
    wrap = pick(["", "", '<div class="page">', '<div id="wrapper">', "<div>"])
    before, after = ([other() for _ in range(1 + rng.integers(4))] for _ in range(2))
    if main == "<td>":
        cells = [f"<td>{x}</td>" for x in before[:1]] + [inner] + [f"<td>{x}</td>" for x in after[:1]]
        inner, before, after = f"<table><tr>{''.join(cells)}</tr></table>", before[1:], after[1:]
    page = wrap + "".join([*before, inner, *after]) + ("</div>" if wrap else "")
    return f"<html><body>{page}</body></html>"


#: Words in the names of parts that are not main text.
_OTHER_WORDS = frozenset(
    "nav menu header footer sidebar ad advert ads banner cookie notice comment comments related share social newsletter "
    "subscribe breadcrumb promo popup modal login sponsored navigation".split()
)
_OTHER_TAGS = frozenset("nav aside footer header menu dialog".split())
#: Characters from which text without a sentence's end counts as prose, and least prose of a page that is learned from.
_LONG_TEXT, _LEAST_PROSE = 80, 200


def guessed(page: Page) -> np.ndarray:
    """Labels of a page that does not say what its content is: what lies under the smallest element with most prose."""
    n = len(page.parent)
    other = in_form(page)
    last = [""] * n
    for node, text in page.blocks:
        last[node] = text
    prose = np.zeros(n)
    for k in range(n):
        up = page.parent[k]
        other[k] |= page.tag[k] in _OTHER_TAGS or not _OTHER_WORDS.isdisjoint(page.names[k]) or (up >= 0 and other[up])
        chars = page.chars[k]
        if chars and not other[k] and 2 * page.linked[k] < chars and (chars >= _LONG_TEXT or last[k][-1] in ".!?"):
            prose[k] = chars - page.linked[k]
    below = prose.copy()
    for k in range(n - 1, 0, -1):
        below[page.parent[k]] += below[k]
    inside = np.zeros(n, bool)
    if below[0] < _LEAST_PROSE:
        return inside
    top = 0
    for k in range(1, n):  # children follow their parents
        if page.parent[k] == top and below[k] >= 0.8 * below[0] and page.tag[k] not in ("p", "li"):
            top = k
    first = next((k for k in range(top, n) if prose[k]), top)
    for k in range(top, n):
        if other[k]:
            continue
        up = page.parent[k]
        under = k == top or (up >= top and inside[up]) or up == top
        linked = page.chars[k] and 2 * page.linked[k] >= page.chars[k]
        heading = page.tag[k] in ("h1", "h2", "h3", "h4")
        # the page itself is no content; in it, what holds prose or heads it is
        if top == 0 and up == 0:
            under = below[k] > 0 or (heading and k <= first)
        inside[k] = bool(under and not linked) and (k > 0)
    return inside


def _bare(page: Page, inside: np.ndarray, rng: np.random.Generator) -> Page:
    """The page without what names its content: containers have other tags and no names, other parts keep or lose theirs."""
    tag = list(page.tag)
    names = [list(x) for x in page.names]
    lost = rng.random() < 0.5
    for k in range(len(tag)):
        if inside[k]:
            names[k] = []
            if tag[k] in ("article", "main", "section"):
                tag[k] = str(rng.choice(["div", "section", "div"]))
        elif lost and rng.random() < 0.5:
            names[k] = []
    return Page(page.parent, page.depth, tag, names, page.chars, page.linked, page.blocks)


def labelled_pages(sources: list[str], seed: int = 19) -> tuple[list[Page], list[np.ndarray]]:
    """Each page as it is, without its content's names, and with its paragraphs in structures drawn anew."""
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for source in sources:
        page = parse(source)
        inside = np.zeros(len(page.parent), bool)
        for k, tag in enumerate(page.tag):
            up = page.parent[k]
            inside[k] = tag == "article" or (up >= 0 and inside[up] and tag not in _ASIDE)
        if not any(inside[node] for node, _ in page.blocks):
            inside = guessed(page)
        texts = [t for node, t in page.blocks if inside[node]]
        if texts:
            pages += [page, _bare(page, inside, rng)]
            labels += [inside, inside]
            escaped = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts]
            for _ in range(LAYOUTS):
                other = parse(_laid_out(rng, escaped))
                pages.append(other)
                labels.append(_take_marks(other, rng))
    return pages, labels


_INNER = frozenset("li p h3 tr td tbody figcaption".split())


def _take_marks(page: Page, rng: np.random.Generator) -> np.ndarray:
    """The nodes that carry the mark and what lies under them, which the marks of other parts end; drops names."""
    inside = np.zeros(len(page.parent), bool)
    plain = rng.random() < 0.2  # a page whose parts have no names
    for k, names in enumerate(page.names):
        up = page.parent[k]
        marked = _MARK in names
        # list items, cells and the like under a marked element carry no mark of their own
        inside[k] = marked or (up >= 0 and inside[up] and page.tag[k] in _INNER)
        own = [w for w in names if w != _MARK]
        page.names[k] = [] if plain or rng.random() < 0.1 else own
    return inside


def train_extraction(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Model:
    """The fitted model; pages are chosen by a hash of their id, which is ranked before any page is read."""
    chosen = pages.select("page_id").filter("page_id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64(F.lit(23), "page_id"), "page_id").limit(rows)
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    few = pages.select("page_id", source.alias("html")).filter(F.length("html") <= chars)
    few = few.join(F.broadcast(chosen), "page_id").orderBy("page_id", "html").select("html").toArrow()
    return fit(*labelled_pages(few.column("html").to_pylist()))


_OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """A row for each page: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for part in slices(column, 2 << 20):
                at = part.offset - column.offset
                texts = model.texts(part.to_pylist())
                own = [batch.column(c).slice(at, len(part)) for c in ("page_id", "url")]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.record_batch([*own, pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", source.alias("html")).mapInArrow(run, _OUT)
