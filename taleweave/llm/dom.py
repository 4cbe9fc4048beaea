"""HTML as block elements and runs of text: what the extraction model looks at."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Names of HTML elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video title textarea datalist".split())
_RAW = frozenset("script style noscript iframe title textarea xmp".split())
#: An opening tag of the key ends an open element of the values, up to the nearest of those in _SCOPE.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl menu table tbody thead tfoot select body html div article section main td th".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


@dataclass
class Page:
    """Block elements in page order, the first being the page itself, and runs of text that make its blocks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["body"])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    #: (node, text) of each block, in order
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _words(rest: str) -> list[str]:
    found = []
    for _, value in _NAMES.findall(rest):
        found += [w.lower() for w in _PARTS.findall(value)]
    return found


def parse(source: str) -> Page:
    """Elements are closed as browsers do it, in so far as text and its place in the tree depend on it."""
    page = Page()
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and the node their text belongs to
    held: list[str] = []
    node, silent, links, at = 0, "", 0, 0

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                page.blocks.append((node, text))
                page.chars[node] += len(text)

    def text(a: int, b: int) -> None:
        if b > a:
            held.append(source[a:b])
            if links:
                page.linked[node] += b - a

    while True:
        m = _TOKEN.search(source, at)
        text(at, m.start() if m else len(source))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                held.append(" ")
            elif name in BLOCKS:
                if name in ("body", "html"):
                    continue
                end_block()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                node = stack[-1][1]
            continue
        if name in SILENT:
            if not m["rest"].rstrip().endswith("/") or name in _RAW:
                at = _skip_element(source, at, name)
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            links = 1 if "href" in m["rest"].lower() else links
        elif name in BLOCKS:
            end_block()
            links = 0
            if name in ("html", "body"):
                page.names[0] += _words(m["rest"])
                continue
            if name == "hr":
                continue
            if stack[-1][0] == "p":  # a paragraph ends where another block begins
                stack.pop()
            elif name in _IMPLIED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _IMPLIED[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in _SCOPE:
                        break
            parent = stack[-1][1]
            node = len(page.parent)
            page.parent.append(parent)
            page.depth.append(page.depth[parent] + 1)
            page.tag.append(name)
            page.names.append(_words(m["rest"]))
            page.chars.append(0)
            page.linked.append(0)
            stack.append((name, node))
    end_block()
    return page


_ENDS: dict[str, re.Pattern] = {}


def _skip_element(source: str, at: int, name: str) -> int:
    """Past the end of an element: at its first closing tag, or for those that nest, at the matching one."""
    if name not in _ENDS:
        _ENDS[name] = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>?", re.I)
    open_ = 1
    for m in _ENDS[name].finditer(source, at):
        open_ += -1 if m[1] else (0 if name in _RAW else 1)
        if open_ == 0:
            return m.end()
    return len(source)
