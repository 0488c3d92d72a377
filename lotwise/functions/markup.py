"""Markup as people publish it: tolerant XML events, HTML and XML as text, anchors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<!.*?(?:>|$)|<(/?)([A-Za-z_][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>/]+))")
_SPACE = re.compile(r"[\s\x85]+")
_HYPHEN = re.compile(r"([^\W\d_])-[ \t]*[\r\n]+[ \t]*([^\W\d_])")
# Elements whose content is no text, and elements that end a line.
_SILENT = ("script", "style", "head", "noscript", "svg")
_BLOCK = (
    "p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table",
    "section", "article", "header", "footer", "blockquote", "pre", "option",
)


def clean(text: str | None) -> str:
    """Entities resolved once more, divided words joined, white space collapsed."""
    if not text:
        return ""
    text = html.unescape(text).replace("­", "")
    return _SPACE.sub(" ", _HYPHEN.sub(r"\1\2", text)).strip()


def local(name: str) -> str:
    return name.rpartition(":")[2]


@dataclass
class Node:
    name: str
    attributes: dict[str, str]
    text: str = ""  # before the first child or end
    children: list[Node] = field(default_factory=list)

    def all(self, *path: str) -> list[Node]:
        found = [self]
        for step in path:
            found = [c for n in found for c in n.children if c.name == step]
        return found

    def last(self, *path: str) -> str:
        """The text of the last node of a path, as repeated scalars overwrite one another."""
        found = self.all(*path)
        return clean(found[-1].text) if found else ""


class MarkupError(ValueError):
    """Text that ends within an element, or holds none."""


def events(text: str) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """("open", name, attributes), ("text", "", text) and ("close", name, {}) of lenient XML.

    Names are local, HTML entities are known, an end tag closes everything up to the element it
    names, and end tags of elements that aren't open are passed over.
    """
    stack: list[str] = []
    at = 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            yield "text", "", html.unescape(text[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            yield "text", "", m.group(1)
        if not m.group(3):
            continue
        name = local(m.group(3))
        if m.group(2):
            if name in stack:
                while True:
                    top = stack.pop()
                    yield "close", top, {}
                    if top == name:
                        break
            continue
        attributes = {local(a): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(m.group(4))}
        yield "open", name, attributes
        if m.group(5):
            yield "close", name, {}
        else:
            stack.append(name)
    if stack:
        raise MarkupError(f"the text ends within {stack[-1]}")


def tree(text: str) -> Node:
    """The root element with its descendants."""
    top = Node("", {})
    stack = [top]
    for kind, name, value in events(text):
        if kind == "open":
            node = Node(name, value)
            stack[-1].children.append(node)
            stack.append(node)
        elif kind == "close":
            stack.pop()
        elif not stack[-1].children:
            stack[-1].text += value
    if not top.children:
        raise MarkupError("no element")
    return top.children[0]


def strip_tags(text: str) -> str:
    """Without tags and comments; a bare < takes what follows up to the next > with it, and stays if there is none."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = re.sub(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", lambda m: m.group(1).replace("<", "&lt;").replace(">", "&gt;"), text, flags=re.S)
    return re.sub(r"<[^>]*>", "", text)


def _collapse(text: str) -> str:
    """One blank for white space within lines, and no blank lines."""
    lines = [_SPACE.sub(" ", line).strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return "\n".join(line for line in lines if line)


def html_to_text(page: str) -> str:
    """A page as its reader sees it: a line for each block, without scripts and styles."""
    for name in _SILENT:
        page = re.sub(rf"<{name}(?=[\s>/]).*?(?:</{name}[^>]*>|\Z)", "", page, flags=re.S | re.I)
    page = re.sub(rf"(</?(?:{'|'.join(_BLOCK)})(?=[\s>/]))", r"\n\1", page, flags=re.I)
    return _collapse(html.unescape(strip_tags(page)))


def xml_to_text(text: str) -> str:
    return _collapse(html.unescape(strip_tags(text)))


class _Links(HTMLParser):
    """Collects the address of each a element that has one, and where its content begins and ends."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.begins = [0, *(i + 1 for i, c in enumerate(page) if c == "\n")]
        self.href: str | None = None
        self.start = 0
        self.found: list[tuple[str, int, int]] = []
        self.feed(page)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.begins[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and self.href is None:  # a link within a link is text of the outer one
            self.href = next((v or "" for k, v in attrs if k == "href"), None)
            self.start = self._here() + len(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.found.append((self.href, self.start, self._here()))
            self.href = None


def anchors(page: str) -> list[tuple[str, str]]:
    """(address, label) of each link of a page, in order; labels are text of at most 160 characters."""
    out = []
    for href, begin, end in _Links(page).found:
        label = " ".join(html_to_text(page[begin:end]).split())
        out.append((href.strip(), label if len(label) <= 160 else label[:160].rstrip() + "…"))
    return out


def site(host: str) -> str:
    return ".".join(host.split(".")[-3:])


def candidates(page_url: str, page: str, most: int = 500) -> list[tuple[str, str]]:
    """Links of a page that may be followed on its own site, each once, the first label kept."""
    here = (urlsplit(page_url).hostname or "").lower()
    out: dict[str, str] = {}
    for href, label in anchors(page):
        low = href.strip().lower()
        if not low or low.startswith(("#", "javascript:", "mailto:", "tel:", "data:")):
            continue
        try:
            url = urldefrag(urljoin(page_url, href.strip()))[0]
            there = (urlsplit(url).hostname or "").lower()
        except ValueError:
            continue
        if not url.lower().startswith(("http://", "https://")) or not (there == here or site(there) == site(here)):
            continue
        out.setdefault(url, label)
    return list(out.items())[:most]
