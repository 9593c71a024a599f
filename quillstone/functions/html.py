"""HTML pages as titles, markdown, texts and links, by the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

_BLOCKS = {"p", "div", "section", "article", "header", "main", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "dl", "dt", "dd", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
_SKIP = {"script", "style", "noscript", "template", "svg"}
_VOID = {"br", "hr", "img", "meta", "link", "input"}


@dataclass
class Page:
    title: str = ""
    markdown: str = ""
    headings: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)


class _Reader(HTMLParser):
    """One pass: a list of finished blocks and the block at hand."""

    def __init__(self, base: str, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.base, self.drop = base, drop
        self.out: list[str] = []
        self.now: list[str] = []
        self.prefix = ""
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.href: list[str | None] = []
        self.skipping = 0
        self.heading = 0
        self.headings: list[tuple[int, str]] = []
        self.links: list[str] = []
        self.doc_title: list[str] | None = None
        self.page_title = ""

    def _flush(self) -> None:
        text = re.sub(r"[ \t\n\r\f ]+", " ", "".join(self.now)).strip()
        self.now = []
        if not text:
            return
        if self.heading:
            self.headings.append((self.heading, text))
            text = f"{'#' * self.heading} {text}"
        if self.prefix:
            text, self.prefix = self.prefix + text, ""
            if self.out and re.match(r"\s*([*]|\d+\.) ", self.out[-1].split("\n")[-1]) and re.match(r"\s*([*]|\d+\.) ", text):
                self.out[-1] += "\n" + text
                return
        self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP or (self.skipping and tag not in _VOID) or tag in self.drop:
            if tag not in _VOID and (tag in _SKIP or tag in self.drop or self.skipping):
                self.skipping += 1
            return
        if tag == "title":
            self.doc_title = []
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = []
            if not self.rows:
                self.rows.append([])
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag == "table":
            self._flush()
            self.rows = []
        elif tag == "a":
            href = dict(attrs).get("href")
            href = urljoin(self.base, href) if href else None
            if href:
                self.links.append(href)
            self.href.append(href)
            if href:
                self._add("[")
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag in _BLOCKS:
            if self.cell is None:
                self._flush()
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li":
                depth = max(0, len(self.lists) - 1)
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.prefix = "  " * depth + ("* " if kind[0] == "ul" else f"{kind[1]}. ")
            elif tag[0] == "h" and tag[1:].isdigit():
                self.heading = int(tag[1])

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag in _SKIP or tag in self.drop or tag not in _VOID:
                self.skipping -= 1
            return
        if tag == "title" and self.doc_title is not None:
            self.page_title = "".join(self.doc_title).strip()
            self.doc_title = None
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            if rows:
                wide = max(map(len, rows))
                lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
                lines.insert(1, "| " + "--- | " * wide)
                self.out.append("\n".join(lines))
            self.rows = None
        elif tag == "a" and self.href:
            href = self.href.pop()
            if href:
                self._add(f"]({href})")
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag in _BLOCKS and self.cell is None:
            self._flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            if tag[0] == "h" and tag[1:].isdigit():
                self.heading = 0

    def _add(self, text: str) -> None:
        (self.now if self.cell is None else self.cell).append(text)

    def handle_data(self, data: str) -> None:
        if self.doc_title is not None:
            self.doc_title.append(data)
        elif not self.skipping:
            self._add(data)


def parse(html: str | None, base: str = "", drop: tuple[str, ...] = ("nav", "footer", "aside")) -> Page:
    """A page's title (its h1s, else its own title), markdown and links; parts named in ``drop`` are left out."""
    reader = _Reader(base or "", frozenset(drop))
    reader.feed(html or "")
    reader.close()
    reader.heading = 0
    reader._flush()
    tops = [t for level, t in reader.headings if level == 1]
    return Page(";".join(tops) or reader.page_title, tidy("\n\n".join(reader.out)), [t for _, t in reader.headings], reader.links)


def tidy(md: str) -> str:
    """Empty emphasis and more than one blank line taken out, non-breaking spaces made plain."""
    md = md.replace(" ", " ").replace("\r", "")
    md = re.sub(r"\*\*\s*\*\*", "", md)
    return re.sub(r"\n{3,}", "\n\n", md).strip()


def one_title(page: Page) -> str:
    """The title of a page that must have one h1."""
    if not page.headings or ";" in page.title:
        raise ValueError("expected one h1")
    return page.title


def text_of(html: str | None) -> str:
    """All text of a page, a line for each stretch."""

    class Data(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.parts: list[str] = []

        def handle_data(self, data: str) -> None:
            self.parts.append(data)

    reader = Data()
    reader.feed(html or "")
    reader.close()
    return "\n".join(reader.parts)


def without_anchors(md: str) -> str:
    """In-page links to collapsed parts and panes replaced by their texts."""
    return re.sub(r"\[([^\]]*)\]\(#(?:collapse|pane)-[^)]*\)", r"\1", md)


def allowed(url: str, allow: list[str], deny: list[str]) -> bool:
    """Whether a crawl rule takes a link."""
    path = urlsplit(url).path
    return any(re.search(a, path) for a in allow) and not any(re.search(d, path) for d in deny)
