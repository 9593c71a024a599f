"""Markdown as a tree of blocks, chunks of bounded length, and citable subsections.

Plain functions of one document, for use inside Arrow batches; nothing here knows Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"^(\s*)([*+-]|\d+[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^a-z\s])")
_LINK = re.compile(r"\[([^\]]+)\]\([^\)]+\)")


@dataclass
class Block:
    kind: str  # heading, paragraph, list, item, table, row, code, quote, rule
    text: str
    level: int = 0
    children: list[Block] = field(default_factory=list)
    intro: str = ""

    def render(self) -> str:
        if self.kind in ("list", "table"):
            return "\n".join(c.render() for c in self.children)
        return f"{'#' * self.level} {self.text}" if self.kind == "heading" else self.text


def blocks(md: str) -> list[Block]:
    """The blocks of a document in order."""
    out: list[Block] = []
    lines = md.replace("\r\n", "\n").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        if m := _HEADING.match(line):
            out.append(Block("heading", m[2], len(m[1])))
            k += 1
        elif line.lstrip().startswith("```"):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].lstrip().startswith("```")), len(lines) - 1)
            out.append(Block("code", "\n".join(lines[k : end + 1])))
            k = end + 1
        elif _RULE.match(line) and not _ITEM.match(line):
            out.append(Block("rule", line.strip()))
            k += 1
        elif line.lstrip().startswith("|"):
            rows = []
            while k < len(lines) and lines[k].lstrip().startswith("|"):
                rows.append(Block("row", lines[k].strip()))
                k += 1
            out.append(Block("table", "", children=rows))
        elif _ITEM.match(line):
            items: list[list[str]] = []
            base = len(_ITEM.match(line)[1])
            while k < len(lines):
                m = _ITEM.match(lines[k])
                if m and len(m[1]) <= base:
                    items.append([lines[k]])
                elif lines[k].strip() and (m or lines[k][:1].isspace() or (items and lines[k - 1].strip())):
                    if _HEADING.match(lines[k]) or lines[k].startswith("|"):
                        break
                    items[-1].append(lines[k])
                elif not lines[k].strip() and k + 1 < len(lines) and (lines[k + 1][:1].isspace() and lines[k + 1].strip() or _ITEM.match(lines[k + 1])):
                    items[-1].append("")
                else:
                    break
                k += 1
            out.append(Block("list", "", children=[Block("item", "\n".join(i).rstrip()) for i in items]))
        elif line.lstrip().startswith(">"):
            quoted = []
            while k < len(lines) and lines[k].strip():
                quoted.append(lines[k])
                k += 1
            out.append(Block("quote", "\n".join(quoted)))
        else:
            said = []
            while k < len(lines) and lines[k].strip() and not _HEADING.match(lines[k]) and not lines[k].lstrip().startswith(("|", "```")) and not (said and _ITEM.match(lines[k])):
                said.append(lines[k].strip())
                k += 1
            out.append(Block("paragraph", "\n".join(said)))
    return out


def normalised(md: str) -> str:
    """A document parsed and rendered: one blank line between blocks."""
    return "\n\n".join(b.render() for b in blocks(md))


def plain_links(md: str) -> str:
    return _LINK.sub(r"\1", md)


@dataclass(frozen=True)
class Placed:
    """A block below the headings that stand over it."""

    block: Block
    headings: tuple[str, ...]


def placed(md: str) -> list[Placed]:
    """Blocks with their breadcrumbs; lists and tables know the sentence that introduces them."""
    stack: list[tuple[int, str]] = []
    out: list[Placed] = []
    before: Block | None = None
    for b in blocks(md):
        if b.kind == "heading":
            while stack and stack[-1][0] >= b.level:
                stack.pop()
            out.append(Placed(b, tuple(t for _, t in stack)))
            stack.append((b.level, plain_links(b.text)))
        else:
            if b.kind in ("list", "table") and before is not None and before.kind in ("paragraph", "heading"):
                b.intro = before.text.split("\n")[-1].split(". ")[-1]
            out.append(Placed(b, tuple(t for _, t in stack)))
        before = b
    return out


def tree_statistics(md: str) -> dict[str, int]:
    """How many blocks there are of each kind, items and rows included."""
    counts: dict[str, int] = {}
    for b in blocks(md):
        for x in (b, *b.children):
            counts[x.kind] = counts.get(x.kind, 0) + 1
    return counts


def by_headings(md: str) -> list[tuple[tuple[str, ...], str]]:
    """(headings, text) of the stretches between headings that have text; links are stripped from headings."""
    out: list[tuple[tuple[str, ...], list[str]]] = []
    for p in placed(md):
        if p.block.kind == "heading":
            continue
        if not out or out[-1][0] != p.headings:
            out.append((p.headings, []))
        out[-1][1].append(p.block.render())
    return [(h, "\n\n".join(t)) for h, t in out]


# -- pieces of bounded length -------------------------------------------------------------------------------------


def word_count(text: str) -> int:
    return len(text.split())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def join_up_to(parts: list[str], limit: int, sep: str) -> list[str]:
    """Parts joined as long as the result stays within ``limit`` characters; a longer part is cut at marks, then hard."""
    out: list[str] = []
    for part in parts:
        if len(part) > limit:
            smaller = re.split(r"(?<=[,;\n])", part)
            smaller = smaller if len(smaller) > 1 else [part[i : i + limit] for i in range(0, len(part), limit)]
            out += join_up_to(smaller, limit, "")
        elif out and len(out[-1]) + len(sep) + len(part) <= limit:
            out[-1] += sep + part
        else:
            out.append(part)
    return out


def split_paragraph(text: str, limit: int) -> list[str]:
    """By sentences, or by blank lines where there is one sentence."""
    parts = sentences(text)
    return join_up_to(parts, limit, " ") if len(parts) > 1 else join_up_to(text.split("\n\n"), limit, "\n\n")


def split_list(text: str, limit: int, intro: bool = True) -> list[str]:
    """Pieces of a list, each with the introducing line."""
    lines = text.split("\n")
    head = lines.pop(0) if intro and lines else ""
    room = limit - len(head) - 1 if head else limit
    return [f"{head}\n{piece}" if head else piece for piece in join_up_to(lines, max(1, room), "\n")]


@dataclass(frozen=True)
class ChunkingConfig:
    """The bound of a chunk, in whatever ``length`` counts, and what counts as full."""

    most: int
    length: Callable[[str], int] = word_count
    full: float = 0.65


@dataclass(frozen=True)
class Chunk:
    headings: tuple[str, ...]
    text: str
    index: int
    length: int

    def to_embed(self) -> str:
        """Headings, a blank line, and the text without links."""
        context = "\n".join(f"{'#' * (i + 1)} {h}" for i, h in enumerate(self.headings) if h)
        return f"{context}\n\n{plain_links(self.text)}".strip() if context else plain_links(self.text)


def _pieces(p: Placed, config: ChunkingConfig) -> Iterator[str]:
    """A block in pieces that fit: rows and items with their introduction (in brackets from the second piece on),
    paragraphs by sentences, and words in the end."""
    text = p.block.render()
    if config.length(text) <= config.most:
        yield text
        return
    if p.block.children:
        intro, made = p.block.intro, 0
        head = ""
        part: list[str] = []
        room = lambda x: config.length("\n".join([y for y in (head, *part, x) if y])) <= config.most
        for child in p.block.children:
            line = child.render()
            if part and not room(line):
                yield "\n".join([y for y in (head, *part) if y])
                made, part = made + 1, []
                head = f"({intro})" if intro and config.length(f"({intro})") < config.most // 2 else ""
            if not room(line):
                for words in _by_words(line, config):
                    yield words
                continue
            part.append(line)
        if part:
            yield "\n".join([y for y in (head, *part) if y])
        return
    part_ = ""
    for s in sentences(text):
        both = f"{part_} {s}" if part_ else s
        if config.length(both) <= config.most:
            part_ = both
            continue
        if part_:
            yield part_
        part_ = ""
        if config.length(s) <= config.most:
            part_ = s
        else:
            yield from _by_words(s, config)
    if part_:
        yield part_


def _by_words(text: str, config: ChunkingConfig) -> Iterator[str]:
    part: list[str] = []
    for w in text.split():
        if part and config.length(" ".join([*part, w])) > config.most:
            yield " ".join(part)
            part = []
        part.append(w)
    if part:
        yield " ".join(part)


def chunks(md: str, config: ChunkingConfig) -> list[Chunk]:
    """Chunks of at most ``config.most``, in order, that hold every block.

    Blocks under the same top heading share a chunk while they fit; a heading never ends a chunk, and a paragraph that
    introduces a list or table stays with it if both fit. A chunk's headings are those that all its blocks share.
    """
    out: list[Chunk] = []
    held: list[tuple[tuple[str, ...], str]] = []

    def flush() -> None:
        if held:
            text = "\n\n".join(t for _, t in held)
            shared = held[0][0]
            for h, _ in held[1:]:
                shared = shared[: next((i for i, (a, b) in enumerate(zip(shared, h, strict=False)) if a != b), min(len(shared), len(h)))]
            out.append(Chunk(shared, text, len(out), config.length(text)))
            held.clear()

    fits = lambda *more: config.length("\n\n".join([*(t for _, t in held), *more])) <= config.most
    found = placed(md)
    k = 0
    while k < len(found):
        group = [found[k]]
        while k + 1 < len(found) and (group[-1].block.kind == "heading" or (group[-1].block.kind == "paragraph" and found[k + 1].block.intro)):
            k += 1
            group.append(found[k])
        k += 1
        texts = [(p.headings, p.block.render()) for p in group]
        new_top = held and (texts[0][0][:1] != held[0][0][:1]) and config.length("\n\n".join(t for _, t in held)) > config.full * config.most
        if held and (new_top or not fits(*(t for _, t in texts))):
            flush()
        if fits(*(t for _, t in texts)):
            held += texts
            continue
        for p in group:
            for piece in _pieces(p, config):
                if held and not fits(piece):
                    flush()
                held.append((p.headings, piece))
    flush()
    return out


def subsections(md: str, base: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(headings, text) of citable spans: blocks, a paragraph and the list after it being one."""
    out: list[tuple[tuple[str, ...], str]] = []
    found = [p for p in placed(md)]
    k = 0
    while k < len(found):
        p = found[k]
        k += 1
        if p.block.kind == "heading":
            continue
        text = p.block.render().strip()
        if p.block.kind == "paragraph" and k < len(found) and found[k].block.kind == "list":
            text = f"{text}\n{found[k].block.render().strip()}"
            k += 1
        out.append((base + p.headings, text))
    return out


def basic_subsections(md: str, base: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(headings, text) of the stretches between blank lines; a heading stands over all up to one of its level or above."""
    over: dict[int, str] = {}
    out: list[tuple[tuple[str, ...], str]] = []
    for part in md.split("\n\n"):
        if not part:
            continue
        if part.startswith("#"):
            level = len(part) - len(part.lstrip("#"))
            text = part[level:]
            if not text.startswith(" "):
                raise ValueError(f"not a heading: {part}")
            over = {k: v for k, v in over.items() if k < level} | {level: text[1:]}
        else:
            out.append(((*base, *(over[k] for k in sorted(over) if over[k])), part))
    return out


def subsections_or_basic(md: str, base: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """Citable spans by the tree, or between blank lines where the tree can't be had; other errors are errors."""
    try:
        return subsections(md, base)
    except RuntimeError:
        return basic_subsections(md, base)
