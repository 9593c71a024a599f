"""Texts of a PDF in order: lists joined, sentences joined over pages, texts grouped by headings, styles and links."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

ITEM, NARRATIVE, TITLE = "ListItem", "NarrativeText", "Title"


@dataclass(frozen=True)
class Text:
    text: str
    type: str
    headings: tuple[str, ...] = ()
    page: int | None = None
    links: tuple[tuple[int, str, str], ...] = field(default=())


def _continues(before: Text, after: Text) -> bool:
    """A sentence that goes on: lower case, on the next page, under the same headings."""
    return bool(after.text.strip()) and after.headings == before.headings and before.page is not None and after.page == before.page + 1 and after.text.strip()[0].islower()


def joined(texts: list[Text]) -> list[Text]:
    """Neighbours that are one text: items join what stands before them, titles what follows, sentences over pages."""
    out: list[Text] = []
    for t in texts:
        last = out[-1] if out else None
        if last and last.headings == t.headings and t.type == ITEM:
            out[-1] = replace(last, text=f"{last.text}\n{t.text}")
        elif last and t.type == NARRATIVE and _continues(last, t):
            out[-1] = replace(last, text=f"{last.text} {t.text}")
        elif last and last.headings == t.headings and last.type == TITLE:
            out[-1] = replace(t, text=f"{last.text}\n\n{t.text}", page=last.page)
        else:
            out.append(t)
    return out


def grouped(texts: list[Text]) -> list[Text]:
    """One text for each sequence of headings, in order of its first; narrative if any part is."""
    groups: dict[tuple[str, ...], list[Text]] = {}
    for t in joined(texts):
        groups.setdefault(t.headings, []).append(t)
    return [
        Text("\n\n".join(t.text for t in g), NARRATIVE if any(t.type == NARRATIVE for t in g) else g[0].type, h, g[0].page, g[0].links)
        for h, g in groups.items()
    ]


def with_bold(text: str, styles: list[str]) -> tuple[str, list[str]]:
    """Each style's first place made bold; the styles that have none."""
    left = []
    for s in styles:
        at = text.find(s)
        if at < 0:
            left.append(s)
        else:
            text = f"{text[:at]}**{s}**{text[at + len(s):]}"
    return text, left


def with_links(text: str, links: list[tuple[int, str, str]]) -> str:
    """Links written as markdown, each at its first place from its start on."""
    moved = 0
    for start, label, url in sorted(links):
        at = text.find(label, start + moved)
        if at >= 0:
            md = f"[{label}]({url})"
            text = text[:at] + md + text[at + len(label) :]
            moved += len(md) - len(label)
    return text


def with_bullets(texts: list[Text]) -> list[Text]:
    """Items as list lines; bullets within an item as a list below it."""
    out = []
    for t in texts:
        if t.type == ITEM:
            first, *rest = [p.strip() for p in t.text.split("•") if p.strip()] or [""]
            t = replace(t, text="\n".join([f"- {first}", *(f"    - {p}" for p in rest)]))
        out.append(t)
    return out
