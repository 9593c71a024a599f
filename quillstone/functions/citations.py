"""Citations in generated answers: known ones kept, moved behind punctuation, runs merged, numbers made consecutive."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The form of a citation.
CITATION = re.compile(r"\((citation-\d+)\)")
_BEFORE_MARK = re.compile(r" *((?: *\(citation-\d+\))+) *([.?!])")
_RUN = re.compile(r"(?: ?\(citation-\d+\)){2,}")


@dataclass(frozen=True)
class Cited:
    id: str
    chunk_id: str
    index: int
    text: str


def known_only(answer: str, known: set[str]) -> str:
    return CITATION.sub(lambda m: m[0] if m[1] in known else "", answer)


def behind_marks(answer: str) -> str:
    return _BEFORE_MARK.sub(r"\2 \1", answer).strip()


def _runs(cited: list[Cited]) -> list[list[Cited]]:
    out: list[list[Cited]] = []
    for c in cited:
        follows = out and out[-1][-1].chunk_id == c.chunk_id and out[-1][-1].index + 1 == c.index
        out[-1].append(c) if follows else out.append([c])
    return out


def merged(answer: str, known: dict[str, Cited]) -> tuple[str, dict[str, Cited]]:
    """Neighbouring citations of subsections that follow each other become one, named by their padded numbers."""
    found = dict(known)

    def one(m: re.Match) -> str:
        parts = []
        for run in _runs([known[i] for i in CITATION.findall(m[0])]):
            name = run[0].id if len(run) == 1 else "citation-" + "".join(c.id.split("-", 1)[1].zfill(4) for c in run)
            if name not in found:
                found[name] = Cited(name, run[0].chunk_id, run[0].index, "\n\n".join(c.text for c in run))
            parts.append(f" ({name})")
        return "".join(parts)

    return _RUN.sub(one, answer), found


def renumbered(answer: str, known: dict[str, Cited]) -> tuple[str, list[Cited]]:
    """Citations numbered from 1 as they first appear."""
    order = [i for i in dict.fromkeys(CITATION.findall(answer)) if i in known]
    number = {i: f"citation-{n}" for n, i in enumerate(order, 1)}
    text = CITATION.sub(lambda m: f"({number[m[1]]})" if m[1] in number else m[0], answer)
    return text, [Cited(str(n), known[i].chunk_id, known[i].index, known[i].text) for n, i in enumerate(order, 1)]


def simplified(answer: str, subsections: list[Cited]) -> tuple[str, list[Cited]]:
    """All of it in turn: the answer, and the subsections that it cites, from 1."""
    known = {s.id: s for s in subsections}
    text, found = merged(behind_marks(known_only(answer, set(known))), known)
    return renumbered(text, found)


def prompt_context(subsections: list[tuple[str, str, list[str], str]]) -> str:
    """(id, document, headings, text) of each as the context of a prompt."""
    parts = []
    for name, document, headings, text in subsections:
        lines = [f"Citation: {name}", f"Document name: {document}", *([f"Headings: {' > '.join(headings)}"] if headings else []), f"Content: {text}"]
        parts.append("\n".join(lines))
    return "\n\n".join(parts)
