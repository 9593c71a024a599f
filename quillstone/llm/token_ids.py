"""Byte-level BPE ids of whole texts by the tokenizers library.

The byte-level pre-tokeniser never joins what stands before a space to the space, if a non-space follows it. Such
texts are encoded word by word and the ids of words are kept; any other text, and every text of a vocabulary with
another normaliser, pre-tokeniser or model, is encoded whole by the library. A line's end before a non-space is a part
of its own, the last of its white space, so words end there too and a line's first word begins with it. New words are
cut by the pre-tokeniser's pattern, and the library's model encodes their new parts.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterable
from functools import lru_cache
from itertools import compress, islice, repeat
from operator import not_

import numpy as np
import regex

#: Kept words, and kept parts, for each Python worker.
KEEP = 600_000
#: Texts whose words are looked up together: few, so that their lists are small and stay in the cache.
BLOCK = 64
#: Kept runs of marks.
KEEP_MARKS = 20_000
PACK = [struct.Struct(f"<{n}I") for n in range(24)]
#: Fixed value: the published pattern of the pre-tokeniser of this family of vocabularies, white space as Unicode has it
#: (Python's own takes a few control characters for it).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: What may stand behind a word's letters as one part: no apostrophe, which may begin a part with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LOOSE = re.compile(r" (?:\s|\Z)")
_LOOSE_LINE, _LINE = re.compile(r"\n(?:\s|\Z)"), re.compile(r"\n(?=\S)")


def by_words(settings: dict) -> bool:
    """Whether a vocabulary file has the pre-tokeniser and the model that words are cut for here, and nothing else."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "unk_token"))
    tokens = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in settings.get("added_tokens") or [])
    return bool(plain and settings.get("normalizer") is None and model.get("type") == "BPE" and not odd and not tokens)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = by_words(json.load(file))
        if not self.by_words:
            return
        self.after: dict[str, bytes] = {}  # words after a space, and after a line's end with that
        self.first: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the vocabulary shows bytes as characters: printable ones as they are, the others from 256 on
        as_is = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in as_is]
        self.shown = {b: chr(b) for b in as_is} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.space = self.shown[32]
        self.marks: dict[str, bytes] = {}
        self.line = None if any("\n" in s for s in self.special) else self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, parts: Iterable[str]) -> list[bytes]:
        """Ids of parts that the pattern has cut, by the library's model alone: each byte is a character to it."""
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        out = []
        for p in parts:
            if not p.isascii() or not p.isprintable() or p.isspace():
                p = p.encode().decode("latin-1").translate(shown)
            elif p[0] == " ":
                p = self.space + p[1:]
            ids = [t.id for t in tokenize(p)]
            out.append(PACK[len(ids)].pack(*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _learn(self, kept: dict[str, bytes], words: set[str], lead: str) -> None:
        """Words of any kind: their parts by the pattern."""
        cut = {w: [lead + w] if any(s in w for s in self.special) else PATTERN.findall(lead + w) for w in words}
        if len(self.parts) > KEEP // 2:
            self.parts.clear()
        new = set().union(*cut.values()).difference(self.parts)
        odd = [p for p in new if any(s in p for s in self.special)]
        plain = list(new.difference(odd))
        self.parts.update(zip(plain, self._model(plain), strict=True))
        if odd:
            self.parts.update(zip(odd, self._whole(odd), strict=True))
        ids = self.parts
        kept.update((w, b"".join([ids[p] for p in parts])) for w, parts in cut.items())

    def _learn_after(self, words: set[str]) -> None:
        """Words after a space: letters, or letters and marks, are one part, or that and the marks'. Words after a
        line's end likewise, behind that."""
        kept = self.after
        letters, lines, marked, other = set(), set(), [], set()
        said = " ".join(words)
        if any(s in said for s in self.special):
            other = {w for w in words if any(s in w for s in self.special)}
            words = words - other
        for w in words:
            if w.isalpha():
                letters.add(w)
                continue
            base = w.rstrip(MARKS)
            if base.isalpha():
                marked.append((w, base))
                if base not in kept:
                    letters.add(base)
            elif base[:1] == "\n" and base[1:].isalpha():
                if len(base) < len(w):
                    marked.append((w, base))
                if base not in kept:
                    lines.add(base)
            else:
                other.add(w)
        kept.update(zip(letters, self._model([" " + w for w in letters]), strict=True))
        if lines:
            line = self.line
            kept.update(zip(lines, [line + ids for ids in self._model([w[1:] for w in lines])], strict=True))
        marks = self.marks
        if len(marks) > KEEP_MARKS:
            marks.clear()
        new = list({w[len(base) :] for w, base in marked}.difference(marks))
        marks.update(zip(new, self._model(new), strict=True))
        kept.update([(w, kept[base] + marks[w[len(base) :]]) for w, base in marked])
        for lead in (" ", ""):
            if some := {w for w in other if (w[0] != "\n") == bool(lead)}:
                self._learn(kept, some, lead)

    def forget(self) -> None:
        """Let go of the kept words: a worker that waits for its next task then holds little beside the vocabulary."""
        if self.by_words:
            for kept in (self.after, self.first, self.parts):
                kept.clear()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty and has none."""
        texts = [t or "" for t in texts]
        if not self.by_words:
            return self._whole(texts)
        return [ids for k in range(0, len(texts), BLOCK) for ids in self._block(texts[k : k + BLOCK])]

    def _block(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        loose = [k for k, t in enumerate(texts) if _LOOSE.search(t)]
        if loose:
            for k, ids in zip(loose, self._whole([texts[k] for k in loose]), strict=True):
                out[k] = ids
        skip = set(loose)
        if len(self.after) > KEEP:
            # words that are met often were met early: the older half stays
            self.after = dict(islice(self.after.items(), KEEP // 2))
        if len(self.first) > KEEP:
            self.first.clear()
        texts = {k: self._lines(t).split(" ") for k, t in enumerate(texts) if t and k not in skip}
        heads = {k: words.pop(0) for k, words in texts.items()}
        self._learn(self.first, set(heads.values()).difference(self.first), "")
        after = self.after.get
        found = {k: list(map(after, words, repeat(b""))) for k, words in texts.items()}
        lacking = {k: list(compress(range(len(words)), map(not_, found[k]))) for k, words in texts.items() if not all(found[k])}
        if lacking:
            self._learn_after({texts[k][i] for k, new in lacking.items() for i in new})
            kept = self.after
            for k, new in lacking.items():
                words, ids = texts[k], found[k]
                for i in new:
                    ids[i] = kept[words[i]]
        for k, ids in found.items():
            out[k] = self.first[heads[k]] + b"".join(ids)
        return out

    def _lines(self, text: str) -> str:
        """``text`` with a space more before each line's end that begins a word. White space before a special token is
        one part, so texts with one stay as they are."""
        if self.line is None or "\n" not in text or any(s in text for s in self.special):
            return text
        return _LINE.sub(" \n", text) if _LOOSE_LINE.search(text) else text.replace("\n", " \n")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    made = Encoder(path)
    gc.freeze()  # what a worker has loaded stays; the collector need not walk it again and again
    return made
