"""SentencePiece encoding and decoding as shortest paths of composed weighted transducers.

Three transducers are compiled from a model file: the normaliser (space to the mark U+2581, dummy prefix; character
maps other than identity are refused), the lexicon (a trie of all pieces, with an arc of byte pieces for every
character that is no piece), and an order acceptor over pairs of neighbouring pieces. An input is composed with them
position by position; the encoding is the path of least weight in the tropical semiring.

* Unigram models: lexicon arcs weigh minus the piece's score, the order acceptor takes every pair. The bytes of a
  character that is no piece weigh ten more than the worst piece, as the library has it.
* BPE models: merging is not a sum of scores. A sequence of pieces is what merging yields exactly if each two
  neighbours are what merging yields for their joined text, so lexicon arcs weigh 0 and the acceptor holds exactly
  those pairs (found by merging the short joined text, then remembered). One path is left.

No piece crosses from other text to a mark or a line break, or between two characters that are neighbours in no
piece, so paths are found for such units and their parts, and kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Kept units for each Python worker, and pairs of pieces.
KEEP_UNITS, KEEP_PAIRS = 900_000, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class Transducer:
    """The compiled normaliser, lexicon and order acceptor of one model."""

    def __init__(self, data: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normaliser.get(2, b"") or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only identity normalisers that escape spaces and keep extra ones are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.bytes = {}
        self.ids, self.scores, self.surface = {}, {}, [b""] * len(pieces)
        for i, (text, score, kind) in enumerate(pieces):
            if kind in (NORMAL, USER_DEFINED):
                self.ids[text] = i
                self.scores[text] = score
                self.surface[i] = text.replace(MARK, " ").encode()
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
                self.surface[i] = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.surface[i] = " ⁇ ".encode()
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.text = [p[0] for p in pieces]
        self.unknown = 0.0 if self.kind == BPE else 10.0 - min((score for _, score, kind in pieces if kind == NORMAL), default=0.0)
        if any(MARK in t.lstrip(MARK) or ("\n" in t) for t in self.ids):
            raise ValueError("pieces that cross words are not supported")
        self.trie = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if self.kind == UNIGRAM or self._merged(text) == [text]:
                self.trie.add_word(text, (i, len(text), -self.scores[text] if self.kind == UNIGRAM else 0.0))
        self.trie.make_automaton()
        #: Neighbouring characters within pieces: no path crosses between any others.
        self.within = {xy for text in self.ids for xy in zip(text, text[1:], strict=False)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.line = struct.pack("<I", self.bytes[10])

    def _merged(self, text: str) -> list[str]:
        """What merging the best pair again and again yields; the definition that the order acceptor is compiled from."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores.get(a + b), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _ordered(self, a: int, b: int) -> bool:
        """Whether the order acceptor has an arc from piece ``a`` to piece ``b``."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[a, b] = self._merged(x + y) == [x, y]
        return known

    def _paths(self, units: list[str]) -> list[bytes]:
        """The least path of each unit, as little-endian 32-bit ids."""
        joined = "\n".join(units)  # no unit holds a line break, no piece does
        found: dict[int, list] = {}
        for end, match in self.trie.iter(joined):
            found.setdefault(end, []).append(match)
        out, at = [], 0
        bpe, ordered = self.kind == BPE, self._ordered
        for unit in units:
            n = len(unit)
            weight: list = [None] * (n + 1)
            last: list = [None] * (n + 1)
            weight[0] = 0.0
            for e in range(n):
                best = None
                for i, length, w in found.get(at + e, ()):
                    s = e + 1 - length
                    if s < 0 or weight[s] is None or (best is not None and weight[s] + w >= best):
                        continue
                    if bpe and s and type(last[s][1]) is int and not ordered(last[s][1], i):
                        continue
                    best = weight[s] + w
                    last[e + 1] = (s, i)
                if weight[e] is not None and unit[e] not in self.ids and (best is None or (not bpe and weight[e] + self.unknown < best)):
                    best = weight[e] + self.unknown
                    last[e + 1] = (e, tuple(self.bytes[b] for b in unit[e].encode()))
                weight[e + 1] = best
            ids: list[int] = []
            k = n
            while k:
                k, i = last[k]
                ids.extend(reversed(i)) if type(i) is tuple else ids.append(i)
            out.append(struct.pack(f"<{len(ids)}I", *reversed(ids)))
            at += n + 1
        return out

    def _split(self, text: str) -> list[str]:
        """Units of one text; a line break is a unit of its own."""
        text = text.replace(" ", MARK)
        if self.prefix and text:
            text = MARK + text
        units: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                units.append("\n")
            if not line:
                continue
            parts = line.split(MARK)
            if "" in parts[1:]:  # marks that follow each other, or end the line
                run = ""
                if parts[0]:
                    units.append(parts[0])
                for p in parts[1:]:
                    run += MARK
                    if p:
                        units.append(run + p)
                        run = ""
                if run:
                    units.append(run)
            else:
                if parts[0]:
                    units.append(parts[0])
                units += [MARK + p for p in parts[1:]]
        return units

    def _cut(self, unit: str) -> list[str]:
        """The parts of a unit between which no piece runs."""
        cuts = [k for k in range(1, len(unit)) if (unit[k - 1], unit[k]) not in self.within]
        if not cuts:
            return [unit]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        cut = [self._cut(u) for u in units]
        kept = self.parts
        new = list({p for parts in cut for p in parts if p not in kept})
        if len(kept) + len(new) > KEEP_UNITS:
            kept.clear()
            new = list({p for parts in cut for p in parts})
        kept.update(zip(new, self._paths(new), strict=True))
        return [kept[parts[0]] if len(parts) == 1 else b"".join([kept[p] for p in parts]) for parts in cut]

    def _learn(self, tokens: set[str]) -> None:
        """Ids of tokens as ``encode`` cuts them: a word after a mark, or a line break and what follows it without one."""
        kept = self.units
        bare = {t: t[1:] if t[:1] == "\n" else MARK + t for t in tokens}
        units = [u for u in bare.values() if u]
        found: dict[str, bytes] = {"": b""}
        for k in range(0, len(units), 20_000):
            part = units[k : k + 20_000]
            found.update(zip(part, self._encode_units(part), strict=True))
        kept.update((t, self.line + found[u] if t[:1] == "\n" else found[u]) for t, u in bare.items())

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty and has none.

        Where no two marks can meet, one cut at spaces gives the units: each follows a mark, or a line break.
        """
        texts = [t or "" for t in texts]
        out = [b""] * len(texts)
        if len(self.units) > KEEP_UNITS:
            self.units.clear()
        tokens: dict[int, list[str]] = {}
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.prefix and MARK not in t and "  " not in t and t[0] != " ":
                tokens[k] = t.replace("\n", " \n").split(" ")
            else:
                units = self._split(t)
                known = dict(zip(new := list({u for u in units if u != "\n"}), self._encode_units(new), strict=True)) | {"\n": self.line}
                out[k] = b"".join([known[u] for u in units])
        kept = self.units.get
        found = {k: list(map(kept, ts)) for k, ts in tokens.items()}
        lacking = {k: list(compress(ts, map(is_, found[k], repeat(None)))) for k, ts in tokens.items() if None in found[k]}
        if lacking:
            self._learn(set().union(*lacking.values()))
            for k, ts in lacking.items():
                new = map(self.units.__getitem__, ts)
                found[k] = [ids if ids is not None else next(new) for ids in found[k]]
        for k, ids in found.items():
            out[k] = b"".join(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the dummy prefix goes."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_ids, ids_crc32) of each text; ids are little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; texts of any length are encoded whole. Rows are independent: repeated rows and
    null ids stay as they are, other columns are ignored, and an empty table gives no rows. ``model`` is a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = fst.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    names=["id", "ids", "n_ids", "ids_crc32"],
                )

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary, n_ids long, ids_crc32 long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of what ``encode`` returned; null ids count as none and give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            texts = [fst.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    plain = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, decoded_sha256, decoded_equal) of each text, encoded and decoded again in one pass.

    A text comes back as it was unless it holds the mark U+2581 itself, which decodes to a space. Null counts as empty.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                ids = fst.encode(texts)
                back = [fst.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    names=["id", "n_ids", "ids_crc32", "decoded_sha256", "decoded_equal"],
                )

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, decoded_equal boolean").withColumnRenamed("id", id_col)
