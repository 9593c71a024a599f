"""Personal data by candidate gradient boosting.

High-recall generators propose spans of several kinds, which may overlap. Boosted trees score each candidate from its
format and its context; a threshold for each kind, chosen on labelled samples that the trees haven't seen, selects
what is redacted. Fixed formats (email, ip, card, phone) are found exactly beside these, and always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Kinds in the order in which they are listed; the first four have fixed formats.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "mac", "ipv6", "birth"]
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int, int]  # start, kind, stop


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each dotted run."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, stop
            at = stop + 1


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed formats, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


#: Generators. They propose far more than is personal data.
GENERATORS = [
    (0, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{0,40} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,40}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]{2,12}){1,3}(?![A-Za-z0-9])")),
    (2, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-]|[0-9]{2,4}[ ./-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])")),
    (3, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9,11}(?![0-9A-Za-z.-])")),
    (4, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![0-9A-Za-z-])")),
    (5, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (6, re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")),
    (7, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")),
    (8, re.compile(r"(?<![0-9/.-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/.-])")),
]
#: Words that speak for a kind, and words that speak against all.
CUES = {
    "email": ("mail", "contact", "write"), "card": ("card", "visa", "credit", "payment", "account"), "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "cell"),
    "ssn": ("ssn", "social", "security", "tax"), "iban": ("iban", "bank", "transfer", "account"), "mac": ("mac", "device", "hardware"), "ipv6": ("ip", "host", "address", "server"),
    "birth": ("born", "birth", "dob", "birthday"),
}
AGAINST = ("order", "invoice", "version", "page", "isbn", "part", "serial", "model", "total", "ratio", "released", "meeting", "id")
_WORD = re.compile(r"[a-z]+")
CONTEXT = 40


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    return sorted({(m.start(), kind, m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)})


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, kind, stop = span
    body = text[start:stop]
    digits = _digits(body)
    before = text[max(0, start - CONTEXT) : start].lower()
    after = text[stop : stop + CONTEXT // 2].lower()
    near = _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]
    own = CUES.get(KINDS[kind], ())
    cue = sum(any(c in w for c in own) for w in near)
    other = sum(any(c in w for k, v in CUES.items() if k != KINDS[kind] for c in v) for w in near)
    against = sum(w in AGAINST for w in near)
    area = digits[:3] if len(digits) == 9 else ""
    parts = [int(p) for p in re.split(r"[./-]", body)] if kind == 8 else []
    day = parts and (all(1 <= p <= 31 for p in sorted(parts)[:2]) and min(parts) <= 12)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(body)), float(len(digits)), len(digits) / max(1, len(body)), float(len(set(digits))),
        float(sum(c in " .-/()" for c in body)), float("-" in body), float(" " in body), float("." in body), float("(" in body), float(":" in body),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(kind == 5 and iban_ok(body)),
        float(bool(area) and area not in ("000", "666") and area < "900" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(bool(day)), float(cue), float(other), float(against),
        float(before[-1:] in ("", " ", "\n", ":", "(", '"')), float(before.rstrip()[-1:] in (":", "=", "#", "$", "€")), float(after[:1] in ("", " ", "\n", ",", ".", ")", '"', ";")), float("#" in before[-3:] or "$" in before[-3:]),
    ]


# -- labelled samples ---------------------------------------------------------------------------------------------


def _number(r: random.Random, form: str) -> str:
    return "".join(str(r.randrange(10)) if c == "9" else r.choice("0123456789abcdef") if c == "h" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)


def _with_luhn(r: random.Random, form: str) -> str:
    while True:
        s = _number(r, form)
        if luhn(_digits(s)):
            return s


def _iban(r: random.Random) -> str:
    country, rest = r.choice(["DE", "FR", "GB", "NL", "ES"]), _number(r, r.choice(["999999999999999999", "AAAA99999999999999"]))
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    s = f"{country}{check:02d}{rest}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _ssn(r: random.Random) -> str:
    return f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"


def labelled_samples(n: int, seed: int = 23) -> list[tuple[str, Span, bool]]:
    """(text, candidate, personal): seeded sentences that hold personal data, or numbers that look like it.

    Public formats in invented sentences; every candidate of a sentence is labelled, so overlapping proposals of a
    wrong kind are negative samples.
    """
    r = random.Random(seed)
    letters = "etaoinshrdlcu"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 9)))
    personal = [
        (0, lambda: f"{word()}.{word()} {r.choice(['[at]', '(at)'])} {word()} {r.choice(['[dot]', '(dot)'])} {r.choice(['com', 'org', 'net', 'de'])}", ("email", "write to", "contact")),
        (2, lambda: _with_luhn(r, r.choice(["4999.9999.9999.9999", "5999.9999.9999.9999"])), ("card", "visa", "credit card")),
        (3, lambda: _number(r, r.choice(["(999) 555-9999", "999-555-9999", "999 555 9999", "0099 999 9999 999", "999.555.9999"])), ("call", "phone", "tel:", "mobile", "", "")),
        (3, lambda: _number(r, "9995559999"), ("call", "phone", "tel:")),
        (4, lambda: _ssn(r), ("ssn", "social security number", "SSN:", "", "")),
        (5, lambda: _iban(r), ("iban", "transfer to", "account", "")),
        (6, lambda: _number(r, r.choice(["hh:hh:hh:hh:hh:hh", "hh-hh-hh-hh-hh-hh"])), ("mac", "device", "")),
        (7, lambda: _number(r, "2001:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh"), ("host", "ip", "")),
        (8, lambda: f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1930, 2012)}", ("born", "birthday", "date of birth")),
        (8, lambda: f"{r.randrange(1930, 2012)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", ("born on", "dob:")),
    ]
    other = [
        lambda: f"order {_number(r, '9999999999')}", lambda: f"invoice {_number(r, '999-99-9999')}", lambda: f"part {_number(r, '999-9999-999')}",
        lambda: f"version {_number(r, '9.9.2019')}", lambda: f"isbn {_number(r, '978-9-99-999999-9')}", lambda: f"serial {_number(r, 'AA99 9999 9999 9999')}",
        lambda: f"{word()} {_number(r, '999999999')}", lambda: f"{word()} {_number(r, '9999999999')} {word()}", lambda: f"total {_number(r, '999 999 9999')}", lambda: f"meeting on {r.randrange(1, 29)}.{r.randrange(1, 13)}.20{r.randrange(10, 25)}",
        lambda: f"{word()} {r.randrange(1, 29)}/{r.randrange(1, 13)}/20{r.randrange(10, 25)}", lambda: f"ratio {_number(r, '99:99:99')}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} {_number(r, '9999 9999 9999 9999')}",
        lambda: f"page {_number(r, '999 9999 9999')}", lambda: f"id {_number(r, '900-99-9999')}", lambda: f"released 20{r.randrange(10, 25)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda: f"{word()} {_number(r, 'AA99 AAAA')} {word()}",
    ]
    out: list[tuple[str, Span, bool]] = []
    while len(out) < n:
        left, right = " ".join(word() for _ in range(r.randrange(1, 6))), " ".join(word() for _ in range(r.randrange(0, 4)))
        if r.random() < 0.5:
            kind, make, cues = r.choice(personal)
            cue = r.choice(cues)
            body = make()
            text = f"{left} {cue} {body}{r.choice(['', '.', ','])} {right}" if cue else f"{left} {body}{r.choice(['', '.', ','])} {right}"
            start = text.index(body)
            truth = (start, kind, start + len(body))
        else:
            text, truth = f"{left} {r.choice(other)()}{r.choice(['', '.', ','])} {right}", None
        out += [(text, c, c == truth) for c in candidates(text)]
    return out[:n]


# -- gradient boosting --------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Depth-limited regression trees on the gradient of the logistic loss, and a calibrated threshold for each kind."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut, leaf values
    rate: float = 0.15
    first: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=list)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.first)
        rows = np.arange(len(x))
        for features_, cuts, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features_[node]] > cuts[node])
            out += self.rate * leaves[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, bins: int = 32) -> Boosted:
    """Newton boosting over binned features."""
    model = Boosted(depth=depth)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.first = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), model.first)
    inner, leaves_n = 2**depth - 1, 2**depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 8:
                    continue
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = total_g**2 / (total_h + 1) + 1e-6
                for j, c in enumerate(cuts):
                    if len(c) == 0:
                        continue
                    lg = np.cumsum(np.bincount(binned[rows, j], g[rows], minlength=len(c) + 1))[:-1]
                    lh = np.cumsum(np.bincount(binned[rows, j], h[rows], minlength=len(c) + 1))[:-1]
                    gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1)
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], j, c[at]
            here = (node >= 2**level - 1) & (node < 2 ** (level + 1) - 1)
            node[here] = 2 * node[here] + 1 + (x[here, feature[node[here]]] > cut[node[here]])
        leaf = node - inner
        values = -np.bincount(leaf, g, minlength=leaves_n) / (np.bincount(leaf, h, minlength=leaves_n) + 1)
        model.trees.append((feature, cut, values))
        margin += model.rate * values[leaf]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float) -> None:
    """Platt scaling on unseen samples, then for each kind the least threshold that reaches ``precision`` there."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-(a * m + b)))
        g, w = p - y, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * m).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)
    p = model.probability(x)
    for k in range(len(KINDS)):
        q, t = p[kind == k], y[kind == k]
        order = np.argsort(-q, kind="stable")
        hits = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(hits >= precision)
        model.thresholds.append(max(0.5, float(q[order[good[-1]]])) if len(good) and t.any() else 2.0)


def train(samples: int = 12_000, precision: float = 0.97, seed: int = 23) -> Boosted:
    """The model, from at most ``samples`` labelled samples; every third calibrates."""
    rows = labelled_samples(samples, seed)
    x = np.array([features(t, c) for t, c, _ in rows])
    y = np.array([p for _, _, p in rows], dtype=float)
    kind = np.array([c[1] for _, c, _ in rows])
    held = np.arange(len(rows)) % 3 == 0
    model = fit(x[~held], y[~held])
    calibrate(model, x[held], y[held], kind[held], precision)
    return model


def method_spans(text: str, base: list[Span], model: Boosted) -> list[Span]:
    """Candidates that pass their kind's threshold, the likeliest first, none over another or over a base span."""
    found = candidates(text)
    if not found:
        return []
    p = model.probability(np.array([features(text, c) for c in found]))
    out: list[Span] = []
    # stretches that are taken, apart from each other and in order, so that a look at two neighbours is enough
    starts: list[int] = []
    stops: list[int] = []
    for a, _, b in sorted(base):
        if stops and a < stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    for k in np.argsort(-p, kind="stable"):
        start, kind, stop = found[k]
        if p[k] < model.thresholds[kind]:
            continue
        at = bisect.bisect_left(starts, start)
        if (at and stops[at - 1] > start) or (at < len(starts) and starts[at] < stop):
            continue
        out.append(found[k])
        starts.insert(at, start)
        stops.insert(at, stop)
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping ones the first."""
    out, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


RESULT = {**{f"n_{k}": T.LongType() for k in BASE}, "base_sha256": T.StringType(), "spans": T.StringType()}


def find(docs: DataFrame, model: Boosted, text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans; with ``redact`` also redacted.

    Spans are kind:start:stop in code points, stop exclusive, by start and then kind. Null texts count as empty and
    have no spans; texts of any length are read whole, in time that follows their length. Rows are independent, so
    repeated rows get the same result; result columns replace columns of the same names, all others stay. Of equally
    likely candidates that overlap the first stays. An empty table gives no rows.
    """
    own = {*RESULT, *(["redacted"] if redact else [])}
    names = [c for c in docs.columns if c not in own or c == text_col]
    carried = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*carried.schema.fields, *(T.StructField(n, k) for n, k in RESULT.items()), *([T.StructField("redacted", T.StringType())] if redact else [])])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + method_spans(text, base, model)
                counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), *([redacted(text, spans)] if redact else [])))
            more = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(list(arrow)[batch.num_columns :])]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow, strict=False)), *more], schema=arrow)

    out = carried.mapInArrow(run, schema)
    return out.select(*[F.col("text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(names)], *RESULT, *(["redacted"] if redact else []))
