"""Quality rules: a learned decision list over statistics of whole texts, in DataFrame functions only.

Sequential covering learns from labelled statistics: a rule is grown, conjunct by conjunct, on two thirds of the
labelled rows and pruned on the other third; what it covers is removed and the next rule is grown. The list is
emitted as ordered Spark conditional expressions: the first rule that holds rejects, and what no rule rejects is kept.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
#: Ratios that rules compare with thresholds.
FEATURES = ["n_words", "word_length", "symbols_per_word", "dup_lines_per_100_words", "repeat_share", "upper_share"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of whole texts (null: empty).

    Columns of the same names are replaced; rows are independent of each other.
    """
    names = [c for c in docs.columns if c not in STATISTICS or c == text_col]
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    text = F.col("body")
    d = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    d = d.select(*inner.values(), "body", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
        ),
    )
    d = d.select(
        *inner.values(),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        # equal windows stand next to each other
        F.sort_array(windows).alias("sorted"),
    )
    more = F.size("sorted") - 1
    next_to = F.zip_with(
        F.slice("sorted", F.lit(1), more), F.slice("sorted", F.lit(2), more), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    twice = F.when(more >= 1, F.sort_array(F.array_distinct(F.flatten(F.filter(next_to, lambda x: x.isNotNull())))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        twice, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.select(*[F.col(a).alias(c) for c, a in inner.items()], *STATISTICS)


def features() -> dict[str, Column]:
    """The features as expressions over the statistics; a text without words has zeros."""
    n = F.col("n_words").cast("double")
    part = lambda x: F.when(n > 0, F.col(x) / n).otherwise(F.lit(0.0))
    return {
        "n_words": n,
        "word_length": part("word_chars"),
        "symbols_per_word": part("n_symbols"),
        "dup_lines_per_100_words": 100.0 * part("n_dup_lines"),
        "repeat_share": part("n_repeat_words"),
        "upper_share": F.when(F.col("word_chars") > 0, F.col("n_upper") / F.col("word_chars")).otherwise(F.lit(0.0)),
    }


def base_failed() -> Column:
    """Too short, or more than half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, known: dict[str, Column]) -> Column:
        return known[self.feature] > self.threshold if self.above else known[self.feature] <= self.threshold

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _thresholds(values: list[float], most: int) -> list[float]:
    """Middles between neighbouring values, at quantiles of the distinct values."""
    distinct = sorted(set(values))
    middles = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    if len(middles) <= most:
        return middles
    return sorted({middles[k * len(middles) // most] for k in range(most)})


def _counts(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    bad = good = 0
    for row, is_bad in rows:
        if all(c.holds(row) for c in rule):
            bad += is_bad
            good += not is_bad
    return bad, good


def _grow(rows: list[tuple[dict[str, float], bool]], most_conditions: int, cuts: int) -> Rule:
    """Add the conjunct of the largest information gain until the rule covers no good row."""
    rule: Rule = ()
    while len(rule) < most_conditions:
        bad, good = sum(b for _, b in rows), sum(not b for _, b in rows)
        if not good or not bad:
            break
        before = math.log2(bad / (bad + good))
        best: tuple[float, Condition] | None = None
        for name in FEATURES:
            at = sorted(((r[name], b) for r, b in rows), key=lambda x: x[0])
            values = [v for v, _ in at]
            marks = _thresholds(values, cuts)
            below_bad = below = k = 0
            for t in marks:
                while k < len(at) and at[k][0] <= t:
                    below_bad += at[k][1]
                    below += 1
                    k += 1
                for above, p, size in ((False, below_bad, below), (True, bad - below_bad, len(at) - below)):
                    if p:
                        gain = p * (math.log2(p / size) - before)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, Condition(name, above, t))
        if best is None or best[0] <= 0:
            break
        rule += (best[1],)
        rows = [(r, b) for r, b in rows if best[1].holds(r)]
    return rule


def _prune(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    """Drop final conjuncts while that doesn't lower (bad - good) / (bad + good) on the pruning rows."""

    def worth(r: Rule) -> float:
        bad, good = _counts(r, rows)
        return (bad - good) / (bad + good) if bad + good else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(rows: list[tuple[int, dict[str, float], bool]], precision: float = 0.95, most_rules: int = 12, most_conditions: int = 4, cuts: int = 64, least: int = 3) -> list[Rule]:
    """The ordered rules. ``rows``: id, features, whether labelled bad; the id decides who prunes.

    A rule stays if at least ``precision`` of what it covers is bad, on both parts, and it covers ``least`` bad rows.
    """
    rest = [(r, b, zlib.crc32(str(i).encode()) % 3 == 0) for i, r, b in rows]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, hold = [(r, b) for r, b, p in rest if not p], [(r, b) for r, b, p in rest if p]
        rule = _grow(grow, most_conditions, cuts)
        if not rule:
            break
        rule = _prune(rule, hold)
        (b1, g1), (b2, g2) = _counts(rule, grow), _counts(rule, hold)
        if b1 + b2 < least or b1 < precision * (b1 + g1) or b2 < precision * (b2 + g2):
            break
        rules.append(rule)
        rest = [(r, b, p) for r, b, p in rest if not all(c.holds(r) for c in rule)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[int, dict[str, float], bool]]:
    """At most ``most`` labelled documents, the first by a hash of their ids: the only sample that is taken here.

    A document counts once; null labels and ids are left out, and a label of 0 is bad.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").alias("v"))
        .where("k is not null and v is not null")
        .groupBy("k")
        .agg(F.min("v").alias("v"))
        .orderBy(F.xxhash64(F.lit(5), "k"), "k")
        .limit(most)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("text"))
    found = with_statistics(texts.join(F.broadcast(chosen), "k"))  # ``most`` rows of two numbers
    known = features()
    got = found.select("k", "v", *[known[f].alias(f"f_{f}") for f in FEATURES]).dropDuplicates(["k"]).collect()
    return sorted(((r["k"], {f: r[f"f_{f}"] for f in FEATURES}, r["v"] == 0) for r in got), key=lambda x: x[0])


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the rule that rejects it (from 1; 0: none)."""
    known = features()
    fired = F.lit(0)
    for k in range(len(rules) - 1, -1, -1):
        holds = F.lit(True)
        for c in rules[k]:
            holds = holds & c.column(known)
        fired = F.when(holds, F.lit(k + 1)).otherwise(fired)
    return fired == 0, fired


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the statistics, base_failed, kept and rule.

    Null and empty texts have no words and fail the base. Result columns replace columns of the same names; rows are
    independent, so repeated rows get the same verdict. An empty list of rules keeps what passes the base.
    """
    own = {"base_failed", "kept", "rule"}
    docs = docs.drop(*[c for c in docs.columns if c in own])
    keep, fired = verdict(rules)
    out = with_statistics(docs, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & keep).withColumn("rule", fired)


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base and the rules keep, with the statistics.

    A filter over statistics would be pushed below them with all their expressions written out in it, lambdas within
    lambdas, and cost a square of a text's words. A row number, which isn't deterministic, holds it where it is.
    """
    verdict_, _ = verdict(rules)
    row = "row"
    while row in docs.columns:  # a column of the table keeps its name
        row += "_"
    numbered = with_statistics(docs, text_col).withColumn(row, F.monotonically_increasing_id())
    return numbered.where(~base_failed() & verdict_ & (F.col(row) >= 0)).drop(row)
