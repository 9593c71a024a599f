"""Sentences and lists cut into pieces of bounded length: column expressions, with abbreviations learned from the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.relational import unused

#: Ends a sentence wherever it stands; also what marks sentence ends while a text is cut.
END = "\x1e"
#: A token's word: letters with periods between them, and whether a period follows, within quotes and brackets.
_WORD = r"^[\"'(\[«“„]*(\p{L}[\p{L}.]*?)(\.?)[,;:!?\"')\]»”]*$"
_CLOSED = r"[.?!][\"')\]»”]*\s*$"
STATE = "struct<pieces:array<string>,piece:string>"


def _tokens(text: Column) -> Column:
    """Stretches without white space, with the white space behind them."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))


def abbreviations(docs: DataFrame, text: str, threshold: float = 0.3) -> DataFrame:
    """(word, score) of lower-cased words whose period belongs to them, from all texts of a corpus.

    The score is a log-likelihood ratio: how much better a word's periods fit a word that nearly always has one than
    any word of the corpus; times a factor for shortness, one for inner periods, and one that falls with each time the
    word stands without (Kiss and Strunk, 2006). Words are counted where they are, so that a word that half of the
    corpus holds reaches its sum once for each task. Null texts have no words.
    """
    tokens = docs.select(F.explode(F.split(F.lower(text), r"(?U)\s+")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    found = tokens.select(F.regexp_extract("t", _WORD, 1).alias("word"), (F.regexp_extract("t", _WORD, 2) == ".").alias("dotted"), "c").where("word <> ''")
    counts = found.groupBy("word").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("dotted"), F.col("c"))), F.lit(0)).alias("with"))
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("with").alias("all_with"))  # one row
    n, dotted, plain = F.col("n"), F.col("with"), F.col("n") - F.col("with")
    rate = F.greatest(F.col("all_with") / F.col("all_n"), F.lit(1e-12))
    rest = F.greatest(1 - rate, F.lit(1e-12))
    ratio = 2 * (dotted * F.log(F.lit(0.99)) + plain * F.log(F.lit(0.01)) - dotted * F.log(rate) - plain * F.log(rest))
    letters = F.length(F.replace("word", F.lit(".")))
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -plain.cast("double"))
    scored = counts.where("with > 0").join(F.broadcast(totals)).select("word", score.alias("score"))
    return scored.where(F.col("score") > threshold)


def with_sentences(docs: DataFrame, text: str, abbreviated: DataFrame, key: str, name: str = "sentences", most: int = 10_000) -> DataFrame:
    """Rows with the sentences of a text as an array: cut behind ``?`` and ``!``, and behind periods unless the word is an
    abbreviation or a single letter, or goes on in lower case.

    White space between sentences goes, within them it stays; U+001E ends a sentence. Null texts have null, texts without
    words no sentences. Up to ``most`` abbreviations are part of the expression; beyond that each text is joined to
    its own by ``key``, which tells rows apart. Other columns stay.
    """
    tokens, own = unused(docs, "_tokens"), unused(docs, "_own")
    rows = docs.withColumn(tokens, _tokens(F.col(text)))
    word = lambda t: F.lower(F.regexp_extract(F.rtrim(t), _WORD, 1))
    known = [r["word"] for r in abbreviated.select("word").limit(most + 1).collect()]
    if len(known) <= most:
        rows = rows.withColumn(own, F.lit(None).cast("array<string>"))
        is_short = lambda t: word(t).isin(known) if known else F.lit(False)
    else:
        ends = F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(r"\.[\"')\]»”,;:]*\s*$")), word))
        held = rows.select(key, F.explode(ends).alias("word")).join(abbreviated.select("word"), "word").groupBy(key).agg(F.collect_list("word").alias(own))
        rows = rows.join(held, key, "left")
        is_short = lambda t: F.coalesce(F.array_contains(own, word(t)), F.lit(False))

    def marked(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        period = t.rlike(r"\.[\"')\]»”]*\s*$")
        goes_on = after.rlike(r"^[\"'(\[«“„]*\p{Ll}") | is_short(t) | (F.length(word(t)) == 1)
        end = t.rlike(_CLOSED) & after.isNotNull() & ~(period & goes_on)  # most tokens end at the first
        return F.when(F.coalesce(end, F.lit(False)), F.concat(F.regexp_replace(t, r"(?U)\s+$", ""), F.lit(END))).otherwise(t)

    parts = F.split(F.array_join(F.transform(tokens, marked), ""), END)
    said = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    return rows.withColumn(name, F.when(F.col(text).isNotNull(), said)).drop(tokens, own)


def _fold(lines: Column, limit: Column, sep: str, cut: object) -> Column:
    """Lines put together while they stay within ``limit``; ``cut`` gives the pieces of a line that has no room by itself."""
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit("").alias("piece")).cast(STATE)
    state = lambda pieces, piece: F.struct(pieces.alias("pieces"), piece.alias("piece")).cast(STATE)

    def add(s: Column, line: Column) -> Column:
        longer = F.when(s["piece"] != "", F.concat(s["piece"], F.lit(sep), line)).otherwise(line)
        before = F.when(s["piece"] != "", F.array_append(s["pieces"], s["piece"])).otherwise(s["pieces"])
        return F.when(F.length(longer) <= limit, state(s["pieces"], longer)).when(F.length(line) < limit, state(before, line)).otherwise(state(F.concat(before, cut(line)), F.lit("")))

    return F.aggregate(lines, start, add, lambda s: F.array_append(s["pieces"], s["piece"]))


def join_up_to(lines: Column, limit: Column | int, sep: str = " ") -> Column:
    """Pieces of at most ``limit`` characters from lines put together in order; null for null.

    A line that is put down where the one before ends needs less than ``limit`` (not as much) to begin a piece; any
    other is cut behind commas, semicolons and line breaks, whose parts are put together likewise, and a part that is
    still longer at every ``limit`` characters. The last piece is what is left, nothing if the last line was cut. No
    lines are one empty piece. A limit below 1 is an error.
    """
    bound = F.lit(limit) if isinstance(limit, int) else limit
    bound = F.when(bound >= 1, bound).otherwise(F.raise_error(F.lit("a limit leaves no room")).cast("int"))
    hard = lambda part: F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1)), bound), lambda at: F.substring(part, at, bound))
    soft = lambda line: _fold(F.regexp_extract_all(line, F.lit(r"[,;\n]|[^,;\n]+"), F.lit(0)), bound, "", hard)
    return F.when(lines.isNotNull(), _fold(lines, bound, sep, soft))


def split_paragraph(sentences: Column, text: Column, limit: int) -> Column:
    """A paragraph's sentences in pieces; of a single sentence what stands between blank lines."""
    return F.when(F.size(sentences) == 1, join_up_to(F.split(text, "\n\n"), limit, "\n\n")).otherwise(join_up_to(sentences, limit))


def split_list(text: Column, limit: int, intro: bool = True) -> Column:
    """A list's lines in pieces, each behind the first line, which introduces them; a limit without room for items is an error.

    The room of a piece is the limit without the introduction and one character for each line of the whole list.
    """
    lines = F.split(text, "\n")
    first = F.get(lines, F.lit(0)) if intro else F.lit("")
    items = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))) if intro else lines
    room = F.lit(limit) - F.length(first) - F.size(lines)
    return F.transform(join_up_to(items, room, "\n"), lambda piece: F.concat(first, F.lit("\n"), piece))
