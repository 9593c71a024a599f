"""String, hash, link and date functions as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns.
LINK = r"\[([^\]]+)\]\([^\)]+\)"
TAX_ID = r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_]-)([0-9]-?){8}[0-9](?![A-Za-z0-9_])(?!\.[0-9])"
#: Keys of log records whose values aren't masked.
UNMASKED_KEYS = ["account_key", "count", "created", "hostname", "process", "thread"]
#: White space at either end, and what ends a line, in Unicode's sense and with the four separators of ASCII.
ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
UUID_PARTS = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
HEADING = "^(#+) (.*)"
EDD_TAB_LABEL = r"(?m)^\s*\* #+"
EDD_EMPTY_ITEM = r"(?mU)^\s*(\w+\.|\*|\+|\-) (\w+\.|\*|\+|\-)\s*$"
LIST_AFTER_TEXT = r"(?m)((?:^|\n)(?!\s*([-*+]|\d+\.)\s).+?)\n([ \t]*([-*+]|\d+\.)\s+)"
INNER_ITEM = r"(?m)^ {2,3}([\-\+\*]) "
POLICY_CLEANUP = [
    (r"(?mU)^( *)[\*|\-|\+] (\w{1,2}+[\.|\)] )", "$1$2"),
    ("~~~~", ""),
    (r"(?m)^\*\*\*\*\n", ""),
    (r"(?m)^--- *\n", ""),
    (r"(?m)^ *\* \*\* *_Note_\*\*", "**_Note_**"),
    (r"\n\n+", "\n\n"),
]


def join_list(parts: Column, sep: str = "\n") -> Column:
    """Joined parts; a null list gives the empty string."""
    return F.coalesce(F.array_join(parts, sep), F.lit(""))


def remove_links(md: Column) -> Column:
    """Markdown links replaced by their texts."""
    return F.regexp_replace(md, LINK, "$1")


def resolve_urls(base: Column, md: Column) -> Column:
    """Links made absolute: from the root by the domain, others that have no scheme by the base."""
    domain = F.concat(F.parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(base, F.lit("AUTHORITY")))
    quoted = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    rooted = F.regexp_replace(md, F.lit(r"\]\(/"), F.concat(F.lit("]("), quoted(domain), F.lit("/")))
    folder = F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))
    return F.regexp_replace(rooted, F.lit(r"\]\((?!/|https?://)"), F.concat(F.lit("]("), quoted(folder)))


def words_only(text: Column) -> Column:
    """Words by runs of other characters, in Unicode's sense."""
    return F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")


def highlighted_uri(url: Column, text: Column) -> Column:
    """A link to the stretch of a page that begins and ends with the first and last five words; null without a url."""
    words = words_only(text)
    head = F.array_join(F.slice(words, F.lit(1), F.lit(5)), "%20")
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), F.lit(5)), "%20")
    return F.when(url.isNotNull() & (url != ""), F.concat(F.regexp_replace(url, "/$", ""), F.lit("#:~:text="), head, F.lit(","), tail))


def basic_ascii(text: Column) -> Column:
    """Other than printable ASCII replaced by spaces."""
    return F.regexp_replace(text, "[^ -~]", " ")


def content_hash(text: Column) -> Column:
    return F.md5(text)


def uuid_of(*parts: Column) -> Column:
    """A UUID of the md5 of the parts, two bars between them."""
    return F.regexp_replace(F.md5(F.concat_ws("||", *parts)), UUID_PARTS, "$1-$2-$3-$4-$5")


def qa_pair_id(given: Column, dataset: Column, question: Column, answer: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), uuid_of(dataset, question, answer))


def headings_markdown(headings: Column) -> Column:
    """Headings with a mark for each level; empty ones are left out but count as levels."""
    marked = F.transform(headings, lambda h, i: F.when(h != "", F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h)))
    return F.array_join(F.filter(marked, lambda h: h.isNotNull()), "\n")


def parse_heading(md: Column) -> Column:
    """(level, text) of a heading line; anything else is an error."""
    level = F.length(F.regexp_extract(md, HEADING, 1))
    return F.when(level > 0, F.struct(level.alias("level"), F.regexp_extract(md, HEADING, 2).alias("text"))).otherwise(
        F.raise_error(F.concat(F.lit("not a heading: "), md)).cast("struct<level:int,text:string>")
    )


def separators(md: Column) -> Column:
    """Table separator lines made short."""

    def short(line: Column) -> Column:
        cells = F.size(F.split(line, r"\|")) - 2
        return F.when(line.startswith("| ---"), F.concat(F.lit("| "), F.repeat(F.lit("--- | "), cells))).otherwise(line)

    return F.array_join(F.transform(F.split(md, "\n"), short), "\n")


def mask_tax_ids(text: Column) -> Column:
    """Nine digits, with or without hyphens, masked, unless a word and a hyphen stand before or a decimal after.

    Letters, digits and the underscore of ASCII make words; a letter beyond ASCII next to an id doesn't keep it.
    """
    return F.regexp_replace(text, TAX_ID, "*********")


def masked_values(record: Column) -> Column:
    """A map of a log record's values with tax ids masked, but for keys whose values are known to be safe."""
    return F.transform_values(record, lambda k, v: F.when(k.isin(UNMASKED_KEYS), v).otherwise(mask_tax_ids(v)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def edd_fixes(md: Column) -> Column:
    """Known faults of one source's markdown: spaced dots, sublists without a list, headings and nothing as items."""
    md = F.replace(F.replace(md, F.lit(". . ."), F.lit("...")), F.lit("* + "), F.lit("    + "))
    md = F.regexp_replace(md, EDD_TAB_LABEL, "")
    return F.regexp_replace(md, EDD_EMPTY_ITEM, "")


def list_repairs(md: Column) -> Column:
    """A blank line before a list that follows a paragraph, and four spaces before an item of an inner list."""
    md = F.regexp_replace(md, LIST_AFTER_TEXT, "$1\n\n$3")
    return F.regexp_replace(md, INNER_ITEM, "    - ")


def policy_cleanup(md: Column) -> Column:
    """Faults of another source's markdown: bullets before numbers and notes, fences, rules, blank lines."""
    for pattern, instead in POLICY_CLEANUP:
        md = F.regexp_replace(md, pattern, instead)
    return stripped(md)


def without_anchors(md: Column) -> Column:
    """Links to collapsed parts and panes of the same page replaced by their texts."""
    return F.regexp_replace(F.regexp_replace(md, r"\[(.*?)\]\(#collapse-(.*?)\)", "$1"), r"\[(.*?)\]\(#pane-(.*?)\)", "$1")


def page_number(text: Column) -> Column:
    """The page in "n of m"."""
    return F.nullif(F.regexp_extract(text, "^([0-9]+) of ([0-9]+)$", 1), F.lit(""))


def header_date(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]+-[0-9]+-[0-9]+)", 1), F.lit(""))


def section_number(text: Column, name: str = "BEM") -> Column:
    return F.nullif(F.regexp_extract(text, f"^{name} ([0-9]+)$", 1), F.lit(""))


def shortened(text: Column, limit: int, most_lines: int = 2, mark: str = "...") -> Column:
    """The first lines, whole words of them within ``limit``, with a mark where words were left out."""

    def short(line: Column, room: Column) -> Column:
        plain = F.trim(F.regexp_replace(line, r"\s+", " "))
        head = F.regexp_extract(F.substring(plain, F.lit(1), room - len(mark) + 1), r"^(.*)\s", 1)
        return F.when(F.length(plain) <= room, plain).otherwise(F.concat(F.rtrim(head), F.lit(mark)))

    lines = F.slice(F.split(text, "\r\n|\n|\r"), 1, most_lines)
    start = F.struct(F.lit(limit).alias("room"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        made = short(line, acc["room"])
        go = (acc["room"] >= len(mark)) | (F.size(acc["out"]) == 0)
        return F.struct(F.when(go, acc["room"] - F.length(made)).otherwise(acc["room"]).alias("room"), F.when(go, F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")


def thread_link(base: str, *ids: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), *ids)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def bucket_and_key(url: Column) -> Column:
    """(bucket, key) of a store's url."""
    return F.struct(F.parse_url(url, F.lit("HOST")).alias("bucket"), F.regexp_replace(F.parse_url(url, F.lit("PATH")), "^/", "").alias("key"))


def breadcrumb(headings: Column, doc_name: Column) -> Column:
    """The last two headings that aren't empty, without the document's own name in front, joined by arrows."""
    full = F.filter(headings, lambda h: h != "")
    last = F.when(F.size(full) >= 2, F.slice(full, F.lit(-2), F.lit(2))).otherwise(full)
    rest = F.when((F.size(last) > 0) & (F.get(last, F.lit(0)) == doc_name), F.slice(last, F.lit(2), F.size(last))).otherwise(last)
    return F.array_join(rest, " → ")


def file_path(base_dir: Column, common: str, url: Column) -> Column:
    """Where a page's file lies below a folder; a folder's own page is ``_index``."""
    rest = F.when(url.startswith(common), F.substring(url, F.lit(len(common) + 1), F.length(url))).otherwise(url)
    rest = F.regexp_replace(rest, "^/", "")
    path = F.concat(base_dir, F.lit("/"), rest)
    return F.when(F.endswith(path, F.lit("/")), F.concat(path, F.lit("_index"))).otherwise(path)


def simple_list(items: Column) -> Column:
    """Nothing, the one item, or the items in brackets."""
    listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "").when(F.size(items) == 1, F.get(items, F.lit(0))).otherwise(listed)


def query_value(url: Column, key: str) -> Column:
    """The first value of a key of a url's query."""
    return F.nullif(F.url_decode(F.regexp_extract(F.parse_url(url, F.lit("QUERY")), f"(?:^|&){key}=([^&]*)", 1)), F.lit(""))


def first_line(text: Column) -> Column:
    """The first line of what is left without white space at the ends."""
    return F.get(F.split(stripped(text), LINE_END), F.lit(0))


def token_length(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def mock_embedding(text: Column, width: int = 768) -> Column:
    """(cos, sin) of a quarter turn times the mean word length, then zeros; zeros for an empty text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.length(w)) / F.size(words)
    angle = F.lit(1.5707963267948966) * mean
    full = F.concat(F.array(F.cos(angle), F.sin(angle)), F.array_repeat(F.lit(0.0), width - 2))
    return F.when(F.size(words) > 0, full).otherwise(F.array_repeat(F.lit(0.0), width))


def us_date(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy")


def adjust_timezone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def special_command(text: Column) -> Column:
    """(command, start, stop) of a message: a lower-case word, and two times where they parse."""
    parts = F.split(F.trim(text), r"\s+")
    time = lambda i: F.try_to_timestamp(F.get(parts, F.lit(i)))
    return F.struct(F.lower(F.trim(text)).alias("command"), time(0).alias("start"), time(1).alias("stop"))


def readability(text: Column) -> dict[str, Column]:
    """Flesch ease, grades by several formulas, from counts of words, sentences, syllables and letters."""
    words = F.greatest(token_length(text), F.lit(1)).cast("double")
    sentences = F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+"), F.lit(0))), F.lit(1)).cast("double")
    syllables = F.greatest(F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[aeiouy]+"), F.lit(0))), F.lit(1)).cast("double")
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", "")).cast("double")
    hard = F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0))) >= 3)).cast("double")
    ease = 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words)
    grade = 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59
    fog = 0.4 * (words / sentences + 100.0 * hard / words)
    coleman = 0.0588 * (100.0 * letters / words) - 0.296 * (100.0 * sentences / words) - 15.8
    mean = (grade + fog + coleman) / 3.0
    return {"flesch_ease": ease, "flesch_kincaid": grade, "gunning_fog": fog, "coleman_liau": coleman, "average_grade": mean, "readable": (mean <= 12.0) & (ease >= 50.0)}


def char_diffs(old: Column, new: Column) -> Column:
    """(added, removed): characters that a line-by-line comparison of single characters marks as put in, and taken out."""

    @F.pandas_udf("struct<added:int,removed:int>")
    def count(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        signs = [[d[0] for d in difflib.ndiff(a or "", b or "")] for a, b in zip(old, new, strict=True)]
        return pd.DataFrame({"added": [s.count("+") for s in signs], "removed": [s.count("-") for s in signs]}, dtype="int32")

    return count(old, new)


def count_diffs(old: Column, new: Column) -> Column:
    """(added, removed) as the engine that is matched counts them: its comparison is used up by the first count, so the
    second is 0. ``char_diffs`` has both."""
    return F.struct(char_diffs(old, new)["added"].alias("added"), F.lit(0).alias("removed"))


def marked_sentences(text: Column) -> Column:
    """Sentences cut behind . ? and !, where the stop isn't part of a number, a web address, a title or an initial.

    Stops that don't end a sentence are set aside first; closing quotes go with the sentence.
    """
    held = "\u0001"
    t = F.regexp_replace(text, r"\s+", " ")
    t = F.regexp_replace(t, r"\b(Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Inc|Ltd|Jr|Sr|Co)\.", f"$1{held}")
    t = F.regexp_replace(t, r"\.(com|net|org|io|gov|edu|me)\b", f"{held}$1")
    t = F.regexp_replace(t, r"(?<=[0-9])\.(?=[0-9])", held)
    t = F.regexp_replace(t, r"(?<![A-Za-z])([A-Za-z])\.(?=[A-Za-z ])", f"$1{held}")
    parts = F.split(t, r"(?<=[.?!])(?![.?!\"”])|(?<=[.?!][\"”])")
    whole = F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(held), F.lit("."))))
    return F.filter(whole, lambda p: p != "")


def citations_behind_marks(answer: Column) -> Column:
    """Citations before a mark moved behind it, and the answer without white space at its ends."""
    return stripped(F.regexp_replace(answer, r" *((?: *\(citation-\d+\))+) *([.?!])", "$2 $1"))


def cited_in_order(answer: Column) -> Column:
    """The different citations of an answer, as they first appear."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\((citation-\d+)\)"), F.lit(1)))


def renumbered_citations(answer: Column) -> Column:
    """(answer, citations): citations named by numbers from 1 as they first appear, and what each was before."""
    cited = cited_in_order(answer)
    name = lambda c: F.concat(F.lit("(citation-"), F.array_position(cited, c).cast("string"), F.lit(")"))
    plain = F.split(answer, r"\(citation-\d+\)", -1)
    each = F.regexp_extract_all(answer, F.lit(r"\((citation-\d+)\)"), F.lit(1))
    text = F.array_join(F.transform(plain, lambda part, i: F.concat(part, F.coalesce(name(F.get(each, i)), F.lit("")))), "")
    return F.struct(text.alias("answer"), cited.alias("citations"))
