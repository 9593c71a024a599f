"""Secret scans by character Markov models, in DataFrame functions only.

Two first-order Markov models are counted from labelled samples, one of random strings and one of ordinary
identifiers. A run of identifier characters is a secret if the log-likelihood ratio of the two models, for each
transition, passes a threshold that is taken from labelled samples the models haven't seen. Logarithms are kept as
whole thousandths, so that sums are the same everywhere. Spans of the fixed formats are found beside these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import stage

#: Fixed formats, in the order in which kinds are listed.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
#: Runs that the models judge, and the least length.
RUN, LEAST = "[A-Za-z0-9+/_=-]", 20
#: What begins or follows a quantity of text that can hold each format, so that most texts cost one search.
GATES = {"assign": "(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "random": f"{RUN}{{{LEAST}}}"}
ALPHABET = 128

#: Labelled samples of identifiers, beside those that are made from the words of texts.
ORDINARY = (
    "getUserAccountSettings", "max_partition_bytes_per_task", "applicationConfigurationManager", "content-security-policy", "HTTPConnectionPoolTimeout",
    "index_of_last_processed_row", "org/example/service/handlers", "DEFAULT_RETRY_INTERVAL_SECONDS", "first_quarter_report_2021", "InternationalOrganization",
    "user-interface-components", "abstractFactoryBuilder", "src/main/resources/templates", "number_of_open_connections", "customerRelationshipManagement",
)


@dataclass(frozen=True)
class Model:
    """Ratios in thousandths for each pair of ASCII codes, and the least mean ratio of a secret."""

    ratios: tuple[int, ...]
    threshold: int


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def _pairs(codes: Column) -> Column:
    n = F.size(codes) - 1
    return F.when(n >= 1, F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * ALPHABET + b)).otherwise(F.array().cast("array<int>"))


def samples(spark: SparkSession, docs: DataFrame | None, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, random, held): labelled samples; ``held`` ones choose the threshold.

    Random strings are digests of counted seeds in five alphabets. Ordinary identifiers are the fixed ones, and words
    of the first ``rows`` documents by a hash of their ids, alone and joined as identifiers are. No more is read for
    them than those documents: it is the documented bound of this sample.
    """
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    forms = F.array(
        F.substring(digest, 1, 40),
        F.upper(F.substring(digest, 9, 32)),
        F.regexp_replace(raw, "=", ""),
        F.translate(F.regexp_replace(raw, "=", ""), "+/", "-_"),
        F.substring(F.regexp_replace(raw, "[+/=]", ""), 1, 32),
        F.substring(F.upper(F.regexp_replace(raw, "[+/=]", "")), 1, 24),
    )
    random = spark.range(rows).select(F.explode(forms).alias("value"), F.lit(True).alias("random"))
    fixed = spark.createDataFrame([(v,) for v in ORDINARY], "value string")
    ordinary = fixed
    if docs is not None:
        # ids alone are sorted; the texts of the first are then looked up, so no task gathers texts of all others
        texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        chosen = texts.select("id").where("id is not null").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(rows).distinct()
        first = texts.join(F.broadcast(chosen), "id").where("text is not null").dropDuplicates(["id"])
        words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w).between(2, 16))
        first = first.select(words.alias("w")).where(F.size("w") >= 6)
        at = F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)
        three = lambda i: [F.get("w", 3 * i), F.get("w", 3 * i + 1), F.get("w", 3 * i + 2)]
        joined = F.transform(
            at,
            lambda i: F.when(i % 4 == 0, F.concat_ws("_", *three(i)))
            .when(i % 4 == 1, F.concat_ws("-", *three(i)))
            .when(i % 4 == 2, F.concat(three(i)[0], F.initcap(three(i)[1]), F.initcap(three(i)[2]), (i % 7).cast("string")))
            .otherwise(F.concat_ws("_", *[F.upper(x) for x in three(i)])),
        )
        ordinary = fixed.unionByName(first.select(F.explode(F.concat(joined, F.col("w"))).alias("value")))
    both = random.unionByName(ordinary.distinct().withColumn("random", F.lit(False)))
    return stage(both.withColumn("held", F.pmod(F.xxhash64(F.lit(1), "value"), F.lit(5)) == 0), "secret-samples")


def train(labelled: DataFrame, false_share: float = 0.001) -> Model:
    """Count both models on the samples that aren't held, and choose the threshold on those that are.

    At most ``false_share`` of held ordinary identifiers of judged length pass. Without samples nothing passes.
    """
    pairs = labelled.where("not held").select("random", F.explode(_pairs(_codes(F.col("value")))).alias("pair"))
    counted = pairs.groupBy("random", "pair").count().collect()  # at most two tables of 128 x 128
    count: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in counted:
        count[r["random"]][r["pair"]] = r["count"]
    used = 65  # characters that runs hold
    logs: dict[bool, list[float]] = {}
    for kind, seen in count.items():
        row = [0] * ALPHABET
        for pair, n in seen.items():
            if 0 <= pair < ALPHABET * ALPHABET:
                row[pair // ALPHABET] += n
        logs[kind] = [math.log((seen.get(a * ALPHABET + b, 0) + 0.5) / (row[a] + 0.5 * used)) for a in range(ALPHABET) for b in range(ALPHABET)]
    ratios = tuple(round(1000 * (x - y)) for x, y in zip(logs[True], logs[False], strict=True))
    model = Model(ratios, 0)
    held = labelled.where(F.col("held") & (F.length("value") >= LEAST)).select("random", mean_ratio(F.col("value"), model).alias("r"))
    row = held.agg(
        F.expr(f"percentile(if(random, null, r), {1 - false_share})").alias("ordinary"), F.expr("percentile(if(random, r, null), 0.01)").alias("random")
    ).first()
    top, low = row["ordinary"], row["random"]
    if top is None or low is None:
        return Model(ratios, 1 << 30 if low is None else int(low))
    return Model(ratios, math.ceil(max(top + 1, (top + low) / 2)))


def mean_ratio(text: Column, model: Model) -> Column:
    """Whole thousandths of the mean log-likelihood ratio for each transition of an ASCII run."""
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<int>")
    total = F.aggregate(_pairs(_codes(text)), F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(F.get(table, p), F.lit(0)))
    return F.floor(total / F.greatest(F.length(text) - 1, F.lit(1)))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join, zero: Column) -> Column:
    """For each place of an array ``join`` over all values before it, and ``zero`` for the first.

    Blocks of about the cube root of the length are joined first, so that long arrays cost little more than their
    length: nothing grows by copies of itself.
    """
    fold = lambda part: F.aggregate(part, zero, join)
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def over(x: Column, n: Column, block: Column) -> Column:
        sums = F.transform(upto(F.ceil(n / block).cast("int")), lambda k: fold(F.slice(x, k * block + 1, block)))
        whole = lambda s: F.transform(upto(F.size(s)), lambda k: fold(F.slice(s, F.lit(1), k)))

        def at(w: Column) -> Column:
            return F.transform(upto(n), lambda i: F.aggregate(F.slice(x, i - i % block + 1, i % block), F.get(w, F.floor(i / block).cast("int")), join))

        return _with(sums, lambda s: _with(whole(s), at))

    size = lambda x: F.greatest(F.ceil(F.cbrt(2.0 * F.size(x))).cast("int"), F.lit(1))
    return _with(values, lambda x: F.when(F.size(x) > 0, _with(size(x), lambda block: over(x, F.size(x), block))).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """All matches as (start, rank, stop), code points, from what stands between them."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    length = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    steps = F.filter(F.zip_with(between, length, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def span(x: Column, at: Column) -> Column:
        return F.struct((at + x["b"]).alias("start"), F.lit(rank).alias("rank"), (at + x["b"] + x["m"]).alias("stop"))

    return _with(steps, lambda s: F.zip_with(s, _running(F.transform(s, lambda x: x["b"] + x["m"]), lambda acc, x: acc + x, F.lit(0)), span))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps. Runs are in order and apart from each other.

    As many base spans begin before a run's stop as end at or before its start: both are counted along sorted events.
    """

    def counted(at: Column, order: int, points: Column, other: int) -> Column:
        marks = F.transform(at, lambda x: F.struct(x.alias("at"), F.lit(order).alias("order"), F.lit(0).alias("one")))
        ones = F.transform(points, lambda x: F.struct(x.alias("at"), F.lit(other).alias("order"), F.lit(1).alias("one")))
        numbered = lambda e: F.zip_with(
            e, _running(F.transform(e, lambda x: x["one"]), lambda acc, x: acc + x, F.lit(0)), lambda x, n: F.struct(x["one"].alias("one"), n.alias("n"))
        )
        both = _with(F.sort_array(F.concat(marks, ones)), numbered)
        return F.transform(F.filter(both, lambda x: x["one"] == 0), lambda x: x["n"])

    begun = counted(F.transform(runs, lambda r: r["stop"]), 0, F.transform(base, lambda b: b["start"]), 1)
    ended = counted(F.transform(runs, lambda r: r["start"]), 1, F.transform(base, lambda b: b["stop"]), 0)
    return _chosen(runs, F.zip_with(begun, ended, lambda x, y: x == y))


def _texts(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _chosen(spans: Column, ok: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), ok.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


RESULT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]


def scan(docs: DataFrame, model: Model, text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_assign, n_access, n_hex, base_sha256, spans, n_random; with ``redact`` also
    ``redacted``, the text in which each span is replaced by ``[secret]``.

    Spans are kind:start:stop in code points, stop exclusive, by start and then kind. Runs that the models take for
    secrets are added where no fixed format holds them already. Null texts count as empty and have no spans; texts of
    any length are read whole. Rows are independent, so repeated rows get the same result. Result columns replace
    columns of the same names, all others stay. An empty table gives no rows.
    """
    own = {*RESULT, *(["redacted"] if redact else [])}
    names = [c for c in docs.columns if c not in own or c == text_col]
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    body = F.col("body")
    d = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")

    def found(kind: str, pattern: str, rank: int, ok: Column) -> Column:
        return F.when(body.rlike(GATES[kind]), _chosen(_spans(body, pattern, rank), ok)).otherwise(none)

    long_enough = lambda least: lambda m: F.length(m) >= least
    run = f"{RUN}{{{LEAST},}}"
    d = d.select(
        *inner.values(),
        "body",
        found("assign", ASSIGN, 0, F.transform(_texts(body, ASSIGN, 2), long_enough(8))).alias("assign"),
        found("access", "AKIA[A-Z0-9]{12,}", 1, F.transform(_texts(body, "AKIA[A-Z0-9]{12,}", 0), long_enough(16))).alias("access"),
        found("hex", "[0-9a-f]{32,}", 2, F.transform(_texts(body, "[0-9a-f]{32,}", 0), long_enough(32))).alias("hex"),
        found("random", run, 3, F.transform(_texts(body, run, 0), lambda m: mean_ratio(m, model) >= model.threshold)).alias("runs"),
    )
    base = F.sort_array(F.concat("assign", "access", "hex"))
    d = d.withColumn("base", F.when(F.size("assign") + F.size("access") + F.size("hex") == 0, none).otherwise(base))
    apart = _apart(F.col("runs"), F.col("base"))
    d = d.withColumn("more", F.when(F.size("runs") == 0, none).when(F.size("base") == 0, F.col("runs")).otherwise(apart))
    d = d.withColumn("all", F.when(F.size("more") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))))
    out = [F.col(a).alias(c) for c, a in inner.items()]
    out += [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    out += [F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), F.size("more").cast("long").alias("n_random")]
    if redact:
        out.append(F.when(F.size("all") == 0, body).otherwise(_redacted(body, F.col("all"))).alias("redacted"))
    return d.select(*out)


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced once."""
    covered = _running(F.transform(spans, lambda s: s["stop"]), lambda acc, x: F.greatest(acc, x), F.lit(0))
    both = F.zip_with(spans, covered, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at")))
    first = F.filter(both, lambda x: x["start"] >= x["at"])  # a stretch begins where all before it have ended
    parts = F.transform(first, lambda x: F.substring(text, x["at"] + 1, x["start"] - x["at"]))
    end = F.array_max(F.transform(spans, lambda s: s["stop"]))
    return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("[secret]"))), ""), F.substring(text, end + 1, F.length(text)))
