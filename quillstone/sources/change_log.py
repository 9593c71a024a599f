"""Stores of users, threads, steps, elements and feedback as logs of changes, written to several places at once.

A change sets some fields of an entity or deletes it; changes have numbers, and of two the greater one holds, field by
field. A snapshot is one aggregation over the log, and needs no order in which batches came. Deleting a thread deletes
what belongs to it. Batches of changes are commits (``sources.commits``), so a batch that is sent again changes nothing,
and other sessions see whole batches only. Compaction writes the snapshot as a base in place of the log up to then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import relational as R
from quillstone.sources.commits import Committed, remove

#: Fields of each kind; ``thread_id`` says what an entity belongs to. Fields beyond these are an error when written.
KINDS = {
    "users": ["identifier", "metadata", "created_at"],
    "threads": ["name", "user_id", "metadata", "tags", "created_at"],
    "steps": ["thread_id", "parent_id", "name", "type", "input", "output", "metadata", "created_at"],
    "elements": ["thread_id", "step_id", "name", "type", "url"],
    "feedback": ["thread_id", "step_id", "value", "comment"],
}
LOG = "kind string, id string, seq long, deleted boolean, fields map<string,string>"


def changes(rows: DataFrame, kind: str, key: str, seq: Column) -> DataFrame:
    """A log of rows that set fields: each column but ``key`` is a field, and one that is null isn't set."""
    fields = [c for c in rows.columns if c != key]
    unknown = sorted(set(fields) - set(KINDS[kind]))
    if unknown:
        raise ValueError(f"{kind} have no {', '.join(unknown)}")
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]), lambda e: e["value"].isNotNull())
    return rows.select(F.lit(kind).alias("kind"), F.col(f"`{key}`").cast("string").alias("id"), seq.cast("long").alias("seq"), F.lit(False).alias("deleted"), F.map_from_entries(entries).alias("fields"))


def deletions(rows: DataFrame, kind: str, key: str, seq: Column) -> DataFrame:
    """A log of rows whose entities are deleted."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    none = F.create_map().cast("map<string,string>")
    return rows.select(F.lit(kind).alias("kind"), F.col(f"`{key}`").cast("string").alias("id"), seq.cast("long").alias("seq"), F.lit(True).alias("deleted"), none.alias("fields"))


class Stores:
    """One store that counts, whose failures are errors, and others, whose failures are told and made up for later."""

    def __init__(self, spark: SparkSession, primary: str, others: tuple[str, ...] = ()):
        self.spark, self.primary, self.others = spark, primary, others
        self.failed: list[str] = []

    def write(self, name: str, log: DataFrame) -> bool:
        """Commit a batch of changes everywhere, under a name that is its own; False if the primary store has it."""
        new = Committed(self.spark, self.primary).append(name, log)
        for other in self.others:
            try:
                Committed(self.spark, other).append(name, log)
            except Exception as e:
                self.failed.append(f"{other}: {type(e).__name__}")
        return new

    def log(self, store: str | None = None) -> DataFrame:
        return _log(self.spark, store or self.primary)

    def table(self, kind: str, store: str | None = None) -> DataFrame:
        """The entities of a kind as they are now: id and the kind's fields, null where never set."""
        return snapshot(self.log(store), kind)

    def get(self, kind: str, key: str) -> DataFrame:
        """One entity, or no row: the key reaches the scan of the log, and so does its thread's."""
        log = self.log()
        own = latest(log.where((F.col("kind") == kind) & (F.col("id") == key)), kind)
        return own if "thread_id" not in KINDS[kind] else _without_deleted_threads(own, log)

    def list_threads(self, user_id: str | None = None, search: str | None = None, page: int = 1, size: int = 25) -> tuple[DataFrame, int]:
        """A page of threads, those that were made last first, of a user or with a word in their names, and how many pages there are."""
        rows = self.table("threads")
        if user_id is not None:
            rows = rows.where(F.col("user_id") == user_id)
        if search:
            rows = rows.where(F.contains(F.lower("name"), F.lit(search.lower())))
        return R.page(rows, [F.desc("created_at"), "id"], page, size)

    def thread_author(self, thread_id: str) -> DataFrame:
        """The identifier of a thread's user."""
        users = self.table("users").select(F.col("id").alias("user_id"), "identifier")
        return self.get("threads", thread_id).join(users, "user_id").select("identifier")


def _log(spark: SparkSession, store: str) -> DataFrame:
    """Commits behind the latest base, and that base."""
    table = Committed(spark, store)
    names = table.names()
    bases = [n for n in names if n.startswith("base-")]
    if bases:
        gone = set(table.get(bases[-1])["holds"])
        names = [n for n in names if n not in gone and not n.startswith("base-")] + bases[-1:]
    places = table.places(names)
    return spark.read.schema(LOG).parquet(*places) if places else spark.createDataFrame([], LOG)


def latest(log: DataFrame, kind: str) -> DataFrame:
    """The entities of a log: for each field the value of the greatest number after the entity was deleted last.

    One aggregation with partial sums, whatever number of changes an entity has. Changes with the same number: the
    greater value holds, and a deletion counts after them.
    """
    changed = F.max(F.when(~F.col("deleted"), F.col("seq"))).alias("_changed")
    gone = F.max(F.when(F.col("deleted"), F.col("seq"))).alias("_gone")
    value = lambda f: F.col("fields")[f]
    found = [F.max(F.when(value(f).isNotNull(), F.struct("seq", value(f).alias("value")))).alias(f) for f in KINDS[kind]]
    rows = log.where(F.col("kind") == kind).groupBy("id").agg(changed, gone, *found)
    rows = rows.where(F.col("_changed") > F.coalesce("_gone", F.col("_changed") - 1))
    after = lambda f: F.when(F.col(f)["seq"] > F.coalesce("_gone", F.col(f)["seq"] - 1), F.col(f)["value"]).alias(f)
    return rows.select("id", *[after(f) for f in KINDS[kind]])


def _without_deleted_threads(rows: DataFrame, log: DataFrame) -> DataFrame:
    """What belongs to a thread goes with it, also if the thread is made anew later."""
    dead = log.where((F.col("kind") == "threads") & F.col("deleted")).select(F.col("id").alias("thread_id")).distinct()
    return rows.join(dead, "thread_id", "left_anti").select(rows.columns)


def snapshot(log: DataFrame, kind: str) -> DataFrame:
    """The entities of a kind, those of deleted threads apart."""
    rows = latest(log, kind)
    return _without_deleted_threads(rows, log) if "thread_id" in KINDS[kind] else rows


def compact(spark: SparkSession, store: str) -> int:
    """The log so far as one base: a change for each field that still holds, and deletions; how many commits it replaces.

    Numbers stay those of the changes, so that late ones with smaller numbers still lose. Commits that come meanwhile
    stay beside the base. Data of the replaced commits is removed by ``clean``, once nobody reads it.
    """
    table = Committed(spark, store)
    holds = table.names()
    if not holds:
        return 0
    log = _log(spark, store)
    fields = log.where(~F.col("deleted")).select("kind", "id", "seq", F.explode_outer("fields").alias("field", "value"))
    kept = fields.groupBy("kind", "id", "field").agg(F.max(F.struct("seq", "value")).alias("x"))
    entry = F.when(F.col("field").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map("field", "x.value"))
    set_ = kept.select("kind", "id", F.col("x.seq").alias("seq"), F.lit(False).alias("deleted"), entry.alias("fields"))
    gone = log.where("deleted").groupBy("kind", "id").agg(F.max("seq").alias("seq")).select("kind", "id", "seq", F.lit(True).alias("deleted"), F.create_map().cast("map<string,string>").alias("fields"))
    base = set_.unionByName(gone)

    def write(place: str) -> dict:
        base.write.parquet(place)
        return {"holds": holds}

    number = 1 + max([int(n.split("-")[1]) for n in holds if n.startswith("base-")], default=0)
    table.add(f"base-{number:012d}", write)
    return len(holds)


def clean(spark: SparkSession, store: str) -> None:
    """Remove the data of commits that the latest base holds; their names stay, so that they aren't taken again."""
    table = Committed(spark, store)
    bases = [n for n in table.names() if n.startswith("base-")]
    for name in table.get(bases[-1])["holds"] if bases else []:
        remove(spark, table.get(name)["place"])
