"""Records of checks, documents and jobs: keys, reuse, ingestion, upserts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a record cannot be found after a crash.
UNFINISHED = ("queued", "running")


def text_key(text: Column) -> Column:
    """Digest of a text without blanks at its ends."""
    return F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256)


def params_key(options: Column) -> Column:
    """Digest of check options (JSON): the four that change a result, keys in order, defaults where one is missing."""
    o = F.from_json(options, "mode STRING, strip_references BOOLEAN, web_check BOOLEAN, web_check_count INT")
    part = lambda name, c: F.concat(F.lit(f'"{name}": '), c)
    flag = lambda name, default: F.coalesce(o[name], F.lit(default)).cast("string")
    parts = [
        part("mode", F.concat(F.lit('"'), F.coalesce(o["mode"], F.lit("full")), F.lit('"'))),
        part("strip_references", flag("strip_references", True)),
        part("web_check", flag("web_check", False)),
        part("web_check_count", F.coalesce(o["web_check_count"], F.lit(10)).cast("string")),
    ]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; rows leave the map side one per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def report_reuse(submitted: DataFrame, done: DataFrame) -> DataFrame:
    """(id, reused_id): the latest finished check with the same text and parameters, for every other check."""
    best = done.where("status = 'done'").groupBy("doc_hash", "params_hash").agg(F.max_by("id", F.struct("finished_at", "id")).alias("reused_id"))
    return submitted.select("id", "doc_hash", "params_hash").distinct().join(best, ["doc_hash", "params_hash"]).where("id <> reused_id").select("id", "reused_id")


def title_key(title: Column) -> Column:
    return F.substring(F.trim(title), 1, 200)


def ingest(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Incoming documents (doc_id, title, ...) whose title, cut to 200 characters, is new; the first of each title stays."""
    known = library.select(title_key(F.col("title")).alias("key")).distinct()
    fresh = incoming.withColumn("key", title_key(F.col("title"))).where(F.length("key") > 0).join(known, "key", "left_anti")
    return latest(fresh, ["key"], [F.col("doc_id")]).drop("key")


def harvest(incoming: DataFrame, library: DataFrame, target: int, most_known: int = 800) -> DataFrame:
    """(source, fetched, added): how far each source's documents (source, doc_id, title) are read, in order of id.

    A title known to the library, or met before in the source, is not added.
    Reading ends with the ``target``-th document, or with the one after
    ``most_known`` known titles: so at most ``target`` rows of a source are looked at.
    """
    by = Window.partitionBy("source").orderBy("doc_id")
    first = incoming.select("source", "doc_id", title_key(F.col("title")).alias("key")).where(F.length("key") > 0)
    first = first.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= target)
    known = library.select(title_key(F.col("title")).alias("key")).distinct().withColumn("held", F.lit(True))
    once = F.row_number().over(Window.partitionBy("source", "key").orderBy("nth"))
    rows = first.join(known, "key", "left").withColumn("new", (F.col("held").isNull() & (once == 1)).cast("int"))
    rows = rows.withColumn("added", F.sum("new").over(Window.partitionBy("source").orderBy("nth")))
    # the row that brings more known titles than allowed is the last one read
    read = rows.where(F.col("nth") - F.col("added") - (1 - F.col("new")) <= most_known)
    return read.groupBy("source").agg(F.count("*").alias("fetched"), F.sum("new").alias("added"))


def error_tail(messages: Column) -> Column:
    """The last two messages of an array, at most 400 characters."""
    last = F.when(F.size(messages) > 2, F.slice(messages, -2, 2)).otherwise(messages)
    return F.substring(F.array_join(last, "; "), 1, 400)


def library_part(is_builtin: Column) -> Column:
    """The part of a library listing that a document stands in."""
    return F.when(is_builtin == 1, "builtin").otherwise("user")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the newest per key; on equal versions the change wins."""
    both = table.withColumn("new_", F.lit(0)).unionByName(changes.withColumn("new_", F.lit(1)))
    return latest(both, keys, [F.desc_nulls_last(version), F.desc("new_")]).drop("new_")


def delete_user_documents(library: DataFrame, ids: DataFrame) -> DataFrame:
    """The library without the listed documents; builtin ones stay."""
    return library.join(ids.withColumn("gone_", F.lit(True)), "doc_id", "left").where("gone_ IS NULL OR is_builtin = 1").drop("gone_")


def recover_interrupted(checks: DataFrame) -> DataFrame:
    """Checks that were under way are set to error."""
    lost = F.col("status").isin(*UNFINISHED)
    return checks.withColumn("error", F.when(lost, F.coalesce("error", F.lit("interrupted"))).otherwise(F.col("error"))).withColumn("status", F.when(lost, "error").otherwise(F.col("status")))


def purge(checks: DataFrame, now: Column, days: int) -> DataFrame:
    """Checks created within ``days`` before ``now``, and those still under way; 0 days keeps all."""
    if days <= 0:
        return checks
    return checks.where((F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")) | F.col("status").isin(*UNFINISHED))


def rebuild_abstract(inverted: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, index: MAP<word, ARRAY<position>>): the words in order of their positions."""
    each = inverted.select("doc_id", F.explode("index").alias("word", "places")).select("doc_id", "word", F.explode("places").alias("place"))
    # the words of one abstract
    words = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return words.select("doc_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def audit_line(ts: Column, event: Column, title: Column) -> Column:
    """One JSON line of the audit log: titles cut to 40 characters, nulls left out."""
    return F.to_json(F.struct(ts.alias("ts"), event.alias("event"), F.substring(title, 1, 40).alias("title")))
