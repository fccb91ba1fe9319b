"""Transcript files as numbered JSON records, and the shape that every decoder gives its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import preview

#: Columns of an event beside its session, number and directory. Rows of kind 'meta' tell about the session only.
FIELDS = {
    "id": "string", "ts_ms": "bigint", "kind": "string", "text": "string", "model": "string", "call_id": "string", "name": "string", "args": "string", "is_error": "boolean", "synthetic": "boolean", "partial": "boolean",
    "input": "bigint", "output": "bigint", "cache_read": "bigint", "cache_write": "bigint", "reasoning": "bigint", "reported": "double", "title": "string", "rank": "int", "parent_of": "string", "started": "bigint",
}
#: A record gives at most 2^PER events.
PER = 20
TITLE, PREVIEW = 120, 160


def records(lines: DataFrame) -> DataFrame:
    """(session, parent, n, v): the records of (session, parent, at, line), ``n`` counted in the order of ``at``.

    Broken lines, empty ones and nulls give no record but keep their number. One shuffle by session, which the ledger's
    windows use again.
    """
    order = Window.partitionBy("session").orderBy("at")
    return lines.withColumn("n", F.row_number().over(order).cast("bigint")).select("session", "parent", "n", F.expr("try_parse_json(line)").alias("v")).where("v is not null")


#: Fixed values of the formats: a file's name without its last suffix, and the name after a time.
STEM, TIMED = r"([^/]+?)(?:\.[^./]*)?$", "^[^_]{4}-[^_]*_(.+)$"


def scan(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(session, parent, at, line) of the JSONL files below ``path``; the session is the whole path until ``named`` names it.

    A file below ``<id>/subagents/`` has the parent ``<id>``. Files are split as Spark splits them; ``at`` is the split's
    start and the row's place in it, so a session's order does not depend on how many tasks read it.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    file = F.col("_metadata.file_path")
    return read.select(file.alias("session"), folder_parent(file).alias("parent"), at.alias("at"), F.col("value").alias("line"))


def whole(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(session, parent, at, line) of files that are one JSON value each; the session is the whole path until ``named`` names it."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("session"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("at"), F.col("value").alias("line"))


def folder_parent(file: Column) -> Column:
    """The folder above the first one called subagents, null where there is none."""
    return F.nullif(F.regexp_extract(file, "^(?:.*?/)?([^/]+)/subagents/", 1), F.lit(""))


def after_time(name: Column) -> Column:
    """What follows the time in a name like ``2024-01-31T10-20-30-400Z_x``; null for other names."""
    time = F.substring_index(name, "_", 1)
    return F.when((F.length(time) >= 20) & F.contains(time, F.lit("T")), F.nullif(F.regexp_extract(name, TIMED, 1), F.lit("")))


def named(events: DataFrame, harness: str, projects: DataFrame | None = None) -> DataFrame:
    """Events of scanned files with ``source``, the file's path, and with session and parent named as the harness does.

    claude and gemini: the file's stem; codex: its last 36 characters; pi: what follows the time in the stem, the parent
    what follows it in the nearest folder named so, and ``<parent>.<stem>`` where only the folder is. Several sources can
    have one name: positions hold within a source, so the ledger is kept by source and brought together by
    ``ledger.combined``. ``projects`` (name, path) gives gemini sessions the directory their project folder stands for.
    """
    stem, parent = F.regexp_extract("source", STEM, 1), F.col("parent")
    rows = events.withColumnRenamed("session", "source")
    if harness == "codex":
        stem = F.substring(stem, -36, 36)
    elif harness == "pi":
        folders = F.reverse(F.slice(F.split("source", "/"), 1, F.size(F.split("source", "/")) - 1))
        parent = F.element_at(F.concat(F.filter(F.transform(folders, after_time), lambda f: f.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
        stem = F.coalesce(after_time(stem), F.when(parent.isNotNull(), F.concat(parent, F.lit("."), stem)), stem)
    elif harness == "gemini" and projects is not None:
        known = projects.groupBy(F.col("name").alias("project")).agg(F.min("path").alias("path"))
        rows = rows.withColumn("project", F.regexp_extract("source", "([^/]+)/chats/[^/]+$", 1)).join(known, "project", "left")
        rows = rows.withColumn("cwd", F.coalesce("cwd", "path")).drop("project", "path")
    return rows.select(stem.alias("session"), "source", parent.alias("parent"), *[c for c in rows.columns if c not in ("session", "source", "parent")])


def parent_calls(spark: SparkSession, path: str) -> DataFrame:
    """(source, parent_call) of sub-agent files that have a ``.meta.json`` beside them naming the call that started them."""
    metas = whole(spark, path, "*.meta.json")
    call = F.expr(filled("try_parse_json(line)", "toolUseId"))
    return metas.select(F.regexp_replace("session", r"\.meta\.json$", ".jsonl").alias("source"), call.alias("parent_call")).where("parent_call is not null")


def get(v: str, path: str, kind: str = "string") -> str:
    """SQL for a part of a record, null where it is missing or of another kind."""
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def filled(v: str, path: str) -> str:
    """SQL for a string that is not empty."""
    return f"nullif({get(v, path)}, '')"


def count(v: str, path: str) -> str:
    return f"greatest(coalesce({get(v, path, 'bigint')}, 0L), 0L)"


def items(v: str, path: str) -> str:
    """SQL for the elements of an array, none where it is not one."""
    return f"coalesce({get(v, path, 'array<variant>')}, cast(array() as array<variant>))"


def time(v: str, path: str = "timestamp") -> str:
    """SQL for epoch milliseconds of an RFC 3339 string (UTC where it names no zone) or of a number of seconds or milliseconds; else 0."""
    number, text = get(v, path, "double"), get(v, path)
    zoned = f"if({text} rlike '(Z|[+-][0-9][0-9]:?[0-9][0-9])$', {text}, concat({text}, 'Z'))"
    instant = f"if({text} rlike '^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9][T ][0-9][0-9]:', unix_millis(try_cast({zoned} as timestamp)), null)"
    return f"coalesce(cast(if({number} > 1e11, {number}, {number} * 1000) as bigint), {instant}, 0L)"


def is_kind(v: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({v}) like '{kind}%', false)"


def text_of(v: str, depth: int = 2) -> str:
    """SQL for the text of a content value: a string itself, or the texts of its blocks by line; other blocks as [type]."""
    b = f"b{depth}_"
    inner = text_of(f"try_variant_get({b}, '$.content', 'variant')", depth - 1) if depth else get(b, "content")
    has_content = f"try_variant_get({b}, '$.content', 'variant') is not null"
    piece = f"case when {is_kind(b, 'STRING')} then try_variant_get({b}, '$', 'string') when {is_kind(b, 'OBJECT')} then coalesce({get(b, 'text')}, if({has_content}, {inner}, concat('[', {get(b, 'type')}, ']'))) end"
    blocks = f"try_variant_get({v}, '$', 'array<variant>')"
    return f"coalesce(if({is_kind(v, 'ARRAY')}, array_join(filter(transform({blocks}, {b} -> {piece}), p_ -> p_ <> ''), '\\n'), try_variant_get({v}, '$', 'string')), '')"


def event(**fields: str) -> str:
    """SQL for one event; fields that are not given are null, the time is ``t``."""
    given = {"ts_ms": "t", **fields}
    return "named_struct(" + ", ".join(f"'{c}', cast({given.get(c, 'null')} as {k})" for c, k in FIELDS.items()) + ")"


def when(condition: str, *events: str) -> str:
    """SQL for an array of events, each null where the condition does not hold."""
    return "array(" + ", ".join(f"if({condition}, {e}, null)" for e in events) + ")"


def emitted(rows: DataFrame, *arrays: str, cwd: str = "cwd") -> DataFrame:
    """The events of ``arrays`` (SQL, arrays of events with nulls between) of each record, in order: session, parent, seq, cwd and FIELDS."""
    each = rows.select("session", "parent", "n", F.expr(cwd).alias("cwd"), F.posexplode(F.expr(f"concat({', '.join(arrays)})")).alias("k", "e")).where("e is not null")
    return each.select("session", "parent", (F.shiftleft("n", PER) + F.col("k")).alias("seq"), "cwd", *[F.col(f"e.{c}").alias(c) for c in FIELDS])


def sessions(events: DataFrame) -> DataFrame:
    """One row a session: parent, directory and model named last, the best and then latest title, times, and the first prompt's preview.

    Times of 0 are unknown. A session of meta rows only has no times.
    """
    own = events.withColumn("title", preview(F.col("title"), TITLE)).withColumn("asked", F.when((F.col("kind") == "user_message") & ~F.coalesce("synthetic", F.lit(False)), preview(F.col("text"), PREVIEW)))
    at = "if(kind <> 'meta' and ts_ms > 0, ts_ms, null)"
    return own.groupBy("session").agg(
        F.coalesce(F.max("parent_of"), F.max("parent")).alias("parent"), F.expr("max_by(cwd, seq) filter (where cwd is not null)").alias("cwd"), F.expr("max_by(model, seq) filter (where model is not null)").alias("model"),
        F.expr("max_by(title, struct(rank, seq)) filter (where title <> '')").alias("title"), F.expr("min_by(asked, seq) filter (where asked <> '')").alias("preview"),
        F.coalesce(F.min("started"), F.expr(f"min_by({at}, seq) filter (where {at} is not null)")).alias("started_at"), F.expr(f"max({at})").alias("updated_at"),
        F.count_if(F.col("kind") != "meta").alias("n_events"))
