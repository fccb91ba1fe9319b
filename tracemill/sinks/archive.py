"""Compact archives of sessions: texts cut, inline binary dropped, usage kept whole; a zstd file of JSON lines a session."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# Fixed values of the format: bytes that a text and a tool's input or output keep, and the least run that is inline binary.
TEXT_MAX, TOOL_MAX, RUN = 16 * 1024, 2 * 1024, 256
_B = "[A-Za-z0-9+/=_-]"
_BINARY = f"(?<!{_B})(?={_B}*?[A-Z])(?={_B}*?[a-z])(?={_B}*?[0-9]){_B}{{{RUN},}}+"
#: Columns of an event in an archive.
FIELDS = ("id", "seq", "ts_ms", "kind", "text", "model", "call_id", "name", "args", "is_error", "synthetic", "input", "output", "cache_read", "cache_write", "reasoning", "reported")


def without_binary(text: Column) -> Column:
    """``text`` with runs of ``RUN`` or more base64 characters that have capitals, small letters and digits replaced by their length."""
    pieces, runs = F.split(text, _BINARY, -1), F.regexp_extract_all(text, F.lit(_BINARY), F.lit(0))
    told = F.transform(runs, lambda r: F.concat(F.lit("[binary omitted: "), F.length(r).cast("string"), F.lit(" bytes]")))
    joined = F.array_join(F.zip_with(pieces, F.concat(told, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(_BINARY), joined).otherwise(text)


def clip(text: Column, most: int) -> Column:
    """The longest start of ``text`` that has at most so many bytes in UTF-8 and ends with a whole character."""
    raw = F.encode(text, "UTF-8")
    inner = lambda i: F.hex(F.substring(raw, i, 1)).between("80", "BF")
    end = F.when(~inner(most + 1), most).when(~inner(most), most - 1).when(~inner(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) > most, F.decode(F.substring(raw, F.lit(1), end), "UTF-8")).otherwise(text)


def compacted(events: DataFrame) -> DataFrame:
    """Events with ``text`` and ``args`` as an archive keeps them, and ``truncated``: whether anything was cut or dropped.

    A call's arguments and a result keep TOOL_MAX bytes, other texts TEXT_MAX; a usage is kept as it is. Nulls stay null.
    """
    most = lambda c: F.when(F.col("kind") == "tool_result", clip(c, TOOL_MAX)).otherwise(clip(c, TEXT_MAX))
    short = events.withColumn("text_", most(without_binary(F.col("text"))))
    changed = F.coalesce(F.col("text_") != F.col("text"), F.lit(False))
    if "args" in events.columns:
        short = short.withColumn("args_", clip(without_binary(F.col("args")), TOOL_MAX))
        changed = changed | F.coalesce(F.col("args_") != F.col("args"), F.lit(False))
    out = short.withColumn("truncated", changed & (F.col("kind") != "usage")).withColumn("text", F.when(F.col("kind") == "usage", F.col("text")).otherwise(F.col("text_"))).drop("text_")
    return out.withColumn("args", F.col("args_")).drop("args_") if "args" in events.columns else out


def write(sessions: DataFrame, events: DataFrame, folder: str) -> None:
    """Writes ``<session>.jsonl.zst`` for every row of ``sessions`` (session and whatever tells about it): that row on the first line, then its events by position.

    A session's events meet in one task, as its file is one; other columns of events than FIELDS and ``truncated`` are left out.
    """
    kept = [c for c in (*FIELDS, "truncated") if c in events.columns]
    lines = events.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*kept)).alias("line")))), lambda x: x["line"]).alias("lines"))
    head = sessions.select("session", F.to_json(F.struct(*sessions.columns)).alias("head"))
    whole = head.join(lines, "session", "left").select("session", F.array_join(F.concat(F.array("head"), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("body"))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = [press.compress((b + "\n").encode("utf-8", "surrogatepass")) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(bodies, pa.binary())], names=["path", "content"])

    path = F.concat(F.regexp_replace("session", "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.substring(F.sha2("session", 256), 1, 8), F.lit(".jsonl.zst"))
    files.write(whole.select(path.alias("path"), "body").mapInArrow(pressed, "path string, content binary"), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(source, line, record) of the archives below ``folder``: line 0 tells of the session, the others are its events, all as JSON.

    A file's frames are read one after the other and its lines handed on as they come, so no file is held inflated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True), encoding="utf-8", errors="replace", newline="\n")
                numbered = enumerate(stream)
                while held := [x for _, x in zip(range(2000), numbered)]:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([line.rstrip("\n") for _, line in held])], names=["source", "line", "record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl.zst").load(folder).select("path", "content").mapInArrow(run, "source string, line bigint, record string")
