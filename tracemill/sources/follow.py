"""Following transcript files: a source of their lines that a stream or a batch reads, and the table a stream keeps of them.

A micro-batch ends at a manifest: the size of every file under the folder when it was planned. A line belongs to the batch
in which its line end stands, so an unfinished last line waits for the rest of it, and pieces of one file can be read by
several tasks without knowing of each other. A file that is shorter than before, or whose bytes at either end of what was
read are others, has been rewritten: it starts again as the next generation. Files may be added, grow and go at any time.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "tracemill_lines"
SCHEMA = "source string, generation bigint, kind string, at bigint, line string"
ARROW = pa.schema([("source", pa.string()), ("generation", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("line", pa.string())])
#: Bytes that one task reads, that are looked through at once for a line's begin, and that tell a rewritten file at either end.
PIECE, BACK, HEAD, TAIL = 64 << 20, 1 << 16, 256, 64
#: Tasks that pieces are dealt to where there are more of them: small pieces of a large store share tasks.
TASKS = 1000
#: Rows of a batch that a task hands over.
ROWS = 5000


@dataclass
class Pieces(InputPartition):
    """What one task reads: (path, generation, kind, from, to) each."""

    value: list[tuple[str, int, str, int, int]]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def sha(f, low: int, high: int) -> str:
    f.seek(low)
    return hashlib.sha1(f.read(max(0, high - low))).hexdigest()


def ends_of(store: pafs.FileSystem, path: str, size: int) -> str:
    """A fingerprint of the first and the last bytes of the first ``size`` ones."""
    with store.open_input_file(path) as f:
        return sha(f, 0, min(HEAD, size)) + sha(f, max(0, size - TAIL), size)


def planned(store: pafs.FileSystem, root: str, glob: str, old: dict) -> dict:
    """The manifest of now, given the one before: path -> [size, time, generation, ends, gone]. Only changed files are opened."""
    found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    new = {}
    for info in found:
        if info.type != pafs.FileType.File or not fnmatch.fnmatch(info.base_name, glob):
            continue
        was, size, time = old.get(info.path), info.size, info.mtime_ns or 0
        if was and not was[4] and was[:2] == [size, time]:
            new[info.path] = was
            continue
        generation = was[2] if was else 0
        if was and (was[4] or size < was[0] or ends_of(store, info.path, was[0]) != was[3]):
            generation += 1
        new[info.path] = [size, time, generation, ends_of(store, info.path, size), False]
    for path, was in old.items():
        if path not in new:
            new[path] = [0, 0, was[2], "", True]
    return new


def pieces(old: dict, new: dict, most: int) -> list[Pieces]:
    """What stands in ``new`` and not in ``old``, cut to parts of ``most`` bytes and put together where they are small or more than ``TASKS``."""
    parts = []
    for path, (size, _, generation, _, gone) in sorted(new.items()):
        was = old.get(path)
        if gone:
            if was and not was[4]:
                parts.append((path, generation, "removed", 0, 0))
            continue
        begin = was[0] if was and was[2] == generation else 0
        if was and was[2] != generation:
            parts.append((path, generation, "reset", 0, 0))
        parts += [(path, generation, "line", low, min(size, low + most)) for low in range(begin, size, most)]
    share = max(most, sum(p[4] - p[3] for p in parts) // TASKS)
    out, held = [], 0
    for p in parts:
        if not out or held + p[4] - p[3] > share or len(out[-1].value) >= 10_000:
            out.append(Pieces([]))
            held = 0
        out[-1].value.append(p)
        held += p[4] - p[3]
    return out


def lines_between(f, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of every line of an open file whose line end stands in [low, high)."""
    f.seek(low)
    data, begin = f.read(high - low), low
    stop = data.rfind(b"\n")
    if stop < 0:
        return
    data, cut = data[: stop + 1], -1
    while begin > 0 and cut < 0:
        step = min(BACK, begin)
        f.seek(begin - step)
        before = f.read(step)
        cut = before.rfind(b"\n")
        data = before[cut + 1 :] + data
        begin -= step - (cut + 1)
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        yield begin + at, data[at:end].removesuffix(b"\r")
        at = end + 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def read_pieces(uri: str, part: Pieces | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # no files
        return
    store, _ = _open(uri)
    rows: list[tuple] = []
    for path, generation, kind, low, high in part.value:
        if kind != "line":
            rows.append((path, generation, kind, -1, None))
            continue
        with store.open_input_file(path) as f:
            for at, line in lines_between(f, low, high):
                rows.append((path, generation, kind, at, line.decode("utf-8", "replace")))
                if len(rows) >= ROWS:
                    yield _rows(rows)
                    rows = []
    if rows:
        yield _rows(rows)


class LineStream(DataSourceStreamReader):
    """Offsets are numbers of manifests, which are files in the folder ``manifests``; a manifest is written before Spark logs its number."""

    def __init__(self, options: dict):
        self.uri, self.glob, self.most = options["path"], options.get("glob", "*.jsonl"), int(options.get("piece", PIECE))
        self.manifests = options["manifests"]

    def _manifest(self, number: int) -> dict:
        if not number:
            return {}
        store, root = _open(self.manifests)
        with store.open_input_stream(f"{root}/{number}.json.gz") as f:
            return json.loads(f.read())

    def _newest(self) -> int:
        store, root = _open(self.manifests)
        names = (i.base_name for i in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)))
        return max((int(n.removesuffix(".json.gz")) for n in names if n.endswith(".json.gz") and n[0].isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        last = self._newest()
        old = self._manifest(last)
        store, root = _open(self.uri)
        new = planned(store, root, self.glob, old)
        if new == old:
            return {"manifest": last}
        out, folder = _open(self.manifests)
        out.create_dir(folder, recursive=True)
        with out.open_output_stream(f"{folder}/writing.json.gz") as f:
            f.write(json.dumps(new).encode())
        out.move(f"{folder}/writing.json.gz", f"{folder}/{last + 1}.json.gz")
        return {"manifest": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return pieces(self._manifest(start["manifest"]), self._manifest(end["manifest"]), self.most)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return read_pieces(self.uri, partition)

    def commit(self, end: dict) -> None:
        store, root = _open(self.manifests)
        for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            name = info.base_name.removesuffix(".json.gz")
            if name.isdigit() and int(name) < end["manifest"]:
                store.delete_file(info.path)


class LineBatch(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.most = options["path"], options.get("glob", "*.jsonl"), int(options.get("piece", PIECE))

    def partitions(self) -> list[Pieces]:
        store, root = _open(self.uri)
        return pieces({}, planned(store, root, self.glob, {}), self.most)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return read_pieces(self.uri, partition)


class Lines(DataSource):
    """Options: ``path`` (a URI), ``glob``, ``piece`` (bytes a task), and for streams ``manifests`` (a URI of a shared folder of this stream's own)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineStream(self.options)


def _found(spark: SparkSession, streaming: bool, path: str, glob: str, piece: int, **more: str) -> DataFrame:
    spark.dataSource.register(Lines)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).option("path", path).option("glob", glob).option("piece", piece)
    return reader.options(**more).load()


def batch(spark: SparkSession, path: str, glob: str = "*.jsonl", piece: int = PIECE) -> DataFrame:
    """All finished lines of now (SCHEMA)."""
    return _found(spark, False, path, glob, piece)


def stream(spark: SparkSession, path: str, manifests: str, glob: str = "*.jsonl", piece: int = PIECE) -> DataFrame:
    """Lines as they are written (SCHEMA): kind 'line'; 'reset' before the lines of a rewritten file, 'removed' for a file that is gone."""
    return _found(spark, True, path, glob, piece, manifests=manifests)


def keep(lines: DataFrame, folder: str, checkpoint: str):
    """Starts a query that writes every micro-batch of ``stream`` to ``folder`` once, and ends when nothing is left to read.

    A micro-batch that is written again after a failure replaces itself.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """(source, at, line) of what ``keep`` wrote, as a batch reading of the files would give it: the last generation of each file that is still there."""
    rows = spark.read.schema(SCHEMA + ", batch bigint").parquet(folder)
    last = rows.groupBy("source").agg(F.max(F.struct("generation", F.col("kind") == "removed")).alias("top"))
    alive = last.where("not top.col2").select("source", F.col("top.generation").alias("generation"))
    return rows.where("kind = 'line'").join(alive, ["source", "generation"]).select("source", "at", "line")
