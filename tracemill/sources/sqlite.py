"""Tables of SQLite databases as a source: every column as text, a partition a database and range of rows.

Databases are opened read-only. One in a store without local files is read into the task's memory whole, so ranges are cut
only where a file can be opened in place. A range's bounds are found by the task that reads it, so nothing is opened to plan.
"""

from __future__ import annotations

import fnmatch
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "tracemill_sqlite"
#: Bytes of a database's file that one task reads, and rows it hands over at once.
PIECE, ROWS = 64 << 20, 2000


@dataclass
class Range(InputPartition):
    """The ``part``-th of ``of`` equal ranges of the rows of the database at ``value``."""

    value: str
    part: int
    of: int


def _text(v: object) -> str | None:
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else repr(v) if isinstance(v, float) else str(v)


def opened(store: pafs.FileSystem, path: str) -> sqlite3.Connection:
    if isinstance(store, pafs.LocalFileSystem):
        con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=5)
    else:
        con = sqlite3.connect(":memory:")
        with store.open_input_file(path) as f:
            con.deserialize(f.read())
    con.text_factory = bytes
    return con


def rows_of(con: sqlite3.Connection, table: str, columns: list[str], part: int, of: int) -> Iterator[tuple]:
    """(rowid, column...) of the range's rows; a column or table that the database does not have gives nulls or no rows.

    A table without row ids is read by the first range alone, its rows numbered as they come.
    """
    name = '"' + table.replace('"', '""') + '"'
    there = {r[0].decode() for r in con.execute(f"SELECT name FROM pragma_table_info({name})")}
    if not there:
        return
    wanted = ", ".join('"' + c.replace('"', '""') + '"' if c in there else "NULL" for c in columns)
    try:
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
    except sqlite3.OperationalError:
        if part == 0:
            for n, row in enumerate(con.execute(f"SELECT {wanted} FROM {name}"), 1):
                yield (n, *row)
        return
    if low is None:
        return
    cut = lambda k: low + (high - low + 1) * k // of
    yield from con.execute(f"SELECT rowid, {wanted} FROM {name} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (cut(part), cut(part + 1))) if part + 1 < of else con.execute(f"SELECT rowid, {wanted} FROM {name} WHERE rowid >= ? ORDER BY rowid", (cut(part),))


class TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.table = options["path"], options.get("glob", "*.db"), options["table"]
        self.columns, self.piece = options["columns"].split(","), int(options.get("piece", PIECE))

    def partitions(self) -> list[Range]:
        store, root = pafs.FileSystem.from_uri(self.uri)
        local, out = isinstance(store, pafs.LocalFileSystem), []
        for info in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == pafs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                of = -(-info.size // self.piece) if local and info.size else 1
                out += [Range(info.path, k, of) for k in range(of)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no databases
            return
        store, _ = pafs.FileSystem.from_uri(self.uri)
        names = ["source", "row", *self.columns]
        with closing(opened(store, partition.value)) as con:
            rows = rows_of(con, self.table, self.columns, partition.part, partition.of)
            while held := [r for _, r in zip(range(ROWS), rows)]:
                columns = list(zip(*held))
                arrays = [pa.array([partition.value] * len(held)), pa.array(columns[0], pa.int64()), *(pa.array([_text(v) for v in c], pa.string()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


class Tables(DataSource):
    """Options: ``path`` (a URI of a folder), ``glob``, ``table``, ``columns`` (by comma), ``piece`` (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source string, row bigint, " + ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options)


def scan(spark: SparkSession, path: str, table: str, columns: list[str], glob: str = "*.db", piece: int = PIECE) -> DataFrame:
    """(source, row, columns...) of ``table`` in every database below ``path``: the file, the row id, and texts."""
    spark.dataSource.register(Tables)
    return spark.read.format(FORMAT).option("path", path).option("table", table).option("columns", ",".join(columns)).option("glob", glob).option("piece", piece).load()
