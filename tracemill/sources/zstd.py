"""Transcripts that are written as one zstd frame after the other: frames are dealt out, each read by one task.

A frame's end follows from the sizes in front of its blocks, so a task steps from frame to frame without inflating those of
others. A last frame that is cut off is still being written and waits.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "tracemill_zstd"
SCHEMA = "source string, frame bigint, n bigint, line string"
#: Compressed bytes of a file that one task reads, and rows it hands over at once.
PIECE, ROWS = 32 << 20, 2000
#: Tasks from which on pieces are put together, up to PIECE bytes a task.
TASKS = 1000
# Fixed values of the format: what a frame begins with, and what one begins with that holds no data.
MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A50


@dataclass
class Ranges(InputPartition):
    """What one task reads: the frames of each (path, low, high) that begin in [low, high)."""

    value: list[tuple[str, int, int]]


def dealt(sizes: list[tuple[str, int]], piece: int) -> list[Ranges]:
    """Files cut to ranges of ``piece`` bytes, put together where more than ``TASKS`` tasks would come of it; ranges of one file that meet become one."""
    most, out, held = max(piece, min(PIECE, -(-sum(n for _, n in sizes) // TASKS))), [], 0
    for path, size in sorted(sizes):
        for low in range(0, size, piece):
            high = min(size, low + piece)
            if not out or held + high - low > most:
                out.append(Ranges([]))
                held = 0
            own = out[-1].value
            if own and own[-1][0] == path:
                own[-1] = (path, own[-1][1], high)
            else:
                own.append((path, low, high))
            held += high - low
    return out


def frame_end(f, at: int, size: int) -> tuple[int, bool] | None:
    """(where the frame at ``at`` ends, whether it has data), or nothing if the file ends before."""

    def part(place: int, n: int) -> bytes | None:
        if place + n > size:
            return None
        f.seek(place)
        return f.read(n)

    head = part(at, 8) if at + 8 <= size else None
    if head is None:
        return None
    magic, length = struct.unpack("<II", head)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        return (at + 8 + length, False) if at + 8 + length <= size else None
    if magic != MAGIC:
        raise ValueError(f"no frame begins at byte {at}")
    flags = head[4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while (block := part(at, 3)) is not None:
        header = int.from_bytes(block, "little")
        # A block of one repeated byte has that byte alone.
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            at += 4 * (flags >> 2 & 1)
            return (at, True) if at <= size else None
    return None


def frames(f, size: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the finished frames with data that begin in [low, high)."""
    at = 0
    while at < min(high, size) and (found := frame_end(f, at, size)):
        end, full = found
        if full and at >= low:
            f.seek(at)
            yield at, f.read(end - at)
        at = end


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.piece = options["path"], options.get("glob", "*.zst*"), int(options.get("piece", PIECE))

    def partitions(self) -> list[Ranges]:
        store, root = pafs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return dealt([(i.path, i.size) for i in found if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)], self.piece)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = pafs.FileSystem.from_uri(self.uri)
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["source", "frame", "n", "line"])
        press = zstandard.ZstdDecompressor()
        for path, low, high in partition.value:
            with store.open_input_file(path) as f:
                for at, frame in frames(f, f.size(), low, high):
                    body = press.decompressobj().decompress(frame).decode("utf-8", "replace")
                    for n, line in enumerate(body.removesuffix("\n").split("\n")):
                        rows.append((path, at, n, line.removesuffix("\r")))
                        if len(rows) >= ROWS:
                            yield flush()
                            rows = []
        if rows:
            yield flush()


class Frames(DataSource):
    """Options: ``path`` (a URI of a folder), ``glob``, ``piece`` (compressed bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def scan(spark: SparkSession, path: str, glob: str = "*.zst*", piece: int = PIECE) -> DataFrame:
    """(session, parent, at, line) of the files below ``path``, as ``jsonl.scan`` gives them; lines end with their frame at the latest."""
    spark.dataSource.register(Frames)
    found = spark.read.format(FORMAT).option("path", path).option("glob", glob).option("piece", piece).load()
    return found.select(F.col("source").alias("session"), F.lit(None).cast("string").alias("parent"), F.struct("frame", "n").alias("at"), "line")
