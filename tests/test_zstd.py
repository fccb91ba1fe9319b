"""Frames dealt out in pieces against inflating each file whole."""

import io
import os
import random

import pytest
import zstandard

from tracemill.sources import zstd


def framed(rng, bodies):
    """Frames of all kinds of headers: with and without sizes and checksums, of many blocks, of repeated bytes, skippable ones between."""
    out = []
    for k, body in enumerate(bodies):
        press = zstandard.ZstdCompressor(level=rng.choice([1, 3, 19]), write_checksum=k % 2 == 0, write_content_size=k % 3 > 0)
        if k % 4 == 3:
            obj = press.compressobj()
            out.append(obj.compress(body[: len(body) // 2]) + obj.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) + obj.compress(body[len(body) // 2 :]) + obj.flush())
        else:
            out.append(press.compress(body))
        if k % 7 == 6:
            out.append(b"\x53\x2a\x4d\x18" + (5).to_bytes(4, "little") + b"skip!")
    return b"".join(out)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(8)
    lines = lambda n: "".join(f"line {rng.randrange(10**9)} é\n" for _ in range(n)).encode()
    bodies = [lines(rng.randrange(1, 6)) for _ in range(300)] + [b"z" * 400_000 + b"\n", os.urandom(300_000).hex().encode() + b"\n", b"no line end", b"\n", b"a\r\n\nb\n"]
    rng.shuffle(bodies)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "session.jsonl.zstd").write_bytes(framed(rng, bodies))
    torn = framed(rng, [b"whole\n", b"cut off, as it is still being written\n"])
    (tmp_path / "torn.jsonl.zst").write_bytes(torn[:-3])
    (tmp_path / "empty.jsonl.zst").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    return tmp_path, bodies


def test_same_rows_however_many_pieces(spark, folder):
    path, bodies = folder
    want = sorted([line.removesuffix("\r") for b in bodies for line in b.decode().removesuffix("\n").split("\n")] + ["whole"])
    seen = None
    for piece in (1 << 30, 20_000, 3000):
        rows = zstd.scan(spark, f"file://{path}", piece=piece)
        got = sorted((r["session"], tuple(r["at"]), r["line"]) for r in rows.collect())
        assert sorted(line for _, _, line in got) == want
        assert seen in (None, got)
        seen = got
    assert rows.rdd.getNumPartitions() > 50
    assert zstd.scan(spark, f"file://{path}/s/none").count() == 0


def test_no_frame():
    data = zstandard.ZstdCompressor().compress(b"x") + b"not a frame"
    with pytest.raises(ValueError):
        list(zstd.frames(io.BytesIO(data), len(data), 0, len(data)))


def test_small_files_share_tasks():
    """A file or piece is no task of its own where there are very many; every byte is in one task."""
    sizes = [(f"f{n:05}", 100 + n % 900) for n in range(20_000)] + [("large", 3 << 20)]
    found = zstd.dealt(sizes, 1 << 9)
    assert len(found) <= 1.5 * zstd.TASKS
    ranges = sorted(r for p in found for r in p.value)
    for path, size in sizes[:500] + sizes[-1:]:
        own = [(low, high) for p, low, high in ranges if p == path]
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert sum(r[2] - r[1] for r in ranges) == sum(n for _, n in sizes)
