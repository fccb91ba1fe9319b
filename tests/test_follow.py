"""Followed files in several micro-batches against one batch reading of what is there at the end."""

import os

import pytest

from tracemill.sources import follow


def texts(df):
    return sorted((r["source"].rsplit("/", 1)[-1], r["at"], r["line"]) for r in df.collect())


class Followed:
    def __init__(self, spark, folder):
        self.spark, self.files, self.base = spark, folder / "files", f"file://{folder}"
        self.files.mkdir()

    def step(self, piece=7):
        found = follow.stream(self.spark, f"{self.base}/files", f"{self.base}/manifests", piece=piece)
        follow.keep(found, f"{self.base}/kept", f"{self.base}/checkpoint").awaitTermination()

    def kept(self):
        return texts(follow.kept(self.spark, f"{self.base}/kept"))

    def batch(self, piece=1 << 20):
        return texts(follow.batch(self.spark, f"{self.base}/files", piece=piece).where("kind = 'line'"))

    def write(self, name, data, mode="ab"):
        with open(self.files / name, mode) as f:
            f.write(data)


@pytest.fixture
def followed(spark, tmp_path):
    return Followed(spark, tmp_path)


def test_appended_lines_come_once_and_unfinished_ones_wait(followed):
    followed.write("a.jsonl", b"one\ntwo\nthr")
    followed.write("b.jsonl", b"")
    followed.write("skip.txt", b"not read\n")
    followed.step()
    assert followed.kept() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    followed.write("a.jsonl", b"ee, a line that is longer than a piece\r\n\n")
    followed.write("b.jsonl", "é\xa0b\n".encode())
    followed.step()
    followed.write("c.jsonl", b"new\n")
    followed.write("a.jsonl", b"end\nopen")
    followed.step()
    followed.step()
    assert followed.kept() == followed.batch() == followed.batch(3)
    assert ("a.jsonl", 8, "three, a line that is longer than a piece") in followed.kept() and ("a.jsonl", 51, "") in followed.kept()
    assert not any(line == "open" for _, _, line in followed.kept())


def test_rewritten_shorter_longer_and_removed_files(followed):
    for name in ("shrunk", "grown", "same", "gone", "back"):
        followed.write(f"{name}.jsonl", b"first line\nsecond line\n")
    followed.step()
    followed.write("shrunk.jsonl", b"other\n", "wb")
    followed.write("grown.jsonl", b"quite other\nsecond line\nthird\n", "wb")
    followed.write("same.jsonl", b"third\n")
    os.remove(followed.files / "gone.jsonl")
    os.remove(followed.files / "back.jsonl")
    followed.step()
    assert followed.kept() == followed.batch()
    assert {n for n, _, _ in followed.kept()} == {"shrunk.jsonl", "grown.jsonl", "same.jsonl"}
    followed.write("back.jsonl", b"again\n")
    followed.step()
    assert followed.kept() == followed.batch() and ("back.jsonl", 0, "again") in followed.kept()
    rows = followed.spark.read.parquet(f"{followed.base}/kept").where("kind <> 'line'").collect()
    assert sorted((r["source"].rsplit("/", 1)[-1], r["kind"]) for r in rows) == [("back.jsonl", "removed"), ("back.jsonl", "reset"), ("gone.jsonl", "removed"), ("grown.jsonl", "reset"), ("shrunk.jsonl", "reset")]


def test_nothing_to_read(followed):
    followed.step()
    assert followed.batch() == []
    followed.write("a.jsonl", b"x\n")
    followed.step()
    assert followed.kept() == followed.batch() == [("a.jsonl", 0, "x")]


def test_pieces_of_large_stores_share_tasks():
    new = {f"f{k:02}": [1_000_000 + k, 0, 0, "", False] for k in range(20)}
    for most, tasks in ((1 << 16, 320), (1 << 10, 1100)):
        found = follow.pieces({}, new, most)
        assert len(found) <= tasks
        parts = [p for x in found for p in x.value]
        assert max(p[4] - p[3] for p in parts) <= most
        for path, (size, *_) in new.items():
            own = [(low, high) for at, _, _, low, high in parts if at == path]
            assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
