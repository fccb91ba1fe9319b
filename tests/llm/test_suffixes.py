"""The suffix dedup's own steps, in one process: what reaches the construction, what is written, and small pieces."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import suffixes

RANGES = ("<i8", "<i8", "<i8", "<i8")


def removed(rows, each=40, buckets=64):
    """{id: bytes that go} by the operator's steps over batches of ``each`` rows; rows: (id, text)."""
    cut = [rows[i : i + each] for i in range(0, len(rows), each)]
    batch = lambda part, *more: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), *more], names=["d", "text", "bodies"][: 2 + len(more)])
    dealt = lambda found: suffixes._rows(sorted((tuple(r.values()) for b in found for r in b.to_pylist()), key=lambda r: r[1]), *suffixes._PACKED)
    noted = {i: [] for i, _ in rows}
    for b in suffixes._repeated([dealt(suffixes._offer(buckets)(map(batch, cut)))]):
        for r in b.to_pylist():
            noted[r["d"]].append(r["body"])
    strings = dealt(suffixes._strings(buckets)(batch(part, pa.array([noted[i] for i, _ in part], pa.list_(pa.binary()))) for part in cut))
    out = {i: set() for i, _ in rows}
    for b in suffixes._compared(buckets)([strings]):
        for body in b.column("body").to_pylist():
            for d, _, start, stop in zip(*(x.tolist() for x in suffixes._unpack(body, *RANGES))):
                out[d] |= set(range(start, stop))
    return out


def plain(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = text.encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, text in rows:
        raw = text.encode()
        out[i] = {x for k in range(len(raw) - 49) if first[raw[k : k + 50]] < i for x in range(k, k + 50)}
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))


def around_a_passage(n):
    """Documents that share a passage and no edge of it."""
    rng = random.Random(3)
    passage = words(rng, 60)
    return [(i, f"{words(rng, 12)} {passage} {words(rng, 12)}") for i in range(n)]


def mixed(n=240):
    """Passages, passages with changed words, parts of them, repeated ones, and texts that repeat themselves."""
    rng = random.Random(4)
    kept, rows = [words(rng, 50) for _ in range(5)], []
    for i in range(n):
        parts = rng.choice(kept).split()
        if i % 3 == 0:
            parts[rng.randrange(len(parts))] = words(rng, 1)
        if i % 4 == 0:
            parts = parts[rng.randrange(20) :]
        if i % 7 == 0:
            parts = parts * 2
        rows.append((i, f"{words(rng, rng.randrange(10))} {' '.join(parts)} {words(rng, rng.randrange(10))}"))
    return [*rows, (n, "ab" * 200), (n + 1, "ba" * 150), (n + 2, ""), (n + 3, "é" * 60)]


def test_only_windows_of_several_documents_reach_the_construction(monkeypatch):
    rows, built = around_a_passage(120), []

    def spy(strings, owners, folder, f=suffixes.earlier_elsewhere):
        built.extend(strings)
        return f(strings, owners, folder)

    monkeypatch.setattr(suffixes, "earlier_elsewhere", spy)
    assert removed(rows) == plain(rows)
    found = Counter(w for _, text in rows for w in {text.encode()[k : k + 50] for k in range(len(text.encode()) - 49)})
    assert built and len(set(built)) == len(built)
    assert all(found[s[k : k + 50]] > 1 for s in built for k in range(len(s) - 49))


@pytest.mark.parametrize("name,value", [("BATCH", 3), ("BLOCK", 200), ("PIECE", 150), ("HELD", 500), ("RANGES", 20)])
def test_small_pieces_give_the_same(monkeypatch, name, value):
    rows = mixed()
    want = plain(rows)
    assert removed(rows) == want
    monkeypatch.setattr(suffixes, name, value)
    assert removed(rows) == want


def test_columns_are_written_over_and_not_emptied(tmp_path):
    emptied, on = [], [True]

    def hook(event, args):
        if on[0] and event == "open" and str(args[0]).startswith(str(tmp_path)) and "w" in str(args[1]):
            emptied.append(args[0])

    sys.addaudithook(hook)
    suffixes.common_prefixes([b"banana" * 10, b"ananas" * 9], str(tmp_path))
    on[0] = False
    assert 0 < len(emptied) <= 4


def test_rows_for_each_batch_do_not_grow_with_the_input(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(suffixes, "_offer", lambda buckets, f=suffixes._offer: seen.append(buckets) or f(buckets))
    docs = spark.range(10).selectExpr("id doc_id", "'' text")
    for tasks in (100, 1000, 3000):
        suffixes.dedup(docs.repartition(tasks))
    assert seen == [1024, 1024, 3000]


def test_groups_keep_keys_whole():
    rng = np.random.default_rng(1)
    for _ in range(50):
        key = np.sort(rng.integers(0, 12, rng.integers(0, 40)))
        weight = rng.integers(1, 9, len(key))
        got = list(suffixes._groups(key, weight, 20))
        assert [x for a, b in got for x in range(a, b)] == list(range(len(key)))
        for a, b in got:
            assert weight[a:b].sum() <= 20 or len(set(key[a:b])) == 1
            assert b == len(key) or key[b] != key[b - 1]
