"""Runs against all periods tried at all places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracemill.llm import queries, runs

SCHEMA = "doc_id bigint, text string, runs bigint, n_words string"


def plain(words, least):
    """(start, period, end) of every run."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts_of(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 90)
    if kind < 2:
        return [rng.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        return ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] * 20)[:n]
    if kind == 4:
        x = [rng.randrange(5) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 5) + [9]
        return (x * 5 + [rng.randrange(5) for _ in range(9)] + x * 3)[:120]
    out = [1]
    while len(out) < n:
        out += [rng.randrange(3)] * rng.randrange(1, 15) if rng.random() < 0.5 else out[-rng.randrange(1, 9) :]
    return out


def test_every_run_of_repetitive_words():
    rng = random.Random(1)
    for _ in range(400):
        least, texts = rng.choice([1, 2, 3, 4, 6, 12, 12]), [texts_of(rng) for _ in range(rng.randrange(1, 5))]
        if not any(texts):
            continue
        got = runs.runs_of(np.array(sum(texts, []), np.int64), np.cumsum([len(x) for x in texts]), least)
        assert got == [plain(w, least) for w in texts]


def test_runs_are_copied_inside_long_blocks():
    """A long stretch that stands twice: the runs inside its second place are found through the first."""
    rng = random.Random(3)
    inner = [v for _ in range(30) for v in [rng.randrange(100) for _ in range(5)] * 4 + [rng.randrange(100, 10_000)]]
    words = inner + [10_001] + inner + [10_002] + inner[:300]
    assert runs.runs_of(np.array(words), np.array([len(words)]), 12) == [plain(words, 12)]


def test_longest_previous_factor():
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 50))] + [-1]
        order, levels = runs.classes(np.array(w))
        assert [w[i:] for i in order] == sorted(w[i:] for i in range(len(w)))
        length, place = runs.longest_previous(order, levels)
        for i in range(len(w)):
            common = lambda j: next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i)
            assert length[i] == max((common(j) for j in range(i)), default=0)
            assert not length[i] or (place[i] < i and common(place[i]) == length[i])


def want(doc_id, text, plant):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words, 12)
    gone = {i for s, q, e in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    told = "".join(f"{s},{e - s},{q}\n" for s, q, e in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4), sha(told), sha(kept))


def test_texts_with_nulls_ties_and_odd_spaces(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "ab " * 11, "ab " * 12, "ab\x0bcd\x0c" * 30, "é x y " * 20, "x\x1cy x " * 9, "long " * 5000, " ".join(f"w{k % 700}" for k in range(3000)), "a b c d e f g h i j k l " * 2]
    texts += [" ".join(map(str, texts_of(rng))) for _ in range(40)]
    rows = [(n if n % 9 else None, t, 0, "clash") for n, t in enumerate(texts)] + [(3, "one", 0, "clash")] * 2
    # Small blocks, so that several are worked on.
    monkeypatch.setattr(runs, "READ_WORDS", 500)
    monkeypatch.setattr(runs, "BLOCK_WORDS", 100)
    got = runs.collapsed(spark.createDataFrame(rows, SCHEMA)).collect()
    ours = sorted((str(r["doc_id"]), r["n_words"], [(x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]], r["collapsed"]) for r in got)
    expect = []
    for i, t, *_ in rows:
        words = split(t)
        found = plain(words, 12) if len(words) < 4000 else [(0, 1, 5000)]
        gone = {k for s, q, e in found for k in range(s + q, e)}
        expect.append((str(i), len(words), found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert ours == sorted(expect)
    assert runs.collapsed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_matches_brute_force(spark, sf):
    got = {tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, f"/root/testdata/sf{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {want(r["doc_id"], r["text"], True) for r in docs}
    assert sum(1 for r in got if r[1]) >= len(docs) // 20
