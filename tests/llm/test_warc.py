"""Archives as exact round trips, and revisits against a plain pass over the pages."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest

from tests.oracle import compare
from tracemill.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, record_type string, refers_to string"


def pages():
    rng = random.Random(6)
    bodies = ["", "a", "é" * 40, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "".join(chr(rng.randrange(32, 3000)) for _ in range(200_000)), "hot"]
    rows = [(n, f"http://h{n % 3}/p\r\n{n}", bodies[-1] if n % 3 else rng.choice(bodies), "clash", "clash") for n in range(60)]
    rows += [(60, None, None, None, None), (61, "u", "only", None, None), (None, "v", "a", None, None), (None, "v", "alone", None, None), (5, "again", rows[5][2], None, None), rows[7], rows[7]]
    return rows


def files(folder):
    return sorted(f for f in Path(folder).rglob("part-*") if f.is_file())


def test_round_trip_in_small_files(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write(warc.pages_as_records(table), f"file://{tmp_path}/a", most=2000)
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r["page_id"] is None, r["page_id"], bytes(r["payload"])) for r in got if r["page_id"] is not None) == sorted((False, r[0], (r[2] or "").encode()) for r in rows if r[0] is not None)
    assert sorted(r["url"] for r in got if r["url"]) == sorted(r[1].replace("\r", "%0D").replace("\n", "%0A") for r in rows if r[1])
    assert len(files(tmp_path / "a")) > 3
    # Every file is a gzip file of records, and a record's place is where its member begins.
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files(tmp_path / "a"))
    assert whole.count(b"WARC-Record-ID: ") == len(rows)
    for r in got[:5]:
        raw = Path(r["file"].removeprefix("file:")).read_bytes()[r["at"] :]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_revisits(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, SCHEMA)
    for least in (0, 2):
        got = warc.archive(table, least).collect()
        assert len(got) == len(rows)
        by = {}
        for r in rows:
            by.setdefault((r[2] or "").encode(), []).append(-1 if r[0] is None else r[0])
        want = []
        for body, ids in by.items():
            top = max(ids)
            sha = warc.digest(body)
            for k, i in enumerate(sorted(ids, reverse=True)):
                again = k > 0 and len(body) >= least
                want.append((i, len(body), sha, "revisit" if again else "response", top if again else -2))
        ours = [(-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -2 if r["record_type"] == "response" else -1 if r["original"] is None else r["original"]) for r in got]
        assert sorted(ours) == sorted(want)
        ids = {r["record_id"] for r in got}
        assert len(ids) == len(rows) and {r["refers_to"] for r in got} - {None} <= ids


def test_empty_table_and_digest(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(warc.digest(hashlib.sha1(b"x").digest())) == 32


def test_damage_is_told():
    good = gzip.decompress(warc.record(1, "u", "2024-01-01T00:00:00Z", 3, warc.digest(b"abc"), b"abc"))
    assert warc.parsed(good)[2] == b"abc"
    for bad in (b"HTTP/1.1" + good, good + b"x", good[:-6]):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    with pytest.raises(ValueError):
        list(warc._members(gzip.compress(b"some text")[:-9]))


def test_query_matches_sql(spark):
    for sf in ("0.001", "0.01"):
        compare(spark, f"/root/testdata/sf{sf}", queries.QUERIES["op11_warc_revisits"], queries.SQL["op11_warc_revisits"])
