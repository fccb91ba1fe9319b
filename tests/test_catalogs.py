"""Price files row by row, and successive reads of them against a plain fold."""

import json
import math
import random

from tracemill.operators import catalogs

OBSERVED = f"read bigint, key string, source string, rates {catalogs.RATES}"
READS = "read bigint, at bigint, primary_ok boolean"
BASE = f"key string, source string, prices {catalogs.SEGMENTS}, pending {catalogs.RATES}"


def same(a, b):
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1)


def alike(a, b):
    one = lambda x, y: all(same(p, q) for p, q in zip(x[:4], y[:4]))
    return one(a, b) and len(a[4]) == len(b[4]) and all(x[0] == y[0] and one(x[1:], y[1:]) for x, y in zip(a[4], b[4]))


def fill(r):
    cache = r[0] if r[2] is None else r[2]
    ratio = cache / r[0] if r[0] > 0 else 1.0
    return (r[0], r[1], cache, r[3], [(t[0], t[1], t[2], round(t[1] * ratio, 6) if t[3] is None else t[3], t[4]) for t in r[4]])


def fold(base, observed, reads):
    """key -> [owner, segments [from, until, rates], pending]."""
    held = {k: [s, [list(p) for p in ps], pending] for k, s, ps, pending in base}
    for read, at, ok in sorted(reads, key=lambda r: r[1]):
        for key in sorted({o[1] for o in observed if o[0] == read}):
            by = {o[2]: o[3] for o in observed if o[:2] == (read, key)}
            e = held.get(key)
            obs = by.get(catalogs.PRIMARY) or (by.get(catalogs.FALLBACK) if ok or not e or e[0] != catalogs.PRIMARY else None)
            if obs is None:
                continue
            if e is None:
                held[key] = [catalogs.PRIMARY if catalogs.PRIMARY in by else catalogs.FALLBACK, [[0, None, fill(obs)]], None]
                continue
            cur = e[1][-1][2]
            pick = lambda k: obs[k] if obs[k] is not None and obs[k] > 0 else cur[k]  # noqa: B023, E731
            tiers = [(t[0], t[1], t[2], t[3] if t[3] is not None else t[1] * pick(2) / pick(0) if pick(0) > 0 else t[1], t[4]) for t in (obs[4] or cur[4])]
            new = (pick(0), pick(1), pick(2), pick(3), tiers)
            moves = [0 if same(a or 0.0, b or 0.0) else abs((b or 0) - a) / a if a else math.inf for a, b in zip(cur[:4], new[:4])]
            if alike(cur, new):
                e[2] = None
            elif max(moves) > catalogs.CONFIRM and not (e[2] and alike(e[2], new)):
                e[2] = new
            else:
                e[2] = None
                if e[1][-1][0] >= at:
                    e[1][-1][2] = new
                else:
                    e[1][-1][1] = at
                    e[1].append([at, None, new])
    return held


def plain(r):
    return None if r is None else (r["input"], r["output"], r["cache_read"], r["cache_write"], [tuple(t) for t in r["tiers"]])


def close(a, b):
    return (a is None and b is None) or alike(a, b)


def test_successive_reads(spark):
    rng = random.Random(7)
    price = lambda: rng.choice([0.0, 1.0, 1.2, 1.25, 2.0, 4.0])
    maybe = lambda p, v: v if rng.random() < p else None
    rates = lambda: (price(), price(), maybe(0.7, price()), maybe(0.5, price()), [(1000 * (k + 1), price(), price(), maybe(0.5, price()), maybe(0.5, price())) for k in range(rng.choice([0, 0, 1, 2]))])
    reads = [(n, 100 * n, rng.random() < 0.7) for n in range(1, 13)] + [(13, 1200, True)]
    observed = []
    for k in range(60):
        pool = [rates() for _ in range(3)]
        for n, _, ok in reads:
            if ok and rng.random() < 0.6:
                observed.append((n, f"k{k}", catalogs.PRIMARY, rng.choice(pool)))
            if rng.random() < 0.6:
                observed.append((n, f"k{k}", catalogs.FALLBACK, rng.choice(pool)))
    base = [(f"k{k}", rng.choice([catalogs.PRIMARY, catalogs.FALLBACK]), [(0, 50, fill(rates())), (50, None, fill(rates()))], maybe(0.3, fill(rates()))) for k in range(0, 70, 3)]
    got = {r["key"]: r for r in catalogs.synced(spark.createDataFrame(base, BASE), spark.createDataFrame(observed, OBSERVED), spark.createDataFrame(reads, READS)).collect()}
    want = fold(base, observed, reads)
    assert set(got) == set(want)
    for key, (owner, segments, pending) in want.items():
        r = got[key]
        assert r["owner"] == owner and close(plain(r["pending"]), pending), key
        assert [(p["from"], p["until"]) for p in r["prices"]] == [(a, b) for a, b, _ in segments], key
        assert all(alike(plain(p["rates"]), x) for p, (_, _, x) in zip(r["prices"], segments)), key
    assert any(len(r["prices"]) > 3 for r in got.values()) and any(r["pending"] for r in got.values())


def test_nothing_read(spark):
    none = spark.createDataFrame([], OBSERVED)
    assert catalogs.synced(spark.createDataFrame([], BASE), none, spark.createDataFrame([], READS)).count() == 0
    base = spark.createDataFrame([("k", catalogs.PRIMARY, [(0, None, (1.0, 2.0, 1.0, None, []))], None)], BASE)
    assert catalogs.synced(base, none, spark.createDataFrame([(1, 5, True)], READS)).first()["key"] == "k"
    reads = spark.createDataFrame([(1, 5, False, False), (2, 90_000_000, False, True), (3, 190_000_000, False, False)], READS + ", fallback_ok boolean")
    assert [tuple(catalogs.stale(reads, now).first()) for now in (100_000_000, 190_000_000)] == [(90_000_000, False), (90_000_000, True)]
    assert tuple(catalogs.stale(reads.limit(0), 5).first()) == (None, True)


def cost(i, o, **more):
    return {"cost": {"input": i, "output": o, **more}}


def test_price_lists_by_provider(spark):
    file = {
        "openai": {"models": {"big-1.5": {**cost(2, 8, cache_read=0.5, tiers=[{"tier": {"type": "context", "size": 500}, "input": 4, "output": 9}, {"tier": {"type": "other", "size": 5}, "input": 4, "output": 9}]), "limit": {"context": 900, "output": 0}, "name": "Big"}, "bad": cost(-1, 2), "free": {}}},
        "google": {"models": {"x/Big-1-5": cost(9, 9), "wide": cost(1, 2, context_over_200k={"input": 3, "output": 4, "cache_write": 5})}},
        "shop1": {"models": {"v/Mid": {**cost(1, 10, cache_read=0.1), "limit": {"context": 100}}, "mid-free": cost(0, 0), "solo:free": cost(0, 0), "big-1.5": cost(7, 7)}},
        "shop2": {"models": {"v/mid": {**cost(2, 20), "limit": {"context": 301}}, "w/mid:free": cost(0, 0), "u/solo:free": cost(0, 0)}},
        "shop3": {"models": {"mid": cost(4.5, 0), "w/mid": cost(4, 40)}},
        "shop4": {"models": {"mid": cost(3, 30)}},
        "empty": {},
    }
    docs = spark.createDataFrame([(json.dumps(file),), ("not json",), (None,)], "text string")
    got = {r["id"]: r for r in catalogs.by_provider(docs).collect()}
    assert set(got) == {"big-1.5", "wide", "mid", "solo:free"}
    big, wide, mid, solo = (got[k] for k in ("big-1.5", "wide", "mid", "solo:free"))
    assert (big["provider"], big["name"], big["context_limit"], big["output_limit"], big["consensus"]) == ("openai", "Big", 900, None, False)
    assert plain(big["rates"]) == (2, 8, 0.5, None, [(500, 4, 9, None, None)]) and plain(wide["rates"])[4] == [(200_000, 3, 4, None, 5)]
    assert (mid["provider"], mid["consensus"], mid["context_limit"], plain(mid["rates"])) == ("v", True, 201, (2.5, 25, 0.1, None, []))
    assert (solo["provider"], plain(solo["rates"])) == ("", (0, 0, 0, None, []))
    filled = {r["id"]: plain(r["rates"]) for r in catalogs.filled(catalogs.by_provider(docs)).collect()}
    assert filled["big-1.5"][4] == [(500, 4, 9, 1.0, None)] and filled["wide"] == (1, 2, 1, None, [(200_000, 3, 4, 3, 5)])


def test_price_lists_by_token(spark):
    file = {
        "gemini/pro-2": {"litellm_provider": "gemini", "mode": "chat", "input_cost_per_token": 9e-06, "output_cost_per_token": 1e-05},
        "pro-2": {"litellm_provider": "gemini", "input_cost_per_token": 1.25e-06, "output_cost_per_token": 1e-05, "max_input_tokens": 1000, "max_output_tokens": "0", "cache_read_input_token_cost": 3e-07, "input_cost_per_token_above_200k_tokens": 2.5e-06, "output_cost_per_token_above_200k_tokens": 1.5e-05, "input_cost_per_token_above_9k_tokens": 2e-06},
        "draw": {"litellm_provider": "openai", "mode": "image", "input_cost_per_token": 1e-06, "output_cost_per_token": 1e-06}, "other": {"litellm_provider": "elsewhere", "input_cost_per_token": 1, "output_cost_per_token": 1}, "half": {"litellm_provider": "openai", "input_cost_per_token": 1e-06},
    }
    found = catalogs.by_token(spark.createDataFrame([(json.dumps(file),)], "text string"))
    rows = found.collect()
    assert [(r["id"], r["provider"], r["context_limit"], r["output_limit"], plain(r["rates"])) for r in rows] == [("pro-2", "google", 1000, None, (1.25, 10, 0.3, None, [(200_000, 2.5, 15, None, None)]))]
    primary = found.where("false").unionByName(found.withColumn("source", found.source))
    assert catalogs.merged(primary, found).count() == 1 and catalogs.merged(found.limit(0), found).count() == 1
