"""Ancestors and visible chains against walks from node to node."""

import random

from tracemill.operators import chains, family


def walk(up, node):
    out, seen = [], {node}
    while (node := up.get(node)) is not None and node not in seen:
        seen.add(node)
        out.append(node)
    return out


def test_ancestors_of_forests_with_cycles(spark):
    rng = random.Random(2)
    up = {f"n{k}": f"n{rng.randrange(k)}" for k in range(1, 60) if rng.random() < 0.8}
    up |= {f"deep{k}": f"deep{k + 1}" for k in range(70)}
    up |= {"c0": "c1", "c1": "c2", "c2": "c0", "tail": "tail2", "tail2": "c1", "x": "y", "y": "x"}
    rows = list(up.items()) + [("self", "self"), ("root", None), (None, "root"), ("n1", up.get("n1", "n0"))]
    up.setdefault("n1", "n0")
    got = sorted(tuple(r) for r in family.ancestors(spark.createDataFrame(rows, "session string, parent string")).collect())
    assert got == sorted((n, a, d) for n in up for d, a in enumerate(walk(up, n), 1))
    assert family.ancestors(spark.createDataFrame([], "session string, parent string")).count() == 0


def shown(nodes, leaf):
    """The chain of a leaf, or all nodes in order where it is broken."""
    up = {n: p for n, p, _ in nodes}
    out, node = [], leaf
    while node is not None:
        if node not in up or node in out:
            return [n for n, _, _ in sorted(nodes, key=lambda x: x[2])]
        out.append(node)
        node = up[node]
    return out[::-1] or [n for n, _, _ in sorted(nodes, key=lambda x: x[2])]


def test_visible_chains(spark):
    rng = random.Random(3)
    sessions = {}
    for k in range(25):
        nodes = [(n, rng.choice([None, *range(max(0, n - 3), n)]) if n else None, 100 - n if k % 2 else n) for n in range(rng.randrange(1, 30))]
        sessions[f"s{k}"] = (nodes, rng.randrange(len(nodes)))
    sessions["long"] = ([(n, n - 1 if n else None, n) for n in range(200)], 199)
    sessions["one"] = ([(5, None, 1)], 5)
    sessions["no leaf"] = ([(1, None, 2), (2, 1, 1)], None)
    sessions["leaf unknown"] = ([(1, None, 1), (2, 1, 2)], 9)
    sessions["dangling"] = ([(1, 7, 1), (2, 1, 2), (3, None, 3)], 2)
    sessions["cycle"] = ([(1, 3, 3), (2, 1, 2), (3, 2, 1), (4, None, 0)], 3)
    sessions["own parent"] = ([(1, 1, 1), (2, 1, 2)], 2)
    rows = [(s, *n) for s, (nodes, _) in sessions.items() for n in nodes] + [("hidden", 1, None, 1)]
    frame = spark.createDataFrame(rows, "session string, node bigint, up bigint, at bigint")
    leaves = spark.createDataFrame([(s, leaf) for s, (_, leaf) in sessions.items()] + [("empty", 1)], "session string, leaf bigint")
    got = {}
    for r in chains.active(frame, leaves).orderBy("session", "place").collect():
        got.setdefault(r["session"], []).append((r["node"], r["place"]))
    assert {s: [n for n, _ in v] for s, v in got.items()} == {s: shown(*v) for s, v in sessions.items()}
    assert all([p for _, p in v] == list(range(1, len(v) + 1)) for v in got.values())
