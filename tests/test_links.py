import random

import pandas as pd
import pytest

from stratavox.operators import links as L
from stratavox.operators.links import descendants, hierarchies

SCHEMA = "s string, i int, p int, path string"


def brute(rows):
    nodes = {}
    for s, i, p, _ in rows:
        if i is not None:
            old = nodes.get((s, i), "none")
            if old == "none":
                nodes[s, i] = p
            elif p is not None:
                nodes[s, i] = p if old is None else min(old, p)
    out = {}
    for (s, i), p in nodes.items():
        path, seen, at = [i], {i}, p
        state = "root"
        while at is not None and at != -1 and (s, at) in nodes:
            if at in seen:
                state = "cycle"
                break
            seen.add(at)
            path.append(at)
            at = nodes[s, at]
        path = path[::-1]
        out[s, i] = (p, "root", path[0], len(path) - 1, path) if state == "root" else (p, "cycle", None, None, None)
    return out


def solve(spark, rows, fragment):
    got = hierarchies(spark.createDataFrame(rows, SCHEMA), "s", "i", "p", fragment_rows=fragment).collect()
    return {(r["scope"], r["id"]): (r["parent_id"], r["state"], r["root_id"], r["depth"], r["path"]) for r in got}


def forest(seed, n):
    rng = random.Random(seed)
    ids = rng.sample(range(1, 10 * n), n)
    rows = []
    for k, i in enumerate(ids):
        kind = rng.random()
        parent = None if k == 0 or kind < 0.03 else -1 if kind < 0.05 else 99_999_999 if kind < 0.07 else rng.choice(ids) if kind < 0.1 else ids[max(0, k - rng.randint(1, 3))]
        rows.append((rng.choice(["a", "a", "b", None]) if kind > 0.95 else "a", i, parent, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fragment", [15, 40, 100_000])
def test_random_forests(spark, fragment):
    rows = forest(fragment, 120)
    want = brute(rows)
    assert solve(spark, rows, fragment) == want
    states = hierarchies(spark.createDataFrame(rows, SCHEMA), "s", "i", "p", fragment_rows=fragment, paths=False).collect()
    assert {(r["scope"], r["id"]): r["state"] for r in states} == {k: v[1] for k, v in want.items()} and all(r["path"] is None for r in states)


def test_a_deep_chain_and_a_circle_over_partitions(spark):
    rows = [("a", i, i - 7 if i > 7 else None, "x") for i in range(1, 150)] + [("c", i, i % 60 + 1, "x") for i in range(1, 61)] + [("c", 100, 3, "x"), ("c", 200, 200, "x")]
    assert solve(spark, rows, 30) == brute(rows)


def test_scattered_ids_shrink_on_every_level(spark, monkeypatch):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 400)
    rows = [("a", i, ids[k - 1] if k else None, "x") for k, i in enumerate(ids)] + [("c", i, ids[(k + 1) % 60], "x") for k, i in enumerate(ids[:60])]
    sizes = []
    solve_level = L._solve

    def watched(nodes, n, *rest):
        sizes.append(n)
        return solve_level(nodes, n, *rest)

    monkeypatch.setattr(L, "_solve", watched)
    assert solve(spark, rows, 60) == brute(rows)
    assert len(sizes) > 3 and all(b < a for a, b in zip(sizes[1:], sizes[2:])) and sizes[-1] <= 60


def test_long_paths_leave_a_task_in_slices(monkeypatch):
    monkeypatch.setattr(L, "SLICE_IDS", 50)
    pdf = pd.DataFrame({"scope": "a", "id": range(40), "parent_id": pd.array([None, *range(39)], dtype="Int64"), "frag": [[i] for i in range(40)]})
    slices = list(L._contract(iter([pdf])))
    assert len(slices) > 5 and [list(p) for s in slices for p in s["path"]] == [list(range(i + 1)) for i in range(40)]


def test_descendants_null_ids_and_empty(spark):
    rows = [("a", 1, None, "x"), ("a", 2, 1, "x"), ("a", 3, 2, "x"), ("a", 3, 2, "x"), ("a", None, 1, "x"), ("a", 8, 9, "x"), ("a", 9, 8, "x")]
    pairs = descendants(hierarchies(spark.createDataFrame(rows, SCHEMA), "s", "i", "p"))
    assert sorted(tuple(r)[1:] for r in pairs.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0)]
    assert hierarchies(spark.createDataFrame([], SCHEMA), "s", "i", "p").count() == 0
