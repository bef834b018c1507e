import math
import random

import pytest

from stratavox.llm.cutoffs import keep_fraction, order_statistics

RECORDS = "src string, kind string, row_id long, value double, keep_side string"
TARGETS = "src string, kind string, keep_side string, keep_permille int, value string"


def records(seed, n, sources=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        src = "hot" if rng.random() < 0.5 else f"s{rng.randrange(sources)}"
        value = rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), 1e30 * rng.random(), -1e-12, 65535.0, math.inf, None, math.nan])
        rows.append((rng.choice([src, src, src, None]), "m", i, value, "x"))
    return rows


def brute(rows, targets):
    cutoffs, kept = {}, set()
    for src, kind, side, permille, _ in targets:
        values = sorted((r[3] for r in rows if r[0] == src and r[3] is not None and not math.isnan(r[3])), reverse=side == "high")
        n = len(values)
        k = min(n, -(-permille * n // 1000))
        cut = values[k - 1] if k else None
        keep = [r[2] for r in rows if k and r[0] == src and r[3] is not None and (r[3] >= cut if side == "high" else r[3] <= cut)]
        cutoffs[src] = (n, k, cut, len(keep))
        kept |= set(keep)
    return cutoffs, kept


@pytest.mark.parametrize("seed", [1, 2])
def test_cutoffs_match_sorting(spark, seed):
    rows = records(seed, 900)
    rng = random.Random(seed)
    targets = [(s, "m", rng.choice(["high", "low"]), rng.choice([0, 1, 5, 100, 333, 500, 999, 1000]), "x") for s in ("hot", "s0", "s1", "s2", "s3", "none")]
    cutoffs, kept = keep_fraction(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(targets, TARGETS), ["src", "kind"])
    want, want_kept = brute(rows, targets)
    assert {r["src"]: (r["n"], r["k"], r["cutoff"], r["n_kept"]) for r in cutoffs.collect()} == want
    got = [r["row_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want_kept


def test_every_rank_of_awkward_values(spark):
    values = [math.inf, -math.inf, -math.inf, 0.0, -0.0, 1e-300, 1e300, -1e300, 5.0, 5.0, 5.0, 5.000000000000001, 1.0]
    rows = [(k, v) for k in range(len(values)) for v in values]
    ranks = [(k, k + 1) for k in range(len(values))]
    got = {r["sid"]: r["cutoff"] for r in order_statistics(spark.createDataFrame(rows, "sid long, v double"), ranks=spark.createDataFrame(ranks, "sid long, k long")).collect()}
    assert got == {k: sorted(values)[k] for k in range(len(values))}


def test_empty_tables_and_bad_targets(spark):
    empty = spark.createDataFrame([], RECORDS)
    targets = spark.createDataFrame([("a", "m", "high", 5, ""), ("a", "m", None, 5, ""), (None, "m", "low", 5, ""), ("b", "m", "low", None, "")], TARGETS)
    cutoffs, kept = keep_fraction(empty, targets, ["src", "kind"])
    assert [(r["src"], r["n"], r["cutoff"]) for r in cutoffs.collect()] == [("a", 0, None)] and kept.count() == 0
    cutoffs, kept = keep_fraction(empty, targets.limit(0), ["src", "kind"])
    assert cutoffs.count() == 0 and kept.count() == 0
