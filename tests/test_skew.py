import math
import random

import pytest

from stratavox.operators.skew import hot_keys, key_counts, number_rows, ordered_profile

SCHEMA = "k int, o long, v double, l string, row_extra string"


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 7 if rng.random() < 0.5 else rng.choice([None, 0, 1, 2, 3])
        value = rng.choice([None, math.nan, 1.0, 2.0, 2.0, 3.5])
        rows.append((key, i, value, rng.choice([None, "a", "b"]), "x"))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        values = [r[2] for r in mine if r[2] is not None and not math.isnan(r[2])]
        labels = [r[3] for r in mine]
        out[key] = (
            len(mine), len(values), sum(values) if values else None, values[0] if values else None, values[-1] if values else None,
            max(len(values) - 1, 0), sum(b > a for a, b in zip(values, values[1:])), 1 + sum(a != b for a, b in zip(labels, labels[1:])),
        )
    return out


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_profile_is_the_same_for_any_chunk(spark, chunk):
    rows, df = table(spark)
    got = {r["k"]: tuple(r)[1:] for r in ordered_profile(df, "k", ["o"], "v", "l", chunk_rows=chunk).collect()}
    assert got == expected(rows)


def test_numbers_are_exact_per_key(spark):
    rows, df = table(spark)
    numbered, _ = number_rows(df, "k", ["o"])
    got = {}
    for r in numbered.collect():
        got.setdefault(r["k"], []).append((r["row_no"], r["o"]))
    for key, pairs in got.items():
        assert [o for _, o in sorted(pairs)] == sorted(r[1] for r in rows if r[0] == key)
        assert sorted(n for n, _ in pairs) == list(range(len(pairs)))


def test_counts_and_hot_keys(spark):
    rows, df = table(spark)
    counts = {r["k"]: (r["n_rows"], r["n_chunks"]) for r in key_counts(df, "k", chunk_rows=50).collect()}
    for key in {r[0] for r in rows}:
        n = sum(r[0] == key for r in rows)
        assert counts[key] == (n, -(-n // 50))
    assert [r["k"] for r in hot_keys(df, "k", 400).collect()] == [7]
    assert hot_keys(df.limit(0), "k", 40).count() == 0
    assert ordered_profile(df.limit(0), "k", ["o"], "v", "l").count() == 0


def test_hot_keys_of_a_total_whose_product_is_no_int(spark):
    n = 2_200_000  # times 990 permille: above 2 ** 31
    df = spark.range(n).selectExpr("CAST(CASE WHEN id % 1000 < 9 THEN id % 1000 + 1 ELSE 0 END AS INT) AS k")
    assert [tuple(r) for r in hot_keys(df, "k", 990).collect()] == [(0, n // 1000 * 991, 44)]
