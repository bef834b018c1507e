import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import quantiles
from stratavox.llm.quantiles import Sketch, merge_sketches, percentiles, rank_bound, rank_check, sketches


def rank_error(values, found, q):
    values = np.sort(values)
    low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
    want = math.ceil(q * len(values))
    return max(0, low + 1 - want, want - high) / len(values)


@pytest.mark.parametrize("shape", ["uniform", "sorted", "reversed", "ties", "heavy"])
def test_error_is_relative_to_what_lies_above(shape):
    rng = np.random.default_rng(4)
    values = {"uniform": rng.random(200_000), "sorted": np.arange(200_000.0), "reversed": np.arange(200_000.0)[::-1], "ties": rng.integers(0, 40, 200_000).astype(float), "heavy": rng.pareto(1, 200_000)}[shape]
    s = Sketch()
    for part in np.array_split(values, 37):
        s.merge(Sketch.from_bytes(Sketch().add(part).to_bytes()))
    assert s.n == len(values) and sum(len(x) for x in s.levels) < 8_000
    for q in (0.1, 0.5, 0.9, 0.99, 0.999, 1.0):
        assert rank_error(values, s.quantiles([q])[0], q) <= 0.02 * (1 - q) + 1e-5
    assert s.quantiles([1.0])[0] == values.max()


def test_small_groups_are_exact_and_empty_is_none():
    s = Sketch().add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0, 0.34, 0.5, 1]) == [1.0, 2.0, 2.0, 3.0]
    assert Sketch().quantiles([0.5]) == [None]


SCHEMA = "im string, day int, r_xy double, sketch string"


def test_groups_ranges_and_combination(spark):
    rng = np.random.default_rng(5)
    rows = [(["a", "a", "a", "b", None][rng.integers(5)], int(rng.integers(3)), [float(rng.random()), None, math.nan, 2e4][min(int(rng.integers(8)), 3) if rng.random() < 0.1 else 0], "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    days = sketches(df, ["im", "day"], ["r_xy"], {"r_xy": (1e-9, 1e4)})
    for got in (percentiles(sketches(df, ["im"], ["r_xy"], {"r_xy": (1e-9, 1e4)}), ["im"], [50, 99]), percentiles(merge_sketches(days, ["im"]), ["im"], [50, 99])):
        rows_out = {r["im"]: r for r in got.collect()}
        assert set(rows_out) == {"a", "b", None}
        for im, r in rows_out.items():
            values = np.array([v for i, _, v, _ in rows if i == im and v is not None and not math.isnan(v) and v < 1e4])
            assert r["n_values"] == len(values) and r["measure"] == "r_xy"
            assert rank_error(values, r["p50"], 0.5) <= 0.01 and rank_error(values, r["p99"], 0.99) <= 0.001
    assert sketches(df.limit(0), ["im"], ["r_xy"]).count() == 0


@pytest.mark.parametrize("order", ["random", "zigzag", "sorted", "strided"])
@pytest.mark.parametrize("parts", [1, 20, 600])
def test_ranks_are_within_the_stated_bound(order, parts):
    rng = np.random.default_rng(parts)
    n = 300_000
    values = np.arange(n, dtype=float)
    values = {"random": rng.permutation(values), "sorted": values, "zigzag": np.where(np.arange(n) % 2, values, n - values), "strided": values.reshape(500, -1).T.ravel()}[order]
    made = Sketch().merge_all([Sketch().add(p) for p in np.array_split(values, parts)])
    assert made.n == n
    for q in (0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999):
        assert rank_error(values, made.quantiles([q])[0], q) <= rank_bound(n, q) + 1 / n
    assert rank_bound(100, 0.5) == 0 and rank_bound(10**9, 0.5) < 0.0041


def test_one_group_with_half_of_all_sketches_is_merged_in_steps(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_IN", 3)
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 2 else f"g{i % 40}", 0, float(v), "x") for i, v in enumerate(rng.random(20_000))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(12)
    parts = sketches(df.withColumn("part", F.spark_partition_id()), ["im", "part"], ["r_xy"])
    merged = merge_sketches(parts, ["im"])
    got = {r["im"]: r for r in percentiles(merged, ["im"], [50, 99], bounds=True).collect()}
    for im in ("hot", "g0"):
        values = np.array([r[2] for r in rows if r[0] == im])
        assert got[im]["n_values"] == len(values)
        assert rank_error(values, got[im]["p50"], 0.5) <= got[im]["e50"] + 1 / len(values) and rank_error(values, got[im]["p99"], 0.99) <= got[im]["e99"] + 1 / len(values)
    # the last merge gets one sketch for every three tasks, not one a task
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(im") >= 2


def test_the_check_of_ranks_sees_a_wrong_percentile(spark):
    rows = [("a", 0, float(v), "x") for v in range(1, 1001)] + [("a", 0, math.nan, "x"), ("a", 0, None, "x"), ("a", 0, 5e4, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {"r_xy": (1e-9, 1e4)}
    found = percentiles(sketches(df, ["im"], ["r_xy"], limits), ["im"], [50, 99], bounds=True)
    good = [tuple(r) for r in rank_check(df, found, ["im"], [50, 99], limits).collect()]
    assert sorted(good) == [("a", "r_xy", 1000, 50.0, True), ("a", "r_xy", 1000, 99.0, True)]
    wrong = found.withColumn("p99", F.lit(950.0))
    assert {r["percent"]: r["within"] for r in rank_check(df, wrong, ["im"], [50, 99], limits).collect()} == {50.0: True, 99.0: False}
