import math

import numpy as np
import pytest

from stratavox.operators.filters import filter_cells, parse_filter
from stratavox.operators.measures import exact_quantiles, histogram_peak, inverse_gamma_curve, linear_histogram, log_histogram, trimmed


@pytest.mark.parametrize("text,want", [("r_xy>0", ("r_xy", ">", None, 0)), ("c>=p25", ("c", ">=", "p", 25)), ("c>=p12.5", ("c", ">=", "p", 12.5)), ("c>=peak", ("c", ">=", "peak", 0)), ("c<mean", ("c", "<", "mean", 0)), ("c>=1e5", ("c", ">=", None, 1e5)), ("c> 5", ("c", ">", None, 5)), ("a.b!=-3", ("a.b", "!=", None, -3)), ("c>peak5", ("c", ">", "peak", 0))])
def test_accepted(text, want):
    f = parse_filter(text)
    assert (f.column, f.operator, f.kind, f.value) == want


@pytest.mark.parametrize("text", ["c>", "c=5", "c<>5", "c>=1e-5", "c>=inf", "c>=pe", "", "c", ">5", "c>=p-5", "c>=p101"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse_filter(text)


def frame(spark, values):
    return spark.createDataFrame([(i, v, float(i % 7)) for i, v in enumerate(values)], "i int, a double, b double")


def test_order_of_a_chain_matters_and_stages_are_kept(spark):
    df = frame(spark, [-5.0, -1.0, 1.0, 2.0, 3.0, 4.0, math.nan, None])
    kept, removed = filter_cells(df, ["a>0", "b>=p50"])
    b = [2.0, 3.0, 4.0, 5.0]
    assert sorted(r["b"] for r in kept.collect()) == [v for v in b if v >= np.percentile(b, 50)]
    assert {r["i"]: r["removed_stage"] for r in removed.collect()} == {0: 1, 1: 1, 6: 1, 7: 1, 2: 2, 3: 2}
    other, _ = filter_cells(df, ["b>=p50", "a>0"])
    assert sorted(r["i"] for r in other.collect()) == [3, 4, 5]


def test_nan_in_an_adaptive_filter_keeps_nothing(spark):
    df = frame(spark, [1.0, math.nan, 3.0])
    assert filter_cells(df, ["a>=p50"])[0].count() == 0 and filter_cells(df, ["a>=peak"])[0].count() == 0
    assert filter_cells(df, ["a!=p50"])[0].count() == 3
    assert filter_cells(df.limit(0), ["a>=p50", "a>=mean", "a>=peak"])[0].count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "outliers", "one"])
def test_quantiles_match_numpy(spark, kind, monkeypatch):
    from stratavox.operators import measures

    monkeypatch.setattr(measures, "SORTED_ROWS", 10)
    monkeypatch.setattr(measures, "BINS", 16)
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(size=2000), "ties": rng.integers(0, 5, 500).astype(float), "outliers": np.append(rng.random(300), [1e200, -1e200]), "one": np.array([4.0])}[kind]
    shares = [0, 0.01, 0.25, 0.5, 0.777, 0.99, 1]
    got = exact_quantiles(frame(spark, values.tolist()), "a", shares)
    assert got == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12, abs=1e-12)


def reference_peak(values, domain=None):
    low, high = np.quantile(values, [0.01, 0.99])
    if domain:
        low, high = max(low, domain[0]), min(high, domain[1])
    values = values[(values >= low) & (values <= high)]
    n, edges = np.histogram(values, bins=max(25, min(1000, len(values) // 1000)))
    smooth = np.median(np.stack([np.append(n[:1], n[:-1]), n, np.append(n[1:], n[-1:])]), axis=0)
    k = int(np.argmax(smooth))
    return (edges[k] + edges[k + 1]) / 2


def test_peak_and_histograms_match_numpy(spark):
    rng = np.random.default_rng(8)
    values = rng.gamma(3, 2, 5000)
    df = frame(spark, values.tolist())
    assert histogram_peak(df, "a", (1e-9, 1e4)) == pytest.approx(reference_peak(values, (1e-9, 1e4)))
    rows = sorted(linear_histogram(df, "a").collect())
    n, edges = np.histogram(values, bins=25)
    assert [r["n"] for r in rows] == n.tolist() and [r["low"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert sum(r["density"] * (r["high"] - r["low"]) for r in rows) == pytest.approx(1)
    log_edges = np.logspace(np.floor(np.log10(values.min())), np.ceil(np.log10(values.max())), 25)
    assert [r["n"] for r in sorted(log_histogram(df, "a").collect())] == np.histogram(values, bins=log_edges)[0].tolist()
    low, high = np.quantile(values, [0.05, 0.95])
    assert trimmed(df, "a", 0.05, 0.95).count() == int(((values >= low) & (values <= high)).sum())


def test_constant_spike_and_empty(spark):
    same = frame(spark, [2.0] * 50)
    assert histogram_peak(same, "a") == pytest.approx(reference_peak(np.full(50, 2.0)))
    spike = [float(v) for v in list(range(100)) + [50] * 40 + [20, 21, 22, 23, 20, 21, 22, 23, 21, 22] * 3]
    assert histogram_peak(frame(spark, spike), "a") == pytest.approx(reference_peak(np.array(spike)))
    empty = same.limit(0)
    assert histogram_peak(empty, "a") is None and linear_histogram(empty, "a").count() == 0 and log_histogram(frame(spark, [-1.0, 0.0]), "a").count() == 0
    assert inverse_gamma_curve(empty, "a").count() == 0


def test_inverse_gamma_follows_the_data(spark):
    rng = np.random.default_rng(1)
    values = 1 / rng.gamma(5, 1 / 4, 20_000)
    curve = inverse_gamma_curve(frame(spark, values.tolist()), "a").toPandas()
    x = curve["x"].to_numpy()
    span = values.max() - values.min()
    fitted = np.cumsum(curve["density"].to_numpy()) * (x[1] - x[0]) / span
    seen = np.searchsorted(np.sort(values), x, "right") / len(values)
    assert np.abs(fitted - seen).max() < 0.05
