"""Negative-binomial comparison of counts between factor levels, after Love, Huber and Anders 2014 (DESeq2).

Regions are fitted independently, one group per region that holds one count per sample; what joins them (size factors, the
dispersion trend, its spread) are aggregates with one row per sample or region. Counts never meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gamma import log_gamma_of
from ..functions.student import incomplete_beta, normal_two_sided
from ..session import Stash
from .samples import level_pairs

LEAST, MOST = 1e-8, 10.0


def size_factors(counts: DataFrame) -> DataFrame:
    """sample, size_factor of region_id, sample, n: the median over regions of count / geometric mean, over regions with a count in every sample.

    Where no region has a count in every sample, the geometric mean is over positive counts and zero counts do not enter the median.
    """
    samples = counts.agg(F.countDistinct("sample")).scalar()
    logs = counts.groupBy("region_id").agg(F.count_if(F.col("n") > 0).alias("held"), F.avg(F.when(F.col("n") > 0, F.log("n"))).alias("mean_log"))
    full = logs.filter(F.col("held") == samples)
    usable = full if full.limit(1).count() else logs.filter("held > 0")
    ratios = counts.filter("n > 0").join(usable, "region_id").withColumn("r", F.log("n") - F.col("mean_log"))
    return ratios.groupBy("sample").agg(F.exp(F.median("r")).alias("size_factor"))


def base_means(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """region_id, base_mean: the mean of counts divided by their sample's size factor."""
    return counts.join(factors, "sample").groupBy("region_id").agg(F.avg(F.col("n") / F.col("size_factor")).alias("base_mean"))


def design_matrix(metadata: pd.DataFrame, factors: list[str]) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Intercept and one column per level but the first of each factor, in sorted order."""
    columns, names = [np.ones(len(metadata))], [("", "")]
    for f in factors:
        for level in sorted(metadata[f].unique())[1:]:
            columns.append((metadata[f] == level).to_numpy(dtype=float))
            names.append((f, level))
    return np.column_stack(columns), names


def _log_likelihood(n: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    r = 1 / alpha
    return float(np.sum(log_gamma_of(n + r) - math.lgamma(r) - (n + r) * np.log1p(alpha * mu) + n * np.log(alpha * mu)))


def _fit(n: np.ndarray, size: np.ndarray, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (natural log), fitted means and the covariance, by iteratively reweighted least squares with a slight ridge."""
    ridge = np.full(x.shape[1], 1e-6)
    beta = np.linalg.lstsq(x, np.log(n / size + 0.1), rcond=None)[0]
    for _ in range(100):
        mu = np.clip(size * np.exp(np.clip(x @ beta, -30, 30)), 0.5 * 1e-3, None)
        w = mu / (1 + alpha * mu)
        z = np.log(mu / size) + (n - mu) / mu
        a = (x.T * w) @ x + np.diag(ridge)
        new = np.linalg.solve(a, (x.T * w) @ z)
        moved = np.max(np.abs(new - beta))
        beta = new
        if moved < 1e-8:
            break
    mu = np.clip(size * np.exp(np.clip(x @ beta, -30, 30)), 0.5 * 1e-3, None)
    w = mu / (1 + alpha * mu)
    inner = (x.T * w) @ x
    inverse = np.linalg.inv(inner + np.diag(ridge))
    return beta, mu, inverse @ inner @ inverse


def _dispersion(n: np.ndarray, mu: np.ndarray, x: np.ndarray, trend: float | None = None, spread: float = 1.0) -> float:
    """The dispersion with the greatest Cox-Reid adjusted likelihood, with a log-normal prior around ``trend`` if given; golden section on the log scale."""

    def worth(log_alpha: float) -> float:
        alpha = math.exp(log_alpha)
        w = mu / (1 + alpha * mu)
        adjusted = _log_likelihood(n, mu, alpha) - 0.5 * np.linalg.slogdet((x.T * w) @ x)[1]
        return adjusted - ((log_alpha - math.log(trend)) ** 2 / (2 * spread) if trend else 0.0)

    top = math.log(max(MOST, len(n)))
    grid = np.linspace(math.log(LEAST), top, 25)
    k = int(np.argmax([worth(g) for g in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    c, d = b - golden * (b - a), a + golden * (b - a)
    fc, fd = worth(c), worth(d)
    while b - a > 1e-5:
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - golden * (b - a)
            fc = worth(c)
        else:
            a, c, fc = c, d, fd
            d = a + golden * (b - a)
            fd = worth(d)
    return math.exp((a + b) / 2)


def fit_trend(wise: DataFrame) -> tuple[float, float]:
    """(a1, a0) of the trend a1 / mean + a0 through gene-wise dispersions (base_mean, dispersion), by reweighted least squares; constant where that fails.

    Each step is one aggregate over the regions, whose sums give the two normal equations.
    """
    d, m = F.col("dispersion"), F.col("base_mean")
    good = wise.filter((d > 100 * LEAST) & (m > 0))
    flat = (0.0, good.agg(F.coalesce(F.avg(d), F.lit(0.1))).first()[0])
    a1, a0 = 1.0, 0.1
    for _ in range(20):
        fitted = F.lit(a1) / m + F.lit(a0)
        near = good.filter((d / fitted > 1e-4) & (d / fitted < 15)).select((1 / m / fitted).alias("u"), (1 / fitted).alias("v"), (d / fitted).alias("r"))
        pairs = {"uu": ("u", "u"), "uv": ("u", "v"), "vv": ("v", "v"), "ur": ("u", "r"), "vr": ("v", "r")}
        sums = near.agg(F.count("*").alias("n"), *[F.sum(F.col(x) * F.col(y)).alias(name) for name, (x, y) in pairs.items()]).first()
        if sums["n"] < 3:
            return flat
        whole = sums["uu"] * sums["vv"] - sums["uv"] ** 2
        if whole <= 1e-12 * sums["uu"] * sums["vv"]:
            return flat
        new1, new0 = (sums["ur"] * sums["vv"] - sums["vr"] * sums["uv"]) / whole, (sums["vr"] * sums["uu"] - sums["ur"] * sums["uv"]) / whole
        if new0 <= 0 or new1 < 0:
            return flat
        moved = abs(math.log(max(new1, 1e-12) / max(a1, 1e-12))) + abs(math.log(new0 / a0))
        a1, a0 = new1, new0
        if moved < 1e-6:
            break
    return a1, a0


def trend_deviation(wise: DataFrame, a1: float, a0: float) -> float:
    """A robust standard deviation of the log dispersions around the trend; 1 where none is seen."""
    residual = F.log("dispersion") - F.log(F.lit(a1) / F.col("base_mean") + F.lit(a0))
    seen = wise.filter(F.col("dispersion") > 100 * LEAST).select(residual.alias("r"))
    middle = seen.agg(F.median("r")).first()[0]
    return 1.0 if middle is None else 1.4826 * seen.agg(F.median(F.abs(F.col("r") - F.lit(middle)))).first()[0]


def _trigamma(v: float) -> float:
    total = 0.0
    while v < 20:
        total += 1 / v**2
        v += 1
    return total + 1 / v + 1 / (2 * v**2) + 1 / (6 * v**3) - 1 / (30 * v**5)


def _f_quantile(share: float, d1: float, d2: float) -> float:
    low, high = 0.0, 1.0
    cdf = lambda v: float(incomplete_beta(d1 / 2, d2 / 2, d1 * v / (d1 * v + d2)))
    while cdf(high) < share:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if cdf((low + high) / 2) < share else (low, (low + high) / 2)
    return (low + high) / 2


def _cooks(n: np.ndarray, mu: np.ndarray, x: np.ndarray, size: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cook's distances with a robust dispersion per row."""
    q = n / size
    variance = max(np.median((q[cells == c] - np.median(q[cells == c])) ** 2) * 2.198 for c in np.unique(cells))
    alpha = max((variance - np.mean(q)) / max(np.mean(q), 1e-9) ** 2, 0.04)
    w = mu / (1 + alpha * mu)
    hat = w * np.einsum("ij,jk,ik->i", x, np.linalg.pinv((x.T * w) @ x), x)
    return (n - mu) ** 2 / (mu + alpha * mu**2) / x.shape[1] * hat / np.maximum(1 - hat, 1e-9) ** 2


def _adjusted(pdf: pd.DataFrame, alpha: float = 0.05) -> pd.DataFrame:
    """Benjamini-Hochberg with independent filtering on the base mean, for one contrast: the first cut whose rejections come close to the most."""

    def corrected(keep: np.ndarray) -> np.ndarray:
        out = np.full(len(pdf), np.nan)
        at = np.flatnonzero(keep & ~np.isnan(p))
        order = at[np.argsort(p[at], kind="stable")]
        m = len(order)
        out[order] = np.minimum(1, np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]) if m else 0
        return out

    p, mean = pdf["pvalue"].to_numpy(dtype=float), pdf["base_mean"].to_numpy(dtype=float)
    shares = np.linspace(float(np.mean(mean == 0)), 0.95, 50)
    tries = [corrected(mean >= c) for c in np.quantile(mean, shares)]
    rejected = np.array([np.nansum(t < alpha) for t in tries], dtype=float)
    best = 0
    if rejected.max() > 10:
        smooth = np.convolve(np.pad(rejected, 5, mode="edge"), np.ones(11) / 11, mode="valid")
        noise = math.sqrt(np.mean((rejected - smooth)[rejected > 0] ** 2))
        best = int(np.argmax(rejected > smooth.max() - noise)) if (rejected > smooth.max() - noise).any() else 0
    return pdf.assign(padj=tries[best])


def compare_levels(counts: DataFrame, metadata: DataFrame, factors: list[str]) -> DataFrame:
    """factor, level_a, level_b, region_id, base_mean, log2_fold_change, lfc_se, stat, pvalue, padj for every pair of levels of every factor with two or more.

    counts: region_id, sample, n (rounded half-even here; one row per region and sample). metadata: sample and the factors. Regions without any count are left
    out (callers give them -1), and so are samples without any. pvalue and padj are NaN for Cook's outliers. Design: the sum of the factors. Outliers in cells of seven or more samples are
    replaced by the trimmed mean and the region is fitted again.

    What the driver sees: one row per sample (the design), and the sums of the trend's fit.
    """
    rounded = counts.select("region_id", "sample", F.rint(F.col("n").cast("double")).alias("n")).join(metadata.select("sample"), "sample", "left_semi")
    positive = rounded.groupBy("region_id").agg(F.sum("n").alias("s")).filter("s > 0").select("region_id")
    held = Stash(rounded.join(positive, "region_id"), "counts").df
    sizes = Stash(size_factors(held), "sizes").df
    held = held.join(sizes.select("sample"), "sample", "left_semi")
    design = metadata.select("sample", *factors).join(sizes, "sample").toPandas().sort_values("sample", ignore_index=True)
    shape = "factor string, level_a string, level_b string, region_id int, base_mean double, log2_fold_change double, lfc_se double, stat double, pvalue double, padj double"
    levels = {f: sorted(design[f].unique()) for f in factors}
    x, names = design_matrix(design, factors)
    if not len(design) or all(len(v) < 2 for v in levels.values()) or len(design) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return counts.sparkSession.createDataFrame([], shape)
    size, place = design["size_factor"].to_numpy(), {s: i for i, s in enumerate(design["sample"])}
    cells = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    many = np.bincount(cells)[cells] >= 7
    limit = _f_quantile(0.99, x.shape[1], len(design) - x.shape[1])

    def vector(pdf: pd.DataFrame) -> np.ndarray:
        n = np.zeros(len(design))
        n[pdf["sample"].map(place).to_numpy(dtype=int)] = pdf["n"].to_numpy(dtype=float)
        return n

    def gene_wise(pdf: pd.DataFrame) -> pd.DataFrame:
        n = vector(pdf)
        q = n / size
        rough = max((np.var(q, ddof=1) - np.mean(1 / size) * q.mean()) / max(q.mean(), 1e-9) ** 2, LEAST)
        mu = _fit(n, size, x, min(rough, MOST))[1]
        return pd.DataFrame({"region_id": [pdf["region_id"].iloc[0]], "base_mean": [q.mean()], "dispersion": [_dispersion(n, mu, x)]})

    first = held.groupBy("region_id").applyInPandas(gene_wise, "region_id int, base_mean double, dispersion double")
    wise = Stash(first, "dispersions").df
    a1, a0 = fit_trend(wise)
    deviation = trend_deviation(wise, a1, a0)
    spread = max(deviation**2 - _trigamma((len(design) - x.shape[1]) / 2), 0.25)
    contrasts = sorted(((r["factor"], r["level_a"], r["level_b"]) for r in level_pairs(metadata.join(sizes, "sample"), factors).collect()), key=lambda c: (factors.index(c[0]), *c[1:]))

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = vector(pdf), float(pdf["dispersion"].iloc[0])
        mean = float(pdf["base_mean"].iloc[0])
        trend = a1 / mean + a0

        def solve(n: np.ndarray):
            mu = _fit(n, size, x, trend)[1]
            alpha = own if math.log(own) > math.log(trend) + 2 * deviation else _dispersion(n, mu, x, trend, spread)
            return _fit(n, size, x, alpha)

        beta, mu, cov = solve(n)
        distance = _cooks(n, mu, x, size, cells)
        outlier = bool((distance[~many] > limit).any()) if (~many).any() else False
        odd = (distance > limit) & many
        if odd.any():
            q = np.sort(n / size)
            cut = int(0.2 * len(q))
            n = np.where(odd, np.floor(q[cut : len(q) - cut].mean() * size), n)
            beta, mu, cov = solve(n)
        out = []
        for f, a, b in contrasts:
            c = np.array([float(name == (f, a)) - float(name == (f, b)) for name in names])
            lfc, se = float(c @ beta) / math.log(2), math.sqrt(max(float(c @ cov @ c), 0.0)) / math.log(2)
            stat = lfc / se if se else math.nan
            out.append((f, a, b, int(pdf["region_id"].iloc[0]), mean, lfc, se, stat, math.nan if outlier else float(normal_two_sided(np.array([stat]))[0]), math.nan))
        return pd.DataFrame(out, columns=["factor", "level_a", "level_b", "region_id", "base_mean", "log2_fold_change", "lfc_se", "stat", "pvalue", "padj"])

    tested = held.join(wise, "region_id").groupBy("region_id").applyInPandas(final, shape)
    return tested.groupBy("factor", "level_a", "level_b").applyInPandas(lambda pdf: _adjusted(pdf), shape)
