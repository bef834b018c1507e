"""Exact percentiles, histograms and the histogram peak of one numeric column, over any number of rows.

Spark's exact percentile keeps every distinct value of a group in one buffer, and percentile_approx is not exact. Here ranks are
found by counting: rows are counted in a few thousand equal-width bins, the bin that holds the rank is cut again, and once a bin is small
only its rows are sorted. Every step is one scan with map-side counts; at most ``BINS`` counts reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gamma import digamma, log_gamma, trigamma

# The open range in which a measure's fit is valid (none for center_intensity).
MEASURES: dict[str, tuple[float, float] | None] = {
    "center_intensity": None,
    "r_xy": (1e-9, 1e4),
    "r_z": (1e-9, 1e4),
    "r_xy_max_std": (1e-9, 100.0),
    "r_z_max_std": (1e-9, 100.0),
}

BINS = 2048
SORTED_ROWS = 20_000


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bin, the last one closed on the right; [low - 0.5, high + 0.5] when low = high."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")


def order_values(values: DataFrame, ranks: list[int]) -> list[float]:
    """Exact values of 0-based ``ranks`` in the column ``v`` (no null, no NaN). Ranks that fall into one bin share its scans."""
    found: dict[int, float] = {}
    span = values.agg(F.min("v"), F.max("v")).first()
    open_ranges = [(span[0], span[1], 0, None, sorted(set(ranks)))]
    while open_ranges:
        low, high, below, size, wanted = open_ranges.pop()
        if low == high:
            found |= dict.fromkeys(wanted, low)
            continue
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        if size is not None and size <= SORTED_ROWS:
            rest = np.sort(inside.toPandas()["v"].to_numpy())
            found |= {r: float(rest[r - below]) for r in wanted}
            continue
        # bins are told apart by their own least and greatest values, so rounding of the bin index costs nothing
        counted = inside.groupBy(bin_of(F.col("v"), low, high, BINS).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect()
        for row in sorted(counted, key=lambda r: r["b"]):
            own = [r for r in wanted if below <= r < below + row["n"]]
            if own:
                open_ranges.append((row["a"], row["z"], below, row["n"], own))
            below += row["n"]
    return [found[r] for r in ranks]


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring ranks. Nulls do not count; with any NaN, every quantile is NaN; None for no value."""
    v = F.col(column).cast("double")
    size = df.agg(F.count(v).alias("n"), F.count_if(F.isnan(v)).alias("nans")).first()
    if not size["n"]:
        return [None] * len(shares)
    if size["nans"]:
        return [math.nan] * len(shares)
    places = [s * (size["n"] - 1) for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    at = dict(zip(ranks, order_values(df.select(v.alias("v")).filter("v is not null"), ranks)))
    out = []
    for p in places:
        a, b, t = at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)
        out.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return out


def bin_number(n: int, most: int) -> int:
    """One bin per 1,000 values, at least 25 and at most ``most``."""
    return max(25, min(most, n // 1000))


def linear_histogram(df: DataFrame, column: str, most: int = 500, bins: int | None = None) -> DataFrame:
    """bin, low, high, n, density of an equal-width histogram over all values; empty bins included; null and NaN do not count.

    The range and the number of bins are aggregates; counts are made map-side. No value: no bin.
    """
    v = F.col(column).cast("double")
    good = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    size = good.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    spark = df.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], "bin int, low double, high double, n long, density double")
    bins = bins or bin_number(size["n"], most)
    low, high = (size["low"] - 0.5, size["high"] + 0.5) if size["low"] == size["high"] else (size["low"], size["high"])
    counts = good.groupBy(bin_of(F.col("v"), size["low"], size["high"], bins).alias("bin")).agg(F.count("*").alias("n"))
    width = (high - low) / bins
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.expr("0L"))
    return spine.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), n.alias("n"), (n / F.lit(size["n"] * width)).alias("density")
    )


def log_histogram(df: DataFrame, column: str, most: int = 500) -> DataFrame:
    """bin, low, high, n, density over log-spaced edges from the power of ten at or below the least to the one at or above the greatest positive value.

    The number of edges follows the count of all values (not null, not NaN); values that are not positive fall into no bin. Edges are compared exactly.
    """
    v = F.col(column).cast("double")
    good = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    positive = F.when(F.col("v") > 0, F.col("v"))
    size = good.agg(F.count("*").alias("n"), F.min(positive).alias("low"), F.max(positive).alias("high")).first()
    spark = df.sparkSession
    if size["low"] is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long, density double")
    edges = [float(x) for x in np.logspace(math.floor(math.log10(size["low"])), math.ceil(math.log10(size["high"])), bin_number(size["n"], most))]
    first, step = math.log10(edges[0]), (math.log10(edges[-1]) - math.log10(edges[0])) / (len(edges) - 1) or 1.0
    table = F.array(*map(F.lit, edges))
    guess = F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), F.floor((F.log10("v") - first) / step))).cast("int")
    at = F.col("g")
    exact = F.when(F.col("v") < table[at], at - 1).when((F.col("v") >= table[at + 1]) & (at < len(edges) - 2), at + 1).otherwise(at)
    inside = good.filter((F.col("v") >= edges[0]) & (F.col("v") <= edges[-1])).withColumn("g", guess)
    counts = inside.groupBy(exact.alias("bin")).agg(F.count("*").alias("n"))
    spine = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.expr("0L"))
    total = counts.agg(F.sum("n")).scalar()
    joined = spine.join(counts, "bin", "left").select("bin", table[F.col("bin")].alias("low"), table[F.col("bin") + 1].alias("high"), n.alias("n"))
    return joined.withColumn("density", F.col("n") / (total * (F.col("high") - F.col("low"))))


def trimmed(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two quantiles of the column, both ends included (NaN and null in no range)."""
    bounds = exact_quantiles(df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))), column, [low, high])
    if bounds[0] is None:
        return df.limit(0)
    return df.filter(F.col(column).between(*bounds) & ~F.isnan(F.col(column).cast("double")))


def histogram_peak(df: DataFrame, column: str, domain: tuple[float, float] | None = None) -> float | None:
    """The histogram mode: values between the 1 % and 99 % quantiles (clamped to ``domain``), one bin per 1,000 of them (25 to 1,000 bins), a
    3-wide running median with the end values repeated, the first greatest bin, its centre. NaN when a value is NaN; None when no value is left.

    Equal counts are equal, whatever the rounding of bin widths; the first of them counts.
    """
    bounds = exact_quantiles(df, column, [0.01, 0.99])
    if bounds[0] is None or math.isnan(bounds[0]):
        return bounds[0]
    low, high = (max(bounds[0], domain[0]), min(bounds[1], domain[1])) if domain else bounds
    return peak_of(linear_histogram(df.filter(F.col(column).between(low, high)), column, most=1000)).first()["peak"]


def peak_of(bins: DataFrame) -> DataFrame:
    """peak, one row: the centre of the first greatest bin after a 3-wide running median; null without bins. A histogram has 1,000 bins at most, which one window holds."""
    along = W.orderBy("bin")
    three = F.array(F.coalesce(F.lag("n").over(along), "n"), F.col("n"), F.coalesce(F.lead("n").over(along), "n"))
    smooth = bins.select("bin", ((F.col("low") + F.col("high")) / 2).alias("centre"), F.sort_array(three)[1].alias("m"))
    return smooth.agg(F.max_by("centre", F.struct("m", -F.col("bin"))).alias("peak"))


def peak_row(df: DataFrame, column: str, domain: tuple[float, float] | None = None) -> DataFrame:
    """measure, peak: the histogram peak of a column as one row."""
    return df.sparkSession.range(1).select(F.lit(column).alias("measure"), F.lit(histogram_peak(df, column, domain)).cast("double").alias("peak"))


def measure_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """measure, n, mean, least, greatest, q01, q05, q95, q99 per column; null and NaN do not count."""
    rows = []
    for c in columns:
        good = df.filter(F.col(c).isNotNull() & ~F.isnan(c)).select(c)
        size = good.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")).first()
        rows.append((c, size["n"], size["mean"], size["low"], size["high"], *exact_quantiles(good, c, [0.01, 0.05, 0.95, 0.99])))
    return df.sparkSession.createDataFrame(rows, "measure string, n long, mean double, least double, greatest double, q01 double, q05 double, q95 double, q99 double")


#: Trial locations of the inverse-gamma fit: distances below the first bin, as powers of ten of the values' range.
LOCATIONS = [-4 + 5.5 * k / 299 for k in range(300)]
NEWTON = 12


def inverse_gamma_fit(bins: DataFrame) -> DataFrame:
    """location, shape, scale, one row: the likeliest inverse-gamma distribution of a histogram's values scaled to [0, 1]; no row for fewer than two filled bins.

    For a given location the maximum-likelihood shape and scale follow from two means over the bins; all trial locations are worked out at once, BINS x
    LOCATIONS rows aggregated map-side, and the likeliest is kept. The shape is found by Newton's steps, as an expression.
    """
    centre = (F.col("bin") + 0.5) / BINS
    first = 0.5 / BINS  # the least value lies in the first bin
    places = F.array(*[F.lit(first - 10**e) for e in LOCATIONS])
    y = 1 / (F.col("c") - F.col("location"))
    each = bins.filter("n > 0").select(centre.alias("c"), "n", F.explode(places).alias("location"))
    means = each.groupBy("location").agg(F.sum("n").alias("total"), F.count("*").alias("filled"), F.sum(F.col("n") * y).alias("m"), F.sum(F.col("n") * F.log(y)).alias("l"))
    means = means.filter("filled > 1").select("location", (F.col("m") / F.col("total")).alias("mean"), (F.col("l") / F.col("total")).alias("mean_log"))
    gap = F.log("mean") - F.col("mean_log")
    start = (3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap)
    step = lambda a, _: 1 / (1 / a + (F.log(a) - digamma(a) - gap) / (a * a * (1 / a - trigamma(a))))
    shaped = means.withColumn("shape", F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, step)).withColumn("scale", F.col("shape") / F.col("mean"))
    likely = F.col("shape") * F.log("scale") - log_gamma(F.col("shape")) + (F.col("shape") + 1) * F.col("mean_log") - F.col("scale") * F.col("mean")
    best = shaped.agg(F.max_by(F.struct("location", "shape", "scale"), likely).alias("b"))
    return best.filter("b is not null").select("b.*")


def inverse_gamma_curve(df: DataFrame, column: str, points: int = 500) -> DataFrame:
    """x, density of an inverse-gamma distribution fitted to the column's values, on ``points`` places from the least to the greatest value.

    Values are scaled to [0, 1] and counted in ``BINS`` bins (``inverse_gamma_fit``). Null and NaN do not count; fewer than two filled bins give no
    rows. Only the range and the three parameters come to the driver.
    """
    v = F.col(column).cast("double")
    span = df.filter(v.isNotNull() & ~F.isnan(v)).agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    found = inverse_gamma_fit(linear_histogram(df, column, bins=BINS)).first() if span["low"] is not None and span["low"] < span["high"] else None
    spark = df.sparkSession
    if found is None:
        return spark.createDataFrame([], "x double, density double")
    grid = spark.range(points).select((F.col("id") / float(max(points - 1, 1))).alias("g"))
    shape, scale, z = F.lit(found["shape"]), F.lit(found["scale"]), F.col("g") - F.lit(found["location"])
    density = F.when(z > 0, F.exp(shape * F.log(scale) - log_gamma(shape) - (shape + 1) * F.log(z) - scale / z)).otherwise(0.0)
    return grid.select((F.lit(span["low"]) + F.col("g") * (span["high"] - span["low"])).alias("x"), density.alias("density"))
