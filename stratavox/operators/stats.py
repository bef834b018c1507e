"""Comparisons between groups of samples: Welch's t-test and Benjamini-Hochberg correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.student import t_p_value
from ..session import Stash

NAN = float("nan")


def group_moments(obs: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, group, n, mean, variance (NaN for one value) of non-null values; one map-side aggregation."""
    return obs.groupBy(*keys, F.col(group).alias("group")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(NAN)).alias("variance")
    ).filter("n > 0")


def _ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: NaN for 0 / 0, infinite for x / 0."""
    zero = F.when(a == 0, F.lit(NAN)).when(F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def welch(moments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group_a, group_b (a before b by name), t, df, p for every pair of groups of ``group_moments``.

    t and df are NaN where a group has one value or both variances and the difference are 0; with both variances 0 and different means t
    is infinite and p 0. The join is on the keys; the pairs are pairs of groups, not of samples. Moments are written once, as both sides read them.
    """
    moments = Stash(moments, "moments").df
    other = moments.select(*keys, F.col("group").alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("variance").alias("variance_b"))
    both = moments.join(other, keys).filter(F.col("group") < F.col("group_b"))
    a, b = F.col("variance") / F.col("n"), F.col("variance_b") / F.col("n_b")
    single = (F.col("n") < 2) | (F.col("n_b") < 2)
    t = F.when(single, NAN).otherwise(_ratio(F.col("mean") - F.col("mean_b"), F.sqrt(a + b)))
    parts = a * a / F.greatest(F.col("n") - 1, F.lit(1)) + b * b / F.greatest(F.col("n_b") - 1, F.lit(1))
    df = F.when(single, NAN).otherwise(_ratio((a + b) * (a + b), parts))
    made = both.select(*keys, F.col("group").alias("group_a"), "group_b", t.alias("t"), df.alias("df"))
    # without any variance df is 0 / 0; an infinite t has p 0 for every df
    sure = F.when(F.isnan("df") & ~F.isnan("t"), 1.0).otherwise(F.col("df"))
    return made.withColumn("p", F.coalesce(t_p_value("t", sure), F.lit(NAN)))


def benjamini_hochberg(tests: DataFrame, families: list[str], p: str = "p", testable: Column | None = None, name: str = "p_corr") -> DataFrame:
    """``tests`` with Benjamini-Hochberg corrected p values per family; -1 where p is null or NaN or the row is not ``testable``.

    A family is the regions of one comparison: a dictionary's size.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(p) & F.coalesce(F.lit(True) if testable is None else testable, F.lit(False))
    flagged = tests.withColumn("__valid", valid)
    own = W.partitionBy(*families, "__valid")
    ranked = flagged.withColumn("__m", F.count("*").over(own)).withColumn("__rank", F.row_number().over(own.orderBy(p)))
    later = own.orderBy(F.col("__rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    corrected = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(later))
    return ranked.withColumn(name, F.when(F.col("__valid"), corrected).otherwise(-1.0)).drop("__valid", "__m", "__rank")


def analyzed_wide(tests: DataFrame, keys: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row per region with ``p: a vs. b`` and ``p-corr: a vs. b`` per pair of groups, of ``tests`` with p and p_corr. Pairs come in sorted order."""
    if pairs is None:
        pairs = [tuple(r) for r in tests.select("group_a", "group_b").distinct().orderBy("group_a", "group_b").collect()]
    label = F.concat("group_a", F.lit(" vs. "), "group_b")
    names = [f"{a} vs. {b}" for a, b in pairs]
    wide = tests.withColumn("__pair", label).groupBy(*keys).pivot("__pair", names).agg(F.first("p").alias("p"), F.first("p_corr").alias("c"))
    columns = [c for name in names for c in (F.col(f"`{name}_p`").alias(f"p: {name}"), F.col(f"`{name}_c`").alias(f"p-corr: {name}"))]
    return wide.select(*keys, *columns)


LEVEL_MEASURES = {"baseMean": "base_mean", "log2FoldChange": "log2_fold_change", "lfcSE": "lfc_se", "stat": "stat", "pvalue": "pvalue", "padj": "padj"}


def levels_wide(regions: DataFrame, levels: DataFrame, contrasts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``regions`` (with region_id) with ``factor:a-vs-b:measure`` columns of a negative-binomial comparison; -1 for regions that it left out, NaN where it is undefined."""
    if contrasts is None:
        contrasts = [tuple(r) for r in levels.select("factor", "level_a", "level_b").distinct().orderBy("factor", "level_a", "level_b").collect()]
    names = [f"{f}:{a}-vs-{b}" for f, a, b in contrasts]
    label = F.concat("factor", F.lit(":"), "level_a", F.lit("-vs-"), "level_b")
    wide = levels.withColumn("__contrast", label).groupBy("region_id").pivot("__contrast", names).agg(*[F.first(F.coalesce(c, F.lit(NAN))).alias(m) for m, c in LEVEL_MEASURES.items()])
    columns = [F.coalesce(F.col(f"`{n}_{m}`"), F.lit(-1.0)).alias(f"{n}:{m}") for n in names for m in LEVEL_MEASURES]
    return regions.join(wide, "region_id", "left").select(*[regions[c] for c in regions.columns], *columns)
