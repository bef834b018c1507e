import math

import numpy as np
import pytest

from stratavox.functions.student import incomplete_beta, t_two_sided
from stratavox.operators import deseq, samples, stats


def test_student_tail():
    assert t_two_sided(np.array([2.1]), np.array([7.3]))[0] == pytest.approx(0.0722467134, abs=1e-9)
    p = t_two_sided(np.array([0.0, math.inf, math.nan, 12.706204736]), np.array([3.0, 3.0, 3.0, 1.0]))
    assert p[:2].tolist() == [1.0, 0.0] and math.isnan(p[2]) and p[3] == pytest.approx(0.05, abs=1e-8)
    assert incomplete_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)


OBS = "id int, sample string, group_label string, v double"


def test_welch_edges(spark):
    rows = [(1, f"s{i}", g, v) for i, (g, v) in enumerate([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 5.0), ("b", None), ("c", 9.0)])]
    rows += [(2, f"s{i}", g, v) for i, (g, v) in enumerate([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 1.0)])]
    got = {(r["id"], r["group_a"], r["group_b"]): r for r in stats.welch(stats.group_moments(spark.createDataFrame(rows, OBS), ["id"], "group_label", "v"), ["id"]).collect()}
    one = got[1, "a", "b"]
    va, vb = 1 / 3, 4.5 / 2
    assert one["t"] == pytest.approx((2 - 3.5) / math.sqrt(va + vb)) and one["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 2 + vb**2 / 1))
    assert 0 < one["p"] < 1 and math.isnan(got[1, "a", "c"]["p"])
    assert got[2, "a", "b"]["p"] == 0 and got[2, "a", "b"]["t"] == -math.inf and math.isnan(got[2, "a", "c"]["p"])


def test_benjamini_hochberg(spark):
    rows = [("x", 1, 0.01, True), ("x", 2, 0.03, True), ("x", 3, 0.04, True), ("x", 4, 0.2, True), ("x", 5, math.nan, True), ("x", 6, 0.001, False), ("x", 7, None, True), ("y", 1, 0.9, True)]
    df = spark.createDataFrame(rows, "family string, id int, p double, ok boolean")
    from pyspark.sql import functions as F

    got = {(r["family"], r["id"]): r["p_corr"] for r in stats.benjamini_hochberg(df, ["family"], testable=F.col("ok")).collect()}
    assert [got["x", i] for i in range(1, 8)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2, -1, -1, -1]) and got["y", 1] == 0.9


def simulated(spark, seed=3, regions=60, per=6):
    rng = np.random.default_rng(seed)
    rows, effect = [], {}
    for r in range(regions):
        mean, alpha = rng.uniform(50, 400), 0.05
        effect[r] = [0.0, 0.0, 0.0, 2.0, -2.0][r % 5]
        for g in ("a", "b"):
            for s in range(per):
                mu = mean * (1 + 0.3 * s) * 2 ** (effect[r] if g == "b" else 0)
                rows.append((r, f"{g}{s}", float(rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu)))))
    return spark.createDataFrame(rows, "region_id int, sample string, n double"), effect


def test_levels_recover_simulated_changes(spark):
    counts, effect = simulated(spark)
    meta = spark.createDataFrame([(f"{g}{s}", g) for g in "ab" for s in range(6)], "sample string, kind string")
    got = {r["region_id"]: r for r in deseq.compare_levels(counts, meta, ["kind"]).collect()}
    assert len(got) == 60 and all((r["factor"], r["level_a"], r["level_b"]) == ("kind", "a", "b") for r in got.values())
    errors = [got[r]["log2_fold_change"] + effect[r] for r in got]
    assert abs(float(np.median(errors))) < 0.35 and float(np.std(errors)) < 0.5
    changed = [got[r]["padj"] for r in got if effect[r]]
    same = [got[r]["pvalue"] for r in got if not effect[r]]
    assert max(changed) < 0.01 and np.mean(np.array(same) < 0.05) < 0.25
    silent = counts.unionByName(spark.createDataFrame([(r, "b9", 0.0) for r in range(60)], counts.schema))
    more = deseq.compare_levels(silent, meta.unionByName(spark.createDataFrame([("b9", "b")], meta.schema)), ["kind"])
    assert {r["region_id"]: round(r["log2_fold_change"], 6) for r in more.collect()} == {k: round(r["log2_fold_change"], 6) for k, r in got.items()}
    factors = {r["sample"]: r["size_factor"] for r in deseq.size_factors(counts).collect()}
    assert factors["a5"] / factors["a0"] == pytest.approx(2.5, rel=0.2)


def test_wide_levels_mark_what_was_left_out(spark):
    regions = spark.createDataFrame([(1, "a"), (2, "b")], "region_id int, name string")
    levels = spark.createDataFrame([("f", "x", "y", 1, 2.0, 0.5, 0.1, 5.0, 0.01, None)], "factor string, level_a string, level_b string, region_id int, base_mean double, log2_fold_change double, lfc_se double, stat double, pvalue double, padj double")
    wide = {r["region_id"]: r for r in stats.levels_wide(regions, levels).collect()}
    assert wide[1]["f:x-vs-y:baseMean"] == 2.0 and math.isnan(wide[1]["f:x-vs-y:padj"]) and wide[2]["f:x-vs-y:padj"] == -1 and wide[2]["name"] == "b"


def test_nothing_to_compare(spark):
    counts, _ = simulated(spark, regions=3, per=2)
    one = spark.createDataFrame([("a0", "a"), ("a1", "a")], "sample string, kind string")
    assert deseq.compare_levels(counts, one, ["kind"]).count() == 0
    assert deseq.compare_levels(counts.limit(0), one, ["kind"]).count() == 0


def test_size_factors_without_a_full_region(spark):
    rows = [(1, "a", 0), (1, "b", 4), (2, "a", 4), (2, "b", 0), (3, "a", 0), (3, "b", 0)]
    got = deseq.size_factors(spark.createDataFrame(rows, "region_id int, sample string, n int")).collect()
    assert {r["sample"]: r["size_factor"] for r in got} == pytest.approx({"a": 1.0, "b": 1.0})


META = "image_name string, condition_name string, genotype string, sex string, loaded_at int"


def test_metadata_groups_and_exclusions(spark):
    rows = [("i1", " Ctl ", "WT", "F", 1), ("i1", "Old", "WT", "F", 0), ("i2", "ctl", None, "m", 1), (" ", "x", "x", "x", 1), (None, "x", "x", "x", 1), ("i3", "drug", "ko", "F", 1)]
    meta = samples.latest_metadata(spark.createDataFrame(rows, META))
    assert sorted(r["image_name"] for r in meta.collect()) == ["i1", "i2", "i3"]
    got = {r["sample"]: r["group_label"] for r in samples.grouped_metadata(meta, ["condition_name", "genotype"], [{"condition_name": "CTL", "sex": "M"}, {"genotype": "KO"}]).collect()}
    assert got == {"i1": "ctl-wt"}


def test_region_exclusion_inclusion_and_wide(spark):
    from test_atlas import outline

    from stratavox.operators import atlas

    tree = atlas.outline_tree(outline(spark))
    gone = lambda **k: sorted(r[0] for r in samples.excluded_regions(tree, **k).collect())
    assert gone(exclude=[10]) == [10, 11, 20010] and gone(include=[12]) == [10, 11, 20010] and gone(include=[1]) == [] and gone(include=[11], exclude=[12]) == [12, 20010]
    rows = [(i, s, g, float(i * 10 + k)) for i in (11, 12, 77, 10) for k, (s, g) in enumerate([("s1", "b"), ("s2", "a"), ("s3", "b")])]
    obs = spark.createDataFrame(rows, "id int, sample string, group_label string, v double")
    assert {(r["id"], r["testable"]) for r in samples.with_leaf_flag(obs, tree).collect()} == {(11, True), (12, True), (77, True), (10, False)}
    wide = samples.raw_wide(obs, ["id"], ["v"])
    assert wide.columns == ["id", "s2:v", "s1:v", "s3:v"]
    means = {r["id"]: tuple(r)[1:] for r in samples.group_means_wide(obs, ["id"], ["v"]).collect()}
    assert means[11] == (1, 2, 111.0, 111.0)


def test_the_trend_of_dispersions_is_recovered(spark):
    rows = [(float(m), 2.0 / m + 0.1) for m in range(1, 200)] + [(5.0, 1e-9), (0.0, 1.0)]
    a1, a0 = deseq.fit_trend(spark.createDataFrame(rows, "base_mean double, dispersion double"))
    assert abs(a1 - 2) < 1e-6 and abs(a0 - 0.1) < 1e-6
    assert deseq.trend_deviation(spark.createDataFrame(rows[:199], "base_mean double, dispersion double"), a1, a0) < 1e-6
    assert deseq.fit_trend(spark.createDataFrame([(1.0, 0.3)], "base_mean double, dispersion double")) == (0.0, 0.3)
    assert deseq.fit_trend(spark.createDataFrame([], "base_mean double, dispersion double")) == (0.0, 0.1)
