"""Cutoffs that keep a target share of each source's records (problem 1).

Method, cutting-plane order statistic: the k-th smallest value of a source is the only minimum of a convex pinball loss. Each pass
aggregates counts and sums of the records between trial cuts, which give losses and subgradients at all of them; the tangents at both ends of
the bracket meet at the next cut, and more cuts lie around it and along the bracket. The bracket goes where the subgradient changes sign, and
its ends are snapped to the neighbouring record values, so it closes on the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sized_join import sized_join
from ..session import Stash

#: Records are written anew once the brackets hold at most this share of what the last writing holds.
CONTRACT = 0.25
#: Trial cuts of a pass: this many parts along the bracket, and on either side of where the tangents meet.
SPREAD = 16
NEAR = 6


def target_rank(n: Column, permille: Column) -> Column:
    """ceil(permille * n / 1000) in whole numbers, between 0 and n."""
    return F.least(F.greatest(F.expr("0L"), F.floor((permille.cast("long") * n + 999) / 1000).cast("long")), n)


def _trial(state: DataFrame) -> DataFrame:
    """Of open brackets: sid, lo, hi, t (where the tangents meet) and w (half-way in magnitude, so that far outliers cost few passes)."""
    lo, hi = F.col("lo"), F.col("hi")
    meet = (F.col("f_hi") - F.col("f_lo") + F.col("g_lo") * lo - F.col("g_hi") * hi) / (F.col("g_lo") - F.col("g_hi"))
    between = lambda c, other: F.when((c >= lo) & (c < hi), c).otherwise(other)
    size = F.sqrt(F.abs(lo)) * F.sqrt(F.abs(hi))
    w = F.when((lo < 0) & (hi > 0), F.lit(0.0)).when(lo >= 0, size).otherwise(-size)
    return state.select("sid", "lo", "hi", between(meet, between(lo / 2 + hi / 2, lo)).alias("t"), between(w, lo).alias("w"))


def _piece() -> Column:
    """How many of the trial cuts lie below v: rising in v, whatever the cuts. The first cut is the lower end, so its value is a piece of its own."""
    v, lo, hi, t = (F.col(c) for c in ("v", "lo", "hi", "t"))
    cuts = [lo, t, F.col("w"), *(lo * (1 - k / SPREAD) + hi * (k / SPREAD) for k in range(1, SPREAD))]
    for j in range(1, NEAR + 1):
        cuts += [t * (1 - 0.25**j) + hi * 0.25**j, t * (1 - 0.25**j) + lo * 0.25**j]
    total = F.lit(0)
    for cut in cuts:
        total = total + (v > cut).cast("int")
    return total


def _narrow(state: DataFrame, inside: DataFrame) -> DataFrame:
    """The brackets of ``state`` after one pass over the records ``inside`` (with sid, v, lo, hi, t, w).

    The subgradient of the loss at a cut with m records at or below it is n (m - k + 1/2); it changes sign in the first piece that brings m to k,
    whose least and greatest values are the new ends. Losses there follow from the sums below.
    """
    pieces = inside.groupBy("sid", _piece().alias("piece")).agg(F.count("*").alias("c"), F.sum("v").alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
    n, k = F.col("n"), F.col("k")
    upto = W.partitionBy("sid").orderBy("piece")
    m, total = F.col("n_below") + F.sum("c").over(upto), F.col("s_below") + F.sum("s").over(upto)
    joined = state.select("sid", "n", "k", "total", "n_below", "s_below").join(pieces, "sid").withColumn("m", m).withColumn("upto", total)
    turn = joined.filter((n * (F.col("m") - k + F.lit(0.5)) > 0) & (n * (F.col("m") - F.col("c") - k + F.lit(0.5)) < 0))
    below, s_below = F.col("m") - F.col("c"), F.col("upto") - F.col("s")

    def loss(x: Column, count: Column, summed: Column) -> Column:
        return (k - F.lit(0.5)) * ((F.col("total") - summed) - x * (n - count)) + (n - k + F.lit(0.5)) * (x * count - summed)

    lo, hi = F.col("least"), F.col("most")
    return turn.select(
        "sid", "n", "k", "total", lo.alias("lo"), loss(lo, below, s_below).alias("f_lo"), (n * (below - k + F.lit(0.5))).alias("g_lo"), below.alias("n_below"), s_below.alias("s_below"),
        hi.alias("hi"), loss(hi, F.col("m"), F.col("upto")).alias("f_hi"), (n * (F.col("m") - k + F.lit(0.5))).alias("g_hi"), F.col("m").alias("n_upto"),
    )


def order_statistics(records: DataFrame, ranks: DataFrame | None = None, permille: DataFrame | None = None) -> DataFrame:
    """The k-th smallest value of each source: sid, n, k, cutoff, n_kept (records at or below the cutoff, ties included).

    records: sid long, v double (no null or NaN; infinite values are the lowest and highest records). Give either ``ranks`` (sid, k) or ``permille`` (sid, permille; k = ceil(permille * n / 1000)).
    Sources without records or with k = 0 are left out.

    Passes go on until every bracket has closed; each pass at least drops the value at one end and all but a sixteenth of the bracket's width, in
    practice all but a small part of the records. A pass is one scan with map-side aggregation per source and piece, so a source may hold any
    share of the records; the brackets are broadcast when their number is small, else joined by a shuffle in which large sources are spread.
    Per-source states stay tables; only their number and the size of the brackets come to the driver, taken while a state is written. Once
    brackets are small, what lies in them is written anew and only that is scanned.
    """
    v = F.col("v")
    finite = F.when(F.abs(v) < float("inf"), v)
    start = records.groupBy("sid").agg(
        F.count("*").alias("n_all"), F.count_if(v == float("-inf")).alias("n_lowest"), F.count(finite).alias("n"), F.sum(finite).alias("total"), F.min(finite).alias("lo"), F.max(finite).alias("hi")
    )
    wanted = start.join(ranks, "sid") if ranks is not None else start.join(permille, "sid").withColumn("k", target_rank(F.col("n_all"), F.col("permille")))
    wanted = Stash(wanted.filter((F.col("k") > 0) & (F.col("k") <= F.col("n_all"))).select(*start.columns, "k"), "wanted").df
    # infinite values need no search: they are the lowest and the highest records
    lowest = wanted.filter(F.col("k") <= F.col("n_lowest")).select("sid", F.col("n_all").alias("n"), "k", F.lit(float("-inf")).alias("cutoff"), F.col("n_lowest").alias("n_kept"))
    highest = wanted.filter(F.col("k") > F.col("n_lowest") + F.col("n")).select("sid", F.col("n_all").alias("n"), "k", F.lit(float("inf")).alias("cutoff"), F.col("n_all").alias("n_kept"))
    searched = wanted.withColumn("k", F.col("k") - F.col("n_lowest")).filter((F.col("k") > 0) & (F.col("k") <= F.col("n")))
    n, k = F.col("n"), F.col("k")
    first = searched.select(
        "sid", "n", "k", "total", "lo", ((k - F.lit(0.5)) * (F.col("total") - n * F.col("lo"))).alias("f_lo"), (n * (F.lit(0.5) - k)).alias("g_lo"), F.expr("0L").alias("n_below"), F.lit(0.0).alias("s_below"),
        "hi", ((n - k + F.lit(0.5)) * (n * F.col("hi") - F.col("total"))).alias("f_hi"), (n * (n - k + F.lit(0.5))).alias("g_hi"), n.alias("n_upto"),
    )
    is_open = F.col("lo") < F.col("hi")
    sizes = {"sources": F.count_if(is_open), "rows": F.sum(F.when(is_open, F.col("n_upto") - F.col("n_below")).otherwise(0)), "all": F.sum("n")}
    state = Stash(first, "brackets", sizes)
    stored, held, rows_stored = records.select("sid", "v").filter(finite.isNotNull()), None, state.seen["all"]
    while state.seen["sources"]:
        going = state.df.filter(is_open)
        brackets = _trial(going)
        inside = sized_join(stored, brackets, ["sid"], row_bytes=40, rows=state.seen["sources"]).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        if state.seen["rows"] <= CONTRACT * rows_stored:
            fresh = Stash(inside.select("sid", "v"), "inside")
            if held:
                held.drop()
            held, stored, rows_stored = fresh, fresh.df, state.seen["rows"]
            inside = sized_join(stored, brackets, ["sid"], row_bytes=40, rows=state.seen["sources"])
        after = Stash(_narrow(going, inside).unionByName(state.df.filter(~is_open)), "brackets", sizes)
        state.drop()
        state = after
    if held:
        held.drop()
    found = state.df.select("sid", "n", "k", F.col("lo").alias("cutoff"), F.col("n_upto").alias("n_kept"))
    back = found.join(wanted.select("sid", "n_all", "n_lowest"), "sid").select("sid", F.col("n_all").alias("n"), (F.col("k") + F.col("n_lowest")).alias("k"), "cutoff", (F.col("n_kept") + F.col("n_lowest")).alias("n_kept"))
    return back.unionByName(lowest).unionByName(highest)


def keep_fraction(records: DataFrame, targets: DataFrame, source: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cutoffs per source, and the kept records.

    records: the ``source`` columns, row_id, value (double). targets: the ``source`` columns, keep_side ('high' or 'low'), keep_permille.
    Cutoffs: source columns, keep_side, keep_permille, n, k, cutoff, n_kept; the k-th highest (or lowest) value with k = ceil(keep_permille * n / 1000).
    A target without records has n = 0; with k = 0 nothing is kept and the cutoff is null. Kept: source columns, row_id of all
    records at or beyond the cutoff, ties too. Records with a null or NaN value or without a target are no records. Targets with a null side or permille or a
    null source keep nothing and are left out; of repeated targets of a source one counts (largest permille).
    """
    usable = targets.filter(F.col("keep_side").isin("high", "low") & F.col("keep_permille").isNotNull())
    for c in source:
        usable = usable.filter(F.col(c).isNotNull())
    one = usable.groupBy(*source).agg(F.max(F.struct("keep_permille", "keep_side")).alias("t")).select(*source, "t.keep_permille", "t.keep_side")
    aims = Stash(one.withColumn("sid", F.monotonically_increasing_id()), "targets").df
    good = sized_join(records.select(*source, "row_id", "value").filter(F.col("value").isNotNull() & ~F.isnan("value")), aims, source)
    signed = F.when(F.col("keep_side") == "high", -F.col("value")).otherwise(F.col("value"))
    written = Stash(good.select("sid", "row_id", signed.cast("double").alias("v")), "records").df
    values = written.select("sid", "v")
    found = Stash(order_statistics(values, permille=aims.select("sid", F.col("keep_permille").alias("permille"))), "cutoffs").df
    counts = values.groupBy("sid").agg(F.count("*").alias("n_all"))
    cutoffs = aims.join(counts, "sid", "left").join(found.drop("n"), "sid", "left").select(
        *source, "keep_side", "keep_permille", F.coalesce("n_all", F.expr("0L")).alias("n"), F.coalesce("k", F.expr("0L")).alias("k"),
        F.when(F.col("keep_side") == "high", -F.col("cutoff")).otherwise(F.col("cutoff")).alias("cutoff"), F.coalesce("n_kept", F.expr("0L")).alias("n_kept"),
    )
    limits = found.select("sid", "cutoff").join(aims.select("sid", *source), "sid")
    kept = sized_join(written, limits, ["sid"]).filter(F.col("v") <= F.col("cutoff")).select(*source, "row_id")
    return cutoffs, kept
