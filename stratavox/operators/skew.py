"""Per-key results when a few keys hold most rows (problem 3).

Method, exact offset chunking: keys are counted per input partition, the counts are prefix-summed into offsets, every row gets
its exact number within its key, equal-sized chunks of a key are processed, and the ordered states of the chunks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stash
from .sized_join import sized_join

CHUNK_ROWS = 50_000


def _running_number(key: str):
    """Numbers the rows of a key within one partition, in the order in which they arrive."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        seen: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, values = pd.factorize(batch.column(batch.schema.get_field_index(key)).to_pandas(), use_na_sentinel=False)
            # None and NaN are one key; a key's rows keep their order
            names = [None if x is None or x != x else x for x in values]
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(values))
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            before = np.array([seen.get(x, 0) for x in names], dtype=np.int64)
            nth = np.empty(len(codes), dtype=np.int64)
            nth[order] = np.arange(len(codes)) - np.repeat(starts - before, counts)
            for x, n, b in zip(names, counts, before):
                seen[x] = int(n + b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "__nth"])

    return number


def number_rows(df: DataFrame, key: str, order_by: list[str] | None = None, over: int = 0) -> tuple[DataFrame, Stash]:
    """``df`` with ``row_no``, the exact number from 0 of each row among the rows of its key, and the table behind it.

    With ``order_by`` rows are numbered in that order (range partitions of the order columns, which do not depend on the key, so no
    partition is hot); else in the order of the input partitions. The partition-wise numbers are written once, so that a
    lost executor cannot change them. Null is a key of its own. Columns named __nth, __part or row_no are replaced.
    Only (key, partition) counts are shuffled: a hot key has one count per partition.

    Keys of at most ``over`` rows get no number (row_no is null): who cuts keys into chunks of ``over`` rows has nothing to cut there. So
    offsets exist for the large keys alone, however many small keys there are.
    """
    df = df.drop("__nth", "__part", "row_no")
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    schema = T.StructType([*df.schema.fields, T.StructField("__nth", T.LongType())])
    written = Stash(df.mapInArrow(_running_number(key), schema).withColumn("__part", F.spark_partition_id()), "numbered")
    rows = written.df
    counts = rows.groupBy("__part", key).agg(F.count("*").alias("__n"))
    own = W.partitionBy(key)
    before = own.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # a struct around the key compares null with null
    offsets = counts.select("__part", F.struct(F.col(key).alias("k")).alias("__key"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(own).alias("__all"))
    offsets = Stash(offsets.filter(F.col("__all") > over).drop("__all"), "offsets", {"rows": F.count("*")})
    keyed = rows.withColumn("__key", F.struct(F.col(key).alias("k")))
    # a (partition, key) pair holds at most one partition's rows, so none is hot where the offsets are too many to broadcast
    joined = sized_join(keyed, offsets.df, ["__part", "__key"], "left", rows=offsets.seen["rows"])
    return joined.select(*df.columns, (F.col("__nth") + F.col("__offset")).alias("row_no"), "__part", "__nth"), written


def key_counts(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, n_rows, n_chunks over all rows, null being a key: rows are numbered, counted per chunk, and the chunks of a key merged.

    No row is shuffled: numbering needs (key, partition) counts only, and a chunk's count is aggregated map-side. An empty table gives no rows.
    """
    rows, _ = number_rows(df.select(key), key, over=chunk_rows)
    chunks = rows.groupBy(key, _chunk(chunk_rows).alias("__chunk")).agg(F.count("*").alias("__n"))
    return chunks.groupBy(key).agg(F.sum("__n").alias("n_rows"), F.count("*").alias("n_chunks"))


def _chunk(chunk_rows: int) -> Column:
    """The chunk of a numbered row; a key that has no numbers is one chunk."""
    return F.coalesce(F.floor(F.col("row_no") / chunk_rows), F.lit(0))


def ordered_profile(df: DataFrame, key: str, order_by: list[str], value: str, label: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key, over its rows in ``order_by`` order: counts and results that depend on the order.

    Result: key, n_rows, n_values (not null, not NaN), total, first_value, last_value, n_steps, n_rises (a value above the value just before),
    n_runs (maximal runs of equal ``label``, null being a label of its own). Rows whose value is null or NaN count in n_rows and n_runs only.

    Every chunk holds at most ``chunk_rows`` rows of a key and is one sort group, however hot the key; its state (counts, first and
    last) is one row. The states of a key are then merged in order: only what crosses a chunk's border is added. A key has
    rows / chunk_rows states, so that merge is small. ``order_by`` must be unique for a defined result.
    """
    rows, _ = number_rows(df.select(key, *dict.fromkeys([*order_by, value, label])), key, order_by, chunk_rows)
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    cut = rows.select(
        F.col(key).alias("__key"), _chunk(chunk_rows).alias("__chunk"), F.struct("__part", "__nth").alias("row_no"),
        F.when(good, F.col(value).cast("double")).alias("__v"), F.struct(F.col(label)).alias("__l"),
    )
    w = W.partitionBy("__key", "__chunk").orderBy("row_no")
    prior = F.last("__v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    stepped = cut.withColumn("__p", prior).withColumn("__pl", F.lag("__l").over(w))
    states = stepped.groupBy("__key", "__chunk").agg(
        F.count("*").alias("n"), F.count("__v").alias("nv"), F.sum("__v").alias("s"),
        F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("row_no"))).alias("fv"), F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("row_no"))).alias("lv"),
        F.count_if(F.col("__v").isNotNull() & F.col("__p").isNotNull()).alias("steps"), F.count_if(F.col("__v") > F.col("__p")).alias("rises"),
        F.count_if(F.col("__pl").isNull() | ~F.col("__pl").eqNullSafe(F.col("__l"))).alias("runs"),
        F.min_by("__l", "row_no").alias("fl"), F.max_by("__l", "row_no").alias("ll"),
    )
    over = W.partitionBy("__key").orderBy("__chunk")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    merged = states.withColumn("pv", F.last("lv", ignorenulls=True).over(earlier)).withColumn("pl", F.lag("ll").over(over))
    border = F.col("fv").isNotNull() & F.col("pv").isNotNull()
    return merged.groupBy(F.col("__key").alias(key)).agg(
        F.sum("n").alias("n_rows"), F.sum("nv").alias("n_values"), F.sum("s").alias("total"),
        F.min_by("fv", F.when(F.col("fv").isNotNull(), F.col("__chunk"))).alias("first_value"), F.max_by("lv", F.when(F.col("lv").isNotNull(), F.col("__chunk"))).alias("last_value"),
        (F.sum("steps") + F.count_if(border)).alias("n_steps"), (F.sum("rises") + F.count_if(border & (F.col("fv") > F.col("pv")))).alias("n_rises"),
        (F.sum("runs") - F.count_if(F.col("pl").isNotNull() & F.col("pl").eqNullSafe(F.col("fl")))).alias("n_runs"),
    )


def hot_keys(df: DataFrame, key: str, permille: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys (null is none) that hold at least ``permille`` thousandths of all rows, rows with a null key included in the total."""
    counted = Stash(key_counts(df, key, chunk_rows), "counts", {"total": F.sum("n_rows")})
    # as a long: a literal below 2 ** 31 is an int, and its product overflows long before the count does
    total = F.lit(counted.seen["total"]).cast("long")
    return counted.df.filter(F.col(key).isNotNull() & (F.col("n_rows") * 1000 >= total * permille)).select(key, "n_rows", "n_chunks")
