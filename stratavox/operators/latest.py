"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINT_KEY = ("image_name", "channel", "det_no")


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in ascending ``order``.

    One shuffle on the full key and one sort. Keys are many and small, so no group is large; null keys are one key. The last row
    is the one that no row follows, which needs no ranking. Rows equal in ``order`` leave one of them; give a unique last
    column to fix which one. An empty table gives an empty table.
    """
    marker = "__follows"
    follows = F.lead(F.lit(1)).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(marker, follows).filter(F.col(marker).isNull()).drop(marker)


def current_cells(cells: DataFrame) -> DataFrame:
    """Current rows of points: the latest ``loaded_at`` of (image_name, channel, det_no), on a tie the largest ``cell_ord``.

    A null ``loaded_at`` is the earliest.
    """
    return latest_rows(cells, list(POINT_KEY), [F.col("loaded_at").asc_nulls_first(), F.col("cell_ord").asc_nulls_first()])
