"""Filter texts such as ``r_xy>0``, ``center_intensity>=p25``, ``r_z<mean`` or ``r_xy_max_std<=peak``, and chains of them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import MEASURES, exact_quantiles, histogram_peak

# Fixed value: the accepted form of a filter text.
FILTER_PATTERN = re.compile(r"^([\w.]+)([<>=!]{1,2})(p|peak|mean)?(-?[0-9]*.?[0-9]*)$")
OPERATORS = ("<", "<=", ">", ">=", "==", "!=")


@dataclass(frozen=True)
class Filter:
    """One parsed filter; ``kind`` is None (fixed), 'p' (percentile), 'mean' or 'peak'."""

    column: str
    operator: str
    kind: str | None
    value: float

    def keeps(self, threshold: float | None) -> Column:
        """The rows kept at a threshold. NaN compares as in arithmetic: with NaN only != holds, on either side; null keeps nothing."""
        c = F.col(self.column).cast("double")
        if threshold is None:
            return F.lit(False)
        if math.isnan(threshold):
            return F.coalesce(c.isNotNull(), F.lit(False)) if self.operator == "!=" else F.lit(False)
        t = F.lit(float(threshold))
        test = {"<": c < t, "<=": c <= t, ">": c > t, ">=": c >= t, "==": c == t, "!=": c != t}[self.operator]
        return F.coalesce(test & ((self.operator == "!=") | ~F.isnan(c)), F.lit(False))


def parse_filter(text: str) -> Filter:
    """ValueError for anything else than column, comparison and a number, pNN, mean or peak. A number after mean or peak is ignored."""
    found = FILTER_PATTERN.match(text)
    if not found:
        raise ValueError(f"Not a filter: {text!r}")
    column, op, kind, number = found.groups()
    if op not in OPERATORS:
        raise ValueError(f"Not a comparison: {op!r} in {text!r}")
    if kind in ("mean", "peak"):
        return Filter(column, op, kind, 0.0)
    try:
        value = float(number)
    except ValueError:
        raise ValueError(f"Not a number: {number!r} in {text!r}") from None
    if kind == "p" and not 0 <= value <= 100:
        raise ValueError(f"Not a percentile: {value} in {text!r}")
    return Filter(column, op, kind, value)


def thresholds(df: DataFrame, filters: list[str]) -> list[tuple[Filter, float | None]]:
    """The filters with their thresholds: each adaptive one is taken over what the filters before it keep.

    Thresholds are scalars and become literals, so the filtered result needs no join and its predicates reach the scan. ``df`` is read again for every
    adaptive filter, only the columns involved; a caller whose ``df`` is costly (a join, current rows) writes it once before.
    """
    parsed = [parse_filter(t) for t in filters]
    rows = df.select(*dict.fromkeys(f.column for f in parsed))
    out = []
    for f in parsed:
        if f.kind == "p":
            value = exact_quantiles(rows, f.column, [f.value / 100])[0]
        elif f.kind == "mean":
            value = rows.agg(F.avg(F.col(f.column).cast("double"))).first()[0]
        elif f.kind == "peak":
            value = histogram_peak(rows, f.column, MEASURES.get(f.column))
        else:
            value = f.value
        out.append((f, value))
        rows = rows.filter(f.keeps(value))
    return out


def staged(df: DataFrame, filters: list[str]) -> DataFrame:
    """``df`` with removed_stage: the position (from 1) of the filter that removes a row, null where all keep it. No shuffle."""
    stage = F.lit(None).cast("int")
    for i, (f, value) in reversed(list(enumerate(thresholds(df, filters), start=1))):
        stage = F.when(~f.keeps(value), F.lit(i)).otherwise(stage)
    return df.withColumn("removed_stage", stage)


def filter_cells(df: DataFrame, filters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows; the removed ones carry removed_stage."""
    flagged = staged(df, filters)
    return flagged.filter("removed_stage is null").drop("removed_stage"), flagged.filter("removed_stage is not null")
