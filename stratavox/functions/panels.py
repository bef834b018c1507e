"""What a reader of distribution panels sees beside the bars: the scale of quantiles along a trimmed axis, and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_to_quantile(x: Column, low: float, high: float, low_share: float, high_share: float) -> Column:
    """The place of a value on a linear scale that has ``low_share`` at ``low`` and ``high_share`` at ``high``; null where these are equal."""
    return F.try_divide((x - F.lit(low)) * (high_share - low_share), F.lit(float(high - low))) + F.lit(low_share)


def quantile_to_value(q: Column, low: float, high: float, low_share: float, high_share: float) -> Column:
    """The inverse of ``value_to_quantile``."""
    return (q - F.lit(low_share)) / F.lit(float(high_share - low_share)) * F.lit(float(high - low)) + F.lit(low)


def range_title(low: float, high: float, peak: float | None = None) -> str:
    """The title of a full-range panel, such as (0.5,   3*, 120): six significant digits, at least three wide, the peak starred."""
    middle = [] if peak is None else [f"{peak:3g}*"]
    return f"({', '.join([f'{low:3g}', *middle, f'{high:3g}'])})"
