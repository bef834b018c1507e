"""Tail probabilities of Student's t and the normal distribution as vectorised column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gamma import log_gamma_of


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz), for arrays."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    gamma = log_gamma_of
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        low = front * h
    low = np.where(y <= 0, 0.0, low)
    return np.where(swap, 1 - low, low)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN for a NaN argument, 0 for an infinite t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    bad = np.isnan(t) | np.isnan(df) | (df <= 0)
    endless = np.isinf(t) & ~bad
    safe_t, safe_df = np.where(bad | endless, 0.0, t), np.where(bad | np.isinf(df), 1.0, df)
    p = incomplete_beta(safe_df / 2, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t**2))
    return np.where(bad, np.nan, np.where(endless, 0.0, p))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.nan if math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)) for v in np.asarray(z, float)])


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Column function: two-sided p of Student's t."""
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
