"""The gamma function's logarithm and its derivatives, for arrays and as column expressions, by their asymptotic series above a shift."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8


def _series(z, log):
    """log gamma(z) for z >= SHIFT."""
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)


def log_gamma_of(z: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers."""
    z = np.asarray(z, dtype=float)
    small = z < SHIFT
    below = np.where(small, z, 1.0)
    product = reduce(np.multiply, [below + k for k in range(SHIFT)])
    return _series(np.where(small, z + SHIFT, z), np.log) - np.where(small, np.log(product), 0.0)


def log_gamma(z: Column) -> Column:
    """log gamma of a positive column."""
    return _series(z + SHIFT, F.log) - F.log(reduce(lambda a, b: a * b, [z + k for k in range(SHIFT)]))


def digamma(z: Column) -> Column:
    """The first derivative of log gamma of a positive column."""
    s = z + SHIFT
    q = 1 / (s * s)
    return F.log(s) - 1 / (2 * s) - q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q * (F.lit(1 / 240) - q * (1 / 132))))) - reduce(lambda a, b: a + b, [1 / (z + k) for k in range(SHIFT)])


def trigamma(z: Column) -> Column:
    """The second derivative of log gamma of a positive column."""
    s = z + SHIFT
    q = 1 / (s * s)
    return 1 / s + q / 2 + q / s * (F.lit(1 / 6) - q * (F.lit(1 / 30) - q * (F.lit(1 / 42) - q / 30))) + reduce(lambda a, b: a + b, [1 / ((z + k) * (z + k)) for k in range(SHIFT)])
