"""Bounding-volume hierarchies over numpy boxes, ear clipping, and exact triangle tests: the helpers inside tasks.

Boxes have any number of dimensions; a discrete group (an image, a slice) is simply the first one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUCKET = 8
#: Queries searched at once, and candidates that they may have in memory.
QUERIES = 4096
CANDIDATES = 2_000_000


def _spread(values: np.ndarray) -> np.ndarray:
    """The bits of 20-bit numbers, three apart."""
    out = np.zeros(len(values), dtype=np.uint64)
    v = values.astype(np.uint64)
    for bit in range(20):
        out |= ((v >> np.uint64(bit)) & np.uint64(1)) << np.uint64(3 * bit)
    return out


def space_order(group: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """Order by group, then along a Z-curve through ``coords`` (n x up to 3)."""
    if not len(coords):
        return np.zeros(0, dtype=np.int64)
    low, span = coords.min(axis=0), np.maximum(np.ptp(coords, axis=0), 1e-300)
    cells = np.minimum((coords - low) / span * 2**20, 2**20 - 1).astype(np.int64)
    code = np.zeros(len(coords), dtype=np.uint64)
    for axis in range(coords.shape[1]):
        code |= _spread(cells[:, axis]) << np.uint64(axis)
    return np.lexsort((code, group))


class Hierarchy:
    """A binary hierarchy over boxes that are given in a compact order; leaves hold ``BUCKET`` boxes each."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.size = len(low)
        self.boxes = _columns(low, high)
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
        width = BUCKET
        while len(low):
            starts = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append(_columns(low, high))
            if len(low) == 1:
                break
            width = 2

    def touching(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, box) index pairs whose closed boxes touch."""
        return self._descend(low, high, None)

    def touching_parts(self, low: np.ndarray, high: np.ndarray, limit: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``touching`` in parts of whole queries, with about ``limit`` candidates in memory: where boxes are dense, parts get small."""
        todo = [np.arange(i, min(i + QUERIES, len(low))) for i in range(0, len(low), QUERIES)][::-1]
        while todo:
            part = todo.pop()
            found = self._descend(low[part], high[part], limit if len(part) > 1 else None)
            if found is None:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            elif len(found[0]):
                yield part[found[0]], found[1]

    def _descend(self, low: np.ndarray, high: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The touching pairs, or None where more than ``limit`` candidates would be open at once."""
        nothing = np.zeros(0, dtype=np.int64)
        if not len(low) or not self.levels:
            return nothing, nothing
        asked = _columns(low, high)
        query, node = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            query, node = _met(self.levels[depth], asked, query, node)
            fan = 2 if depth else BUCKET
            if limit is not None and fan * len(query) > limit:
                return None
            below = len(self.levels[depth - 1][0][0]) if depth else self.size
            query, node = np.repeat(query, fan), (node[:, None] * fan + np.arange(fan)).ravel()
            if node.max(initial=0) >= below:
                inside = node < below
                query, node = query[inside], node[inside]
        return _met(self.boxes, asked, query, node)


def _columns(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ends of boxes by dimension, the last first: place tells boxes apart sooner than the group does."""
    return [(np.ascontiguousarray(low[:, d]), np.ascontiguousarray(high[:, d])) for d in reversed(range(low.shape[1]))]


def _met(boxes: list, asked: list, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (query, node) pairs whose boxes touch; a dimension at a time, so that each tests what the ones before left."""
    for (low, high), (from_, to) in zip(boxes, asked):
        met = low[node] <= to[query]
        met &= from_[query] <= high[node]
        query, node = query[met], node[met]
    return query, node


def ear_clip(ring: np.ndarray) -> np.ndarray:
    """Triangles (m x 3 x 2) of a simple polygon (n x 2, either direction, not closed), by ear clipping.

    Collinear and repeated corners are clipped without a triangle; fewer than three corners give no triangle.
    """
    area2 = np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]) if len(ring) else 0.0
    points = [tuple(p) for p in (ring if area2 >= 0 else ring[::-1]).tolist()]

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    out, at, tries = [], 0, 0
    while len(points) >= 3 and tries <= len(points):
        n = len(points)
        i, j, k = (at - 1) % n, at % n, (at + 1) % n
        a, b, c = points[i], points[j], points[k]
        bend = turn(a, b, c)
        flat = bend == 0
        ear = bend > 0 and not any(
            p not in (a, b, c) and turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in points
        )
        if flat or ear:
            if ear:
                out.append((a, b, c))
            del points[j]
            at, tries = (j - 1 if j else 0), 0
        else:
            at, tries = at + 1, tries + 1
    return np.array(out, dtype=np.float64).reshape(-1, 3, 2)


def in_triangle(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Whether each point (n x 2) lies in its counter-clockwise triangle (n x 3 x 2), border included.

    The three orientation signs are exact where coordinates are multiples of a power of two, as voxel sub-steps are.
    """
    met = np.ones(len(points), dtype=bool)
    for i in range(3):
        a, b = triangles[:, i], triangles[:, (i + 1) % 3]
        met &= (b[:, 0] - a[:, 0]) * (points[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (points[:, 0] - a[:, 0]) >= 0
    return met
