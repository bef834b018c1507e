"""Points near other points, and the region that contains a point (problem 2).

Method: search areas and regions are polygons, triangulated by ear clipping; triangles are distributed through bounding-volume
hierarchies (a top one over tasks, one inside each task); candidate triangles are tested exactly; what is found twice on a border
shared by two triangles is made one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stash
from .bvh import Hierarchy, ear_clip, in_triangle, space_order

#: Rows meant for one leaf of the top hierarchy, and bound on its leaves, so on what the driver and a broadcast hold of it.
TASK_ROWS = 20_000
MAX_LEAVES = 20_000
#: The top hierarchy is fitted on so many sampled rows a leaf, but at most SAMPLE_ROWS; then all rows are counted.
LEAF_SAMPLE = 16
SAMPLE_ROWS = LEAF_SAMPLE * MAX_LEAVES
#: A leaf that exact counts show to hold more than so many times its target is split again, so many times at most; …
OVERFULL = 4
ROUNDS = 6
#: … what is left together is dealt to several tasks. A task holds so many rows at once, whatever the size of its leaf.
BLOCK_ROWS = 40_000
#: A null id while it passes through pandas, which would read whole numbers with a null as floats.
NO_ID = -(2**63)


class SpaceTree:
    """Splits (group, z, y, x) space into leaves. Groups are ordered by name, so groups that no sample row has fall into place too."""

    def __init__(self, names: list[str], split: list[tuple[int, float, int, int]], leaves: int):
        self.names, self.leaves = np.array(names, dtype=object), leaves
        self.axis, self.at, self.left, self.right = (np.array(x) for x in zip(*split)) if split else (np.zeros(0, dtype=np.int64),) * 4
        #: per leaf: rows by exact count, and the longest axis (0 to 2: z, y, x)
        self.rows, self.longest = np.zeros(leaves, dtype=np.int64), np.zeros(leaves, dtype=np.int64)

    def deal(self, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Per leaf, the number of its first task and how many tasks it has, of at most about ``most`` rows each."""
        blocks = np.maximum(1, np.ceil(self.rows / most)).astype(np.int64)
        return np.cumsum(blocks) - blocks, blocks

    def ranks(self, groups: np.ndarray) -> np.ndarray:
        """2 i + 1 for the i-th known name, the even number between for a name that lies between known ones."""
        back, unique = pd.factorize(groups)
        unique = unique.astype(str)
        at = np.searchsorted(self.names.astype(str), unique) if len(self.names) else np.zeros(len(unique), dtype=np.int64)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]].astype(str) == unique[inside]
        return (2.0 * at + known)[back]

    def leaves_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of the leaves that closed boxes reach; a point (low = high) reaches exactly one."""
        row, node = np.arange(len(low)), np.full(len(low), 0 if len(self.axis) else -1, dtype=np.int64)
        rows, leaves = [], []
        while True:
            done = node < 0
            rows.append(row[done])
            leaves.append(-node[done] - 1)
            row, node = row[~done], node[~done]
            if not len(row):
                return np.concatenate(rows), np.concatenate(leaves)
            axis, at = self.axis[node], self.at[node]
            goes_left, goes_right = low[row, axis] < at, high[row, axis] >= at
            row, node = np.concatenate([row[goes_left], row[goes_right]]), np.concatenate([self.left[node[goes_left]], self.right[node[goes_right]]])


def fit_tree(sample: pd.DataFrame, weight: np.ndarray, per_leaf: float) -> SpaceTree:
    """A tree over the columns g, z, y, x of a bounded sample; a row stands for ``weight`` rows; leaves stand for up to ``per_leaf``."""
    names = sorted(sample["g"].astype(str).unique())
    place = {n: 2.0 * i + 1 for i, n in enumerate(names)}
    data = np.column_stack([sample["g"].astype(str).map(place).to_numpy(dtype=float), sample[["z", "y", "x"]].to_numpy(dtype=float)]) if len(sample) else np.zeros((0, 4))
    split: list[list] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        w = weight[rows]
        if w.sum() > per_leaf and len(rows) > 1:
            span = np.ptp(data[rows], axis=0)
            for axis in [0] if span[0] else np.argsort(-span[1:]) + 1:
                order = rows[np.argsort(data[rows, axis], kind="stable")]
                values = data[order, axis]
                steps = np.flatnonzero(values[1:] > values[:-1]) + 1
                if not len(steps):
                    continue
                running = np.cumsum(weight[order])
                k = steps[np.argmin(np.abs(running[steps - 1] - running[-1] / 2))]
                me = len(split)
                split.append([int(axis), float((values[k - 1] + values[k]) / 2), 0, 0])
                split[me][2], split[me][3] = grow(order[:k]), grow(order[k:])
                return me
        leaves += 1
        return -leaves

    grow(np.arange(len(data)))
    return SpaceTree(names, [tuple(x) for x in split], leaves)


def top_hierarchy(points: DataFrame, group: str, task_rows: int = TASK_ROWS, sample_rows: int = SAMPLE_ROWS) -> SpaceTree:
    """A tree whose leaves hold about ``task_rows`` rows of ``points`` (more only where that would take over ``sample_rows`` / LEAF_SAMPLE leaves).

    Fitted on a bounded sample; then all rows are counted per leaf, and while a leaf is overfull and holds different places, rows of it are
    sampled again and the tree is fitted with them. The counts are small aggregates; rows stay in Spark. The tree decides where rows go, not what
    a task holds: that is bounded by blocks in any case.
    """
    space = points.select(F.col(group).alias("g"), "z", "y", "x")
    n = space.count()
    per_leaf = max(task_rows, n * LEAF_SAMPLE / sample_rows)
    share = min(1.0, LEAF_SAMPLE * max(n / per_leaf, 64) / max(n, 1))
    sample = space.sample(fraction=share, seed=11).toArrow().to_pandas()
    weight = np.full(len(sample), 1.0 / share)
    tree = fit_tree(sample, weight, per_leaf)
    for _ in range(ROUNDS):
        if share == 1.0:
            tree.rows = np.bincount(tree.leaves_of(*_boxes(tree, sample, 0.0))[1], minlength=tree.leaves)
            break
        counted = space.mapInPandas(_leaf_counts(tree), f"leaf int, n long, {_BOUNDS}")
        # as many rows as the tree has leaves
        counts = counted.groupBy("leaf").agg(F.sum("n").alias("n"), *[F.min(f"low_{c}").alias(f"low_{c}") for c in "gzyx"], *[F.max(f"high_{c}").alias(f"high_{c}") for c in "gzyx"]).toArrow().to_pandas()
        tree.rows[counts["leaf"]] = counts["n"]
        apart = np.any([counts[f"low_{c}"] < counts[f"high_{c}"] for c in "gzyx"], axis=0)
        over = counts[(counts["n"] > OVERFULL * per_leaf) & apart].set_index("leaf")["n"].to_dict()
        if not over:
            break
        hot = space.mapInPandas(_rows_of_leaves(tree, set(over)), "g string, z double, y double, x double, leaf int")
        more = hot.sample(fraction=min(1.0, sample_rows / sum(over.values())), seed=12).toArrow().to_pandas()
        if not len(more):
            break
        rows, leaf = tree.leaves_of(*_boxes(tree, sample, 0.0))
        of = np.empty(len(sample), dtype=np.int64)
        of[rows] = leaf
        seen = set(more["leaf"])
        keep = ~np.isin(of, list(seen))
        added = more["leaf"].map(over).to_numpy(dtype=float) / more.groupby("leaf")["g"].transform("size").to_numpy()
        sample, weight = pd.concat([sample[keep], more[["g", "z", "y", "x"]]], ignore_index=True), np.concatenate([weight[keep], added])
        tree = fit_tree(sample, weight, per_leaf)
    else:
        counted = space.mapInPandas(_leaf_counts(tree), f"leaf int, n long, {_BOUNDS}").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        tree.rows[counted["leaf"]] = counted["n"]
    if len(sample):
        rows, leaf = tree.leaves_of(*_boxes(tree, sample, 0.0))
        spans = sample[["z", "y", "x"]].iloc[rows].groupby(leaf).agg(np.ptp)
        tree.longest[spans.index] = spans.to_numpy().argmax(axis=1)
    return tree


_BOUNDS = ", ".join(f"{side}_{c} double" for side in ("low", "high") for c in "gzyx")


def _boxes(tree: SpaceTree, pdf: pd.DataFrame, reach: float) -> tuple[np.ndarray, np.ndarray]:
    rank = tree.ranks(pdf["g"].to_numpy())
    low = np.column_stack([rank, *(pdf[c].to_numpy(dtype=float) - reach for c in "zyx")])
    high = np.column_stack([rank, *(pdf[c].to_numpy(dtype=float) + reach for c in "zyx")])
    return low, high


def _leaf_counts(tree: SpaceTree):
    """Rows of each leaf and the bounds of their places."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(tree.leaves, dtype=np.int64)
        low, high = np.full((tree.leaves, 4), np.inf), np.full((tree.leaves, 4), -np.inf)
        for pdf in batches:
            where, _ = _boxes(tree, pdf, 0.0)
            row, leaf = tree.leaves_of(where, where)
            total += np.bincount(leaf, minlength=tree.leaves)
            np.minimum.at(low, leaf, where[row])
            np.maximum.at(high, leaf, where[row])
        held = np.flatnonzero(total)
        bounds = {f"{side}_{c}": values[held, k] for side, values in (("low", low), ("high", high)) for k, c in enumerate("gzyx")}
        yield pd.DataFrame({"leaf": held.astype(np.int32), "n": total[held], **bounds})

    return count


def _rows_of_leaves(tree: SpaceTree, wanted: set[int]):
    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, leaf = tree.leaves_of(*_boxes(tree, pdf, 0.0))
            met = np.isin(leaf, list(wanted))
            yield pdf.iloc[row[met]].assign(leaf=leaf[met].astype(np.int32))

    return rows_of


def _usable(group: str | None = None):
    test = None
    for c in "zyx":
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        test = ok if test is None else test & ok
    return test & F.col(group).isNotNull() if group else test


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """One of ``blocks`` for each id, by its hash."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def near_pairs(
    points: DataFrame, id_col: str, group: str, distance: float, fit_on: DataFrame | None = None, task_rows: int = TASK_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs of different points of one ``group`` at a Euclidean distance of at most ``distance`` (included) over z, y, x.

    Result: id_a, id_b (long, id_a < id_b), distance; every pair once. Points with a null id, a null or NaN position or a null group are near
    nothing. ``id_col`` must be unique (a repeated id pairs with nothing under its own number). Extra columns are ignored; an empty table gives no pairs.

    Every point's search area is the square of half-width ``distance`` around it, two triangles by ear clipping. The top hierarchy sends
    each square to the leaves it reaches, to other leaves only upward in number, so no pair is found by two tasks. A task goes through its
    leaf along the leaf's longest axis in blocks of ``block_rows``, and keeps of earlier blocks only what is still in reach. A hierarchy
    over the triangles of a block finds candidates, which are tested exactly: point in triangle, then the distance. A point on the diagonal that
    both triangles share is found twice and kept once.

    Work follows the number of points and of pairs, whatever their density: dense places get more leaves; what cannot be told apart, such as
    many points at one place, is dealt to several tasks, each of which gets all earlier points as visitors; pairs leave a task as they are found.
    ``fit_on`` (same columns) may be a cheaper table to fit the hierarchy on, such as the rows before repeats are removed.
    """
    usable = _usable(group) & F.col(id_col).isNotNull()
    top = top_hierarchy((points if fit_on is None else fit_on).filter(usable), group, task_rows, sample_rows)
    first, blocks = top.deal(OVERFULL * max(task_rows, top.rows.sum() * LEAF_SAMPLE / sample_rows))
    held = points.sparkSession.sparkContext.broadcast((top, first, blocks))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, first, blocks = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            row, home = top.leaves_of(*_boxes(top, pdf, 0.0))
            own = np.empty(len(pdf), dtype=np.int64)
            own[row] = home
            mine = _block_of(pdf["id"].to_numpy(), blocks[own])
            row, leaf = top.leaves_of(*_boxes(top, pdf, distance))
            sent = leaf >= own[row]
            row, leaf = row[sent], leaf[sent]
            # at home in one block, a visitor in the later ones and in every block of other leaves
            start = np.where(leaf == own[row], mine[row], 0)
            times = blocks[leaf] - start
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            visits = np.repeat(leaf != own[row], times) | (nth > 0)
            row, leaf, block = np.repeat(row, times), np.repeat(leaf, times), np.repeat(start, times) + nth
            out = pdf.iloc[row]
            along = out[["z", "y", "x"]].to_numpy()[np.arange(len(out)), top.longest[leaf]]
            yield out.assign(task=(first[leaf] + block).astype(np.int32), visits=visits, along=along)

    rows = points.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(group).cast("string").alias("g"), "z", "y", "x")
    sent = rows.mapInPandas(route, "id long, g string, z double, y double, x double, task int, visits boolean, along double")
    tasks = int(blocks.sum())
    laid = sent.repartition(max(1, -(-tasks // 8)), "task").sortWithinPartitions("task", "along")
    return laid.mapInPandas(_sweep(distance, block_rows), "id_a long, id_b long, distance double")


def _sweep(distance: float, block_rows: int):
    """Near pairs of rows that come sorted by task and along one axis; of a pair at least one is at home in the task."""
    half = distance or 1.0  # a square without area has no triangles; the distance test is exact in any case
    square = ear_clip(np.array([[-half, -half], [-half, half], [half, half], [half, -half]], dtype=float))

    def search(pdf: pd.DataFrame, first: int) -> Iterator[pd.DataFrame]:
        """Pairs of a row from ``first`` on with an earlier one."""
        codes = pd.factorize(pdf["g"])[0].astype(float)
        where = pdf[["z", "y", "x"]].to_numpy()
        order = space_order(codes, where)
        codes, where = codes[order], where[order]
        ids, visits = pdf["id"].to_numpy()[order], pdf["visits"].to_numpy()[order]
        m = len(square)
        owner = np.repeat(np.arange(len(ids)), m)
        triangles = (where[:, None, None, 1:] + square[None]).reshape(-1, 3, 2)
        flat = np.column_stack([codes, where[:, 0]])[owner]
        low = np.column_stack([flat[:, 0], flat[:, 1] - half, triangles.min(axis=1)])
        high = np.column_stack([flat[:, 0], flat[:, 1] + half, triangles.max(axis=1)])
        fresh = np.flatnonzero(order >= first)
        at = np.column_stack([codes[fresh], where[fresh]])
        found, n = [], 0
        for query, triangle in Hierarchy(low, high).touching_parts(at, at):
            q, o = fresh[query], owner[triangle]
            asked = (order[o] < order[q]) & ~(visits[q] & visits[o])
            q, o, triangle = q[asked], o[asked], triangle[asked]
            exact = in_triangle(where[q, 1:], triangles[triangle])
            q, o = q[exact], o[exact]
            gap = ((where[q] - where[o]) ** 2).sum(axis=1)
            close = (gap <= distance * distance) & (ids[q] != ids[o])
            # a point on the diagonal lies in both triangles of a square
            both = np.unique(q[close] * len(ids) + o[close])
            found.append(both)
            n += len(both)
            if n > 200_000:
                yield pairs(np.concatenate(found), ids, where)
                found, n = [], 0
        if n:
            yield pairs(np.concatenate(found), ids, where)

    def pairs(both: np.ndarray, ids: np.ndarray, where: np.ndarray) -> pd.DataFrame:
        q, o = both // len(ids), both % len(ids)
        gap = np.sqrt(((where[q] - where[o]) ** 2).sum(axis=1))
        return pd.DataFrame({"id_a": np.minimum(ids[q], ids[o]), "id_b": np.maximum(ids[q], ids[o]), "distance": gap})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, n, kept = None, [], 0, 0  # the first ``kept`` rows held are of earlier blocks
        for pdf in batches:
            for piece in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pdf["task"].to_numpy())) + 1):
                if not len(piece):
                    continue
                if task is not None and pdf["task"].iat[piece[0]] != task:
                    yield from search(pd.concat(held, ignore_index=True), kept)
                    held, n, kept = [], 0, 0
                task = pdf["task"].iat[piece[0]]
                held.append(pdf.iloc[piece])
                n += len(piece)
                if n - kept >= block_rows:
                    block = pd.concat(held, ignore_index=True)
                    yield from search(block, kept)
                    along = block["along"].to_numpy()
                    held = [block[along >= along[-1] - distance * (1 + 1e-9) - abs(along[-1]) * 1e-12]]
                    n = kept = len(held[0])
        if held:
            yield from search(pd.concat(held, ignore_index=True), kept)

    return sweep


def _slice_polygons(labels: list[np.ndarray | None]) -> list[tuple[int, np.ndarray]]:
    """(label, ring) of simple polygons that cover the labelled voxels of one slice; ring corners are (y, x) on voxel borders.

    Runs of one label in neighbouring rows are stacked while each run meets exactly one run above and that one exactly one below, so no
    polygon has a hole. Label 0 is outside and gives none.
    """
    done, open_runs = [], []

    def close(stack):
        label, first, runs = stack
        left, right = [], []
        for i, (a, b) in enumerate(runs):
            left += [(first + i - 0.5, a - 0.5), (first + i + 0.5, a - 0.5)]
            right += [(first + i - 0.5, b + 0.5), (first + i + 0.5, b + 0.5)]
        done.append((label, np.array(left + right[::-1], dtype=float)))

    for y, row in enumerate([*labels, None]):
        runs = []
        if row is not None and len(row):
            cuts = np.flatnonzero(np.diff(row)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(row)]])):
                if row[a]:
                    runs.append((int(row[a]), int(a), int(b) - 1))
        meets = lambda s, r: s[0] == r[0] and s[2][-1][0] <= r[2] and r[1] <= s[2][-1][1]
        above = [[k for k, s in enumerate(open_runs) if meets(s, r)] for r in runs]
        below = [sum(k in x for x in above) for k in range(len(open_runs))]
        following = []
        for r, ks in zip(runs, above):
            if len(ks) == 1 and below[ks[0]] == 1:
                stack = open_runs[ks[0]]
                stack[2].append((r[1], r[2]))
                following.append(stack)
            else:
                following.append((r[0], y, [(r[1], r[2])]))
        for stack in open_runs:
            if not any(stack is s for s in following):
                close(stack)
        open_runs = following
    return done


_TRIANGLE = "z int, region_id int, y1 double, x1 double, y2 double, x2 double, y3 double, x3 double"


def slice_triangles(annotation: DataFrame) -> DataFrame:
    """Triangles z, region_id, y1, x1 … y3, x3 of all labelled areas of a label volume (z, y, labels), slice by slice.

    A task holds one slice, whose size is the image's, not the table's. Missing, null and empty rows are outside; of repeated (z, y) rows one counts.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(y): np.array([0 if v is None or v != v else v for v in labels], dtype=np.int64) for y, labels in zip(pdf["y"], pdf["labels"]) if labels is not None}
        first = min(rows, default=0)
        out = []
        for label, ring in _slice_polygons([rows.get(y) for y in range(first, max(rows, default=-1) + 1)]):
            ring[:, 0] += first
            out += [(label, *t.ravel()) for t in ear_clip(ring)]
        found = pd.DataFrame(out, columns=["region_id", "y1", "x1", "y2", "x2", "y3", "x3"])
        return found.assign(z=int(pdf["z"].iloc[0]))

    whole = annotation.filter("z is not null and y is not null").select("z", "y", "labels")
    # clipping is work beyond the bytes it reads: an explicit number of partitions is not merged into few
    tasks = annotation.sparkSession.sparkContext.defaultParallelism
    return whole.repartition(4 * tasks, "z").groupBy("z").applyInPandas(lambda pdf: cut(pdf)[["z", "region_id", "y1", "x1", "y2", "x2", "y3", "x3"]], _TRIANGLE)


def regions_of_points(points: DataFrame, id_col: str, annotation: DataFrame, fit_on: DataFrame | None = None, task_rows: int = TASK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The region of ``annotation`` that contains each point: id, voxel_region (0 = outside, null = a position is null or NaN).

    A position belongs to the voxel of its half-even rounded coordinates. Triangles of the labelled areas and points are dealt by a top hierarchy
    over the points' voxels: a point to its leaf, a triangle to every leaf that its box reaches, so neither the volume nor a hot slice passes
    through the driver, one task or a broadcast. In a task the triangles are searched through a hierarchy and tested exactly, borders
    included. A point on a border touches triangles of several regions; of these assignments the one that contains its voxel's centre is
    kept, so every point gets one region. Repeated points and ids get a row each.

    Leaves that hold many points are dealt to several tasks, which all get the leaf's triangles. Points outside the labelled box are
    outside, without a shuffle. ``fit_on`` (same columns) may be a cheaper table to fit the hierarchy on.
    """
    spark = points.sparkSession
    corners = {"z": "z", "y": ("y1", "y2", "y3"), "x": ("x1", "x2", "x3")}
    edges = {f"low_{c}": F.min(F.least(*k) if c != "z" else k) for c, k in corners.items()} | {f"high_{c}": F.max(F.greatest(*k) if c != "z" else k) for c, k in corners.items()}
    stash = Stash(slice_triangles(annotation), "triangles", {"n": F.count("*"), **edges})
    known = _usable()
    rows = points.select(F.col(id_col).cast("long").alias("id"), "z", "y", "x")
    outside = F.when(known, F.lit(0)).cast("int").alias("voxel_region")
    if not stash.seen["n"]:
        return rows.select("id", outside)
    inside = known
    for c in "zyx":
        inside = inside & (F.rint(c) if c == "z" else F.col(c)).between(stash.seen[f"low_{c}"], stash.seen[f"high_{c}"])
    base = (points if fit_on is None else fit_on).filter(inside).select(F.lit("").alias("g"), *[F.rint(c).alias(c) for c in "zyx"])
    top = top_hierarchy(base, "g", task_rows, sample_rows)
    first, blocks = top.deal(OVERFULL * task_rows)
    held = spark.sparkContext.broadcast((top, first, blocks))

    def route_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, first, blocks = held.value
        for pdf in batches:
            where = np.column_stack([np.zeros(len(pdf)), np.rint(pdf[["z", "y", "x"]].to_numpy())])
            where[:, 0] = top.ranks(np.array([""], dtype=object))[0]
            row, home = top.leaves_of(where, where)
            leaf = np.empty(len(pdf), dtype=np.int64)
            leaf[row] = home
            yield pdf.assign(task=(first[leaf] + _block_of(pdf["id"].to_numpy(), blocks[leaf])).astype(np.int32))

    def route_triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, first, blocks = held.value
        for pdf in batches:
            y, x = pdf[["y1", "y2", "y3"]].to_numpy(), pdf[["x1", "x2", "x3"]].to_numpy()
            rank = np.full(len(pdf), top.ranks(np.array([""], dtype=object))[0])
            z = pdf["z"].to_numpy(dtype=float)
            # a point lies at most half a voxel from its voxel's centre, by which it is dealt
            low, high = np.column_stack([rank, z, y.min(axis=1) - 0.5, x.min(axis=1) - 0.5]), np.column_stack([rank, z, y.max(axis=1) + 0.5, x.max(axis=1) + 0.5])
            row, leaf = top.leaves_of(low, high)
            times = blocks[leaf]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pdf.iloc[np.repeat(row, times)].assign(task=(np.repeat(first[leaf], times) + nth).astype(np.int32))

    searched = rows.filter(inside).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    dealt = searched.mapInPandas(route_points, "id long, z double, y double, x double, task int").groupBy("task")
    triangles = stash.df.mapInPandas(route_triangles, f"{_TRIANGLE}, task int").groupBy("task")
    met = dealt.cogroup(triangles).applyInPandas(_assign, "id long, voxel_region int")
    rest = rows.filter(~F.coalesce(inside, F.lit(False))).select("id", outside)
    return rest.unionAll(met.withColumn("id", F.nullif("id", F.lit(NO_ID))))


def _assign(points: pd.DataFrame, triangles: pd.DataFrame) -> pd.DataFrame:
    """The region of every point among the triangles of its task, 0 where none contains it."""
    where = points[["z", "y", "x"]].to_numpy()
    whole = np.rint(where)
    region = np.zeros(len(points), dtype=np.int32)
    if len(points) and len(triangles):
        tri = triangles.iloc[space_order(triangles["z"].to_numpy(dtype=float), triangles[["y1", "x1"]].to_numpy())]
        z, corners, labels = tri["z"].to_numpy(dtype=float), tri[["y1", "x1", "y2", "x2", "y3", "x3"]].to_numpy().reshape(-1, 3, 2), tri["region_id"].to_numpy()
        tree = Hierarchy(np.column_stack([z, corners.min(axis=1)]), np.column_stack([z, corners.max(axis=1)]))

        def assignments(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, t in tree.touching_parts(at, at):
                met = in_triangle(at[q, 1:], corners[t])
                yield q[met], labels[t[met]]

        centre = np.zeros(len(points), dtype=np.int32)
        border = np.flatnonzero((np.abs(where - whole) == 0.5)[:, 1:].any(axis=1))
        for q, label in assignments(whole[border]):
            centre[border[q]] = label
        on_border = np.zeros(len(points), dtype=bool)
        on_border[border] = True
        for q, label in assignments(np.column_stack([whole[:, 0], where[:, 1:]])):
            # triangles of one region share edges, so an assignment may come twice; on a border those of other regions are removed
            own = ~on_border[q] | (label == centre[q])
            region[q[own]] = label[own]
    return pd.DataFrame({"id": points["id"], "voxel_region": region})
