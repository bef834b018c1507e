"""Parent-child links of unknown depth to full hierarchies (problem 4).

Method: chains of parents inside a partition are contracted to fragments with one exit each; the exits' targets form a smaller
quotient forest, which is solved the same way; then the paths of fragments are expanded. Circular links show as chains that
never leave a partition (local) or never end in the quotient (global).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stash
from .sized_join import sized_join

#: Nodes and ids of their paths meant for one task while contracting; a forest of at most so many is solved in one task.
FRAGMENT_ROWS = 50_000
FRAGMENT_IDS = 4_000_000
#: Ids of paths that a task holds at once before it passes rows on.
SLICE_IDS = 1_000_000

_SHAPE = "scope string, id long, parent_id long, exit_id long, state string, path array<long>"


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows parents inside one partition. In: scope, id, parent_id, frag (ids from the chain's top to the node itself).

    Out: exit_id (a parent outside the partition, or null), state 'exit', 'root' or 'cycle', path (fragment from its top to the node), in slices.
    """
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    n = len(pdf)
    scope = pd.factorize(pdf["scope"], use_na_sentinel=False)[0]
    ids = pdf["id"].to_numpy(dtype=np.int64)
    linked = pdf["parent_id"].notna().to_numpy()
    parents = pdf["parent_id"].fillna(0).to_numpy(dtype=np.int64)
    place = pd.MultiIndex.from_arrays([scope, ids])
    up = place.get_indexer(pd.MultiIndex.from_arrays([scope, parents]))
    up[~linked] = -1
    frags = pdf["frag"].to_numpy()
    length = np.array([len(f) for f in frags], dtype=np.int64)
    # nodes from the top down; a node whose chain never ends inside is on a circle or below one
    waiting = np.bincount(up[up >= 0], minlength=n)
    order = np.argsort(up, kind="stable")
    begin = np.searchsorted(up[order], np.arange(n))
    exits = np.full(n, -1, dtype=np.int64)
    ready = np.flatnonzero(up < 0)
    exits[ready] = ready
    while len(ready):
        counts = waiting[ready]
        below = order[np.repeat(begin[ready] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        exits[below] = exits[up[below]]
        length[below] += length[up[below]]
        ready = below
    circular = exits < 0
    top = np.where(circular, 0, exits)
    leaves = linked[top] & ~circular
    shown = pd.DataFrame(
        {
            "scope": pdf["scope"], "id": ids, "parent_id": pdf["parent_id"].astype("Int64"), "exit_id": pd.Series(parents[top]).astype("Int64").where(leaves),
            "state": np.where(circular, "cycle", np.where(leaves, "exit", "root")),
        }
    )

    def path(i: int) -> np.ndarray:
        if circular[i]:
            return np.asarray(frags[i])
        pieces = []
        while i >= 0:
            pieces.append(frags[i])
            i = up[i]
        return np.concatenate(pieces[::-1])

    piece = np.cumsum(length) // SLICE_IDS
    for rows in np.split(np.arange(n), np.flatnonzero(np.diff(piece)) + 1):
        yield shown.iloc[rows].assign(path=[path(i) for i in rows.tolist()])


def _parts(rows: int, ids: int, fragment_rows: int) -> int:
    """Partitions of so many nodes with so many ids in their fragments: they follow the bytes."""
    return max(1, -(-rows // fragment_rows), -(-ids // FRAGMENT_IDS))


def _paired(quotient: DataFrame, level: int) -> DataFrame:
    """``quotient`` with ``mate``: its parent for some nodes, itself for the others.

    Every node draws a coin (a hash, another one on each level); a node with tails whose parent has heads goes with its parent. Nodes of one mate
    lie in one partition, so a chain contracts whatever its ids: of nodes with one child a quarter is expected to go, and nodes without children
    always go, so a quarter of any forest is expected to go on each level.
    """
    heads = lambda c: F.pmod(F.xxhash64("scope", c, F.lit(level)), F.lit(2)) == 1
    joins = F.col("parent_id").isNotNull() & ~heads("id") & heads("parent_id")
    return quotient.withColumn("mate", F.when(joins, F.col("parent_id")).otherwise(F.col("id")))


def _solve(nodes: DataFrame, n: int, ids: int, fragment_rows: int, level: int = 0) -> DataFrame:
    """scope, id, state ('root' or 'cycle'), path (from the root to the node; of a circular node: itself) for nodes scope, id, parent_id, frag."""
    parts = _parts(n, ids, fragment_rows)
    if parts == 1:
        laid = nodes.coalesce(1)
    elif level == 0:
        # a range of (scope, id) keeps a forest together where it fits; a large one is cut into ranges of ids
        laid = nodes.repartitionByRange(parts, "scope", "id")
    else:
        laid = _paired(nodes, level).repartition(parts, "scope", "mate").drop("mate")
    done = Stash(laid.mapInPandas(_contract, _SHAPE), "fragments").df
    targets = done.filter("state = 'exit'").select("scope", F.col("exit_id").alias("id")).distinct()
    entries = Stash(done.join(targets, ["scope", "id"], "left_semi"), "quotient", {"n": F.count("*"), "ids": F.sum(F.size("path"))})
    m = entries.seen["n"]
    if not m:
        return done.select("scope", "id", F.when(F.col("state") == "cycle", "cycle").otherwise("root").alias("state"), F.when(F.col("state") == "cycle", F.array("id")).otherwise(F.col("path")).alias("path"))
    # a node on or below a local circle links to itself in the quotient, so what leads to it turns out circular as well
    onward = F.when(F.col("state") == "cycle", F.col("id")).otherwise(F.col("exit_id"))
    quotient = entries.df.select("scope", "id", onward.alias("parent_id"), F.col("path").alias("frag"))
    upper = _solve(quotient, m, entries.seen["ids"] or 0, fragment_rows, level + 1)
    above = upper.select("scope", F.col("id").alias("exit_id"), F.col("state").alias("above_state"), F.col("path").alias("above_path"))
    solved = Stash(above, "solved", {"longest": F.max(F.size("above_path"))})
    entries.drop()
    # long paths are broadcast in small numbers only
    joined = sized_join(done, solved.df, ["scope", "exit_id"], "left", row_bytes=8 * (solved.seen["longest"] or 0) + 64, rows=m)
    circular = (F.col("state") == "cycle") | F.coalesce(F.col("above_state") == "cycle", F.lit(False))
    return joined.select(
        "scope", "id", F.when(circular, "cycle").otherwise("root").alias("state"),
        F.when(circular, F.array("id")).otherwise(F.concat(F.coalesce("above_path", F.array().cast("array<long>")), "path")).alias("path"),
    )


def hierarchies(links: DataFrame, scope: str, id_col: str, parent_col: str, no_parent: tuple[int, ...] = (-1,), fragment_rows: int = FRAGMENT_ROWS, paths: bool = True) -> DataFrame:
    """Full hierarchies of all forests: scope, id, parent_id (as given), state, root_id, depth, path.

    ``links`` has one row per (scope, id); of repeated rows the one with the smallest parent counts. A link ends at null, at an id in
    ``no_parent``, and at an id that its scope does not hold; the node there is a root. state is 'root', or 'cycle' for nodes on or below a
    circle, which have no root: root_id, depth (0 at a root) and path (ids from the root to the node) are then null.
    A null scope is a scope of its own; rows with a null id are no nodes and are left out. Extra columns are ignored; an empty table
    gives an empty result.

    Scale: no task holds more than about ``fragment_rows`` nodes, whatever the size of a scope: scopes are cut into ranges of ids. Each
    level passes on only the nodes that other partitions point to. Where ids tell nothing about who lies near whom, the first level passes on
    nearly all; further levels are cut by pairs of child and parent (``_paired``), so each is expected to drop a quarter at least. So the
    number of levels follows the logarithm of the size, not the depth.
    The result's size is the sum of depths, which is what full paths hold; with ``paths`` off only states are worked out (root_id, depth and path are null).
    """
    nodes = links.filter(F.col(id_col).isNotNull()).select(F.coalesce(F.col(scope).cast("string"), F.lit("\0")).alias("scope"), F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("given_parent"))
    nodes = nodes.groupBy("scope", "id").agg(F.min("given_parent").alias("given_parent"))
    base = Stash(nodes, "links", {"n": F.count("*")})
    held = base.df.withColumn("parent_id", F.when(~F.col("given_parent").isin(*no_parent), F.col("given_parent")) if no_parent else F.col("given_parent")).withColumn("frag", F.array("id") if paths else F.array().cast("array<long>"))
    n = base.seen["n"]
    solved = _solve(held.drop("given_parent"), n, n, fragment_rows)
    rooted = (F.col("state") == "root") & F.lit(paths)
    return solved.join(base.df, ["scope", "id"]).select(
        F.when(F.col("scope") != "\0", F.col("scope")).alias("scope"), "id", F.col("given_parent").alias("parent_id"), "state",
        F.when(rooted, F.try_element_at("path", F.lit(1))).alias("root_id"), F.when(rooted, F.size("path") - 1).alias("depth"), F.when(rooted, F.col("path")).alias("path"),
    )


def descendants(solved: DataFrame) -> DataFrame:
    """All (scope, ancestor_id, id, distance) pairs of a result of ``hierarchies``, a node with itself at distance 0 included."""
    opened = solved.filter("state = 'root'").select("scope", "id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return opened.select("scope", "ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))


def latest_links(nodes: DataFrame) -> DataFrame:
    """The valid rows of atlas nodes: the latest ``revised_at`` per (atlas_name, id); on a tie the smallest parent (null first)."""
    last = W.partitionBy("atlas_name", "id").orderBy(F.col("revised_at").asc_nulls_first(), F.col("parent_id").desc_nulls_last())
    return nodes.select("atlas_name", "id", "parent_id", "revised_at", F.lead(F.lit(1)).over(last).alias("__next")).filter("__next is null").drop("__next")
