"""Percentiles with bounded relative rank error that can be combined (problem 5).

Method, relative-rank compactors: a sketch is a stack of sorted buffers, an item of level h standing for 2^h values. A full buffer
compacts only its low end, every other item moving up a level, and keeps its high end; how far a compaction reaches follows the
number of compactions so far. The rank error is then a fraction of the number of values above, so high percentiles are sharpest.
Sketches of partitions or days are merged level by level.

The bound: of every two compactions of a buffer the first draws a coin (a hash of what it compacts, so equal input gives equal sketches) and the second
takes the opposite one, as in the published sketch, whose standard error for SECTIONS sections of SECTION items is
sqrt(0.0512 / SECTIONS) / SECTION of the values above. ``rank_bound`` states ERRORS of these standard errors, as a share of all values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sized_join import sized_join
from ..session import Stash

#: Items per section of a compactor. The relative rank error falls as 1 / SECTION; at 64 it is well under 1 % of the values above.
SECTION = 64
SECTIONS = 3
#: Standard errors in the stated bound.
ERRORS = 4
#: Tasks whose sketches of one group are merged together before the last merge.
FAN_IN = 256
#: Sketches put together in one step of a merge.
MERGED = 64


def rank_bound(n: int | np.ndarray, q: float) -> float | np.ndarray:
    """The bound on the error of the rank of the q-quantile, as a share of n values: a share of the values above, and nothing for values that fit into the first buffer."""
    above = ERRORS * (0.0512 / SECTIONS) ** 0.5 / SECTION * (1 - q)
    return np.where(np.asarray(n) <= 2 * SECTION * SECTIONS, 0.0, above)


class Sketch:
    """One stack of compactors; merges and serialises."""

    __slots__ = ("n", "levels", "rounds", "coins")

    def __init__(self, n: int = 0, levels: list[np.ndarray] | None = None, rounds: list[int] | None = None, coins: list[int] | None = None):
        self.n, self.levels, self.rounds, self.coins = n, levels or [], rounds or [], coins or []

    def add(self, values: np.ndarray) -> Sketch:
        """Values in any number, without NaN."""
        for part in [values] if len(values) <= 16384 else np.array_split(values, -(-len(values) // 16384)):
            self._extend(0, part)
            self.n += len(part)
            self._compact()
        return self

    def merge(self, other: Sketch) -> Sketch:
        return self.merge_all([other])

    def merge_all(self, others: list[Sketch]) -> Sketch:
        """Merges any number: the items of each level are put together, then compacted once."""
        for level in range(max((len(o.levels) for o in others), default=0)):
            held = [o for o in others if len(o.levels) > level]
            self._extend(level, np.concatenate([o.levels[level] for o in held]))
            for o in held:
                self.rounds[level] |= o.rounds[level]
        self.n += sum(o.n for o in others)
        self._compact()
        return self

    def _extend(self, level: int, items: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
            self.rounds.append(0)
            self.coins.append(0)
        held = self.levels[level]
        self.levels[level] = np.sort(np.concatenate([held, items])) if len(held) else np.sort(items)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            # more compactions ask for more sections, as log2 of their number
            sections = max(SECTIONS, self.rounds[level].bit_length())
            room = 2 * SECTION * sections
            items = self.levels[level]
            if len(items) > room:
                c = self.rounds[level]
                reach = min(sections - 1, ((c + 1) & ~c).bit_length() - 1)
                keep = SECTION * sections + (sections - 1 - reach) * SECTION
                low = len(items) - keep
                low -= low & 1
                self.levels[level] = items[low:]
                self.rounds[level] = c + 1
                self.coins[level] = 1 - self.coins[level] if c & 1 else _coin(items[:low], level)
                self._extend(level + 1, items[:low][self.coins[level] :: 2])
            level += 1

    def quantiles(self, qs: list[float]) -> list[float | None]:
        """The value of rank ceil(q * n), from 1, for each q in [0, 1]; None when empty."""
        if not self.n:
            return [None] * len(qs)
        items = np.concatenate(self.levels)
        weight = np.repeat(1 << np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(items, kind="stable")
        upto = np.cumsum(weight[order])
        ranks = np.maximum(1, np.ceil(np.array(qs) * self.n - 1e-9))
        return items[order][np.minimum(np.searchsorted(upto, ranks), len(items) - 1)].tolist()

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<qq{2 * len(self.levels)}q", self.n, len(self.levels), *map(len, self.levels), *(2 * r + c for r, c in zip(self.rounds, self.coins)))
        return head + b"".join(x.astype("<f8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        n, m = struct.unpack_from("<qq", data)
        numbers = struct.unpack_from(f"<{2 * m}q", data, 16)
        at, levels = 16 + 16 * m, []
        for size in numbers[:m]:
            levels.append(np.frombuffer(data, "<f8", size, at))
            at += 8 * size
        return cls(n, levels, [r >> 1 for r in numbers[m:]], [r & 1 for r in numbers[m:]])


def _coin(items: np.ndarray, level: int) -> int:
    """A coin drawn from the items (sorted, two at least) of a compaction: a hash of a few of them."""
    few = np.ascontiguousarray(items[:: max(1, len(items) // 8)], dtype=np.float64).view(np.uint64)
    seed = int(np.bitwise_xor.reduce(few * np.arange(1, 2 * len(few), 2, dtype=np.uint64)))
    mixed = (seed + (level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    mixed = ((mixed ^ mixed >> 31) * 0xFF51AFD7ED558CCD) & (2**64 - 1)
    return ((mixed ^ mixed >> 29) * 0xC4CEB9FE1A85EC53 & (2**64 - 1)) >> 63


def _group_codes(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A code per row and the first row of each code; nulls are equal to each other."""
    codes = np.zeros(len(pdf), dtype=np.int64)
    for k in keys:
        c, values = pd.factorize(pdf[k], use_na_sentinel=False)
        codes = pd.factorize(codes * (len(values) + 1) + c)[0]
    first = np.full(codes.max() + 1 if len(codes) else 0, -1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def sketches(df: DataFrame, keys: list[str], values: list[str], where: dict[str, tuple[float, float]] | None = None, batch_rows: int = 250_000) -> DataFrame:
    """One sketch per group and value column: the ``keys``, ``measure``, ``sketch`` (binary).

    Null, NaN and values not strictly inside the column's ``where`` range do not count; a group without values of a column has no row for it.
    Null keys are a group. Every task sketches its rows first (at most ``batch_rows`` at once), so a group with any share of the
    rows sends one bounded sketch per task (``merge_sketches``).
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    ranges = where or {}

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _gather(batches, batch_rows):
            codes, first = _group_codes(pdf, keys)
            for name in values:
                v = pdf[name].to_numpy(dtype=float)
                good = ~np.isnan(v)
                if name in ranges:
                    good &= (v > ranges[name][0]) & (v < ranges[name][1])
                c, v = codes[good], v[good]
                order = np.argsort(c, kind="stable")
                c, v = c[order], v[order]
                starts = np.flatnonzero(np.diff(c, prepend=-1))
                ends = np.append(starts[1:], len(c))
                made = [Sketch().add(v[a:b]).to_bytes() for a, b in zip(starts, ends)]
                out = pdf[keys].iloc[first[c[starts]]].reset_index(drop=True) if len(made) else pdf[keys].iloc[:0]
                yield out.assign(measure=name, sketch=made)

    parts = df.select(*keys, *values).mapInPandas(build, f"{schema}, measure string, sketch binary")
    return merge_sketches(parts, keys)


def _gather(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def merge_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of partitions or days combined per ``keys`` and measure; other columns are dropped.

    Three steps: every task merges the sketches it holds before anything is shuffled; those of FAN_IN tasks each are merged together; then those
    of a group. So where few groups take the sketches of many tasks, no task takes more than about as many as there are FAN_INs of tasks. The sketches
    of a group arrive one after another, sorted by group, and only the open group's are in memory.
    """
    keyed = [*keys, "measure"]
    shape = parts.select(*keyed, "sketch")
    schema = ", ".join(f"`{k}` {shape.schema[k].dataType.simpleString()}" for k in keyed) + ", sketch binary"
    local = shape.mapInPandas(_merge_held(keyed), schema).withColumn("__part", F.floor(F.spark_partition_id() / FAN_IN))
    some = local.repartition(*keyed, "__part").sortWithinPartitions(*keyed, "__part").drop("__part").mapInPandas(_merge_runs(keyed), schema)
    return some.repartition(*keyed).sortWithinPartitions(*keyed).mapInPandas(_merge_runs(keyed), schema)


#: Groups that a task holds sketches of before it passes them on.
HELD_GROUPS = 20_000


def _put_together(sketches: list[bytes]) -> bytes:
    """One sketch of some; a single one stays as it is."""
    if len(sketches) == 1:
        return sketches[0]
    made = Sketch()
    for i in range(0, len(sketches), MERGED):
        made.merge_all([Sketch.from_bytes(x) for x in sketches[i : i + MERGED]])
    return made.to_bytes()


def _by_group(pdf: pd.DataFrame, keyed: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """The sketches of each group of a batch, groups in the order of their first row."""
    codes, first = _group_codes(pdf, keyed)
    order = np.argsort(codes, kind="stable")
    held = pdf["sketch"].to_numpy()[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(first)))
    names = pdf[keyed].iloc[first].itertuples(index=False, name=None)
    for name, a, b in zip(names, ends - np.diff(ends, prepend=0), ends):
        yield tuple(None if x is None or x != x else x for x in name), list(held[a:b])


def _frame(rows: list[tuple[tuple, bytes]], keyed: list[str]) -> pd.DataFrame:
    return pd.DataFrame([k for k, _ in rows], columns=keyed).assign(sketch=[s for _, s in rows])


def _merge_held(keyed: list[str]):
    """Merges what a task holds; rows come in any order, and groups pass on when there are many."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, bytes] = {}
        for pdf in batches:
            for key, sketches in _by_group(pdf, keyed):
                held[key] = _put_together([held[key], *sketches] if key in held else sketches)
            if len(held) > HELD_GROUPS:
                yield _frame(list(held.items()), keyed)
                held = {}
        if held:
            yield _frame(list(held.items()), keyed)

    return merge


def _merge_runs(keyed: list[str]):
    """Merges rows that come sorted by group."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting = None, []
        for pdf in batches:
            done = []
            for group, sketches in _by_group(pdf, keyed):
                if waiting and group != key:
                    done.append((key, _put_together(waiting)))
                    waiting = []
                key = group
                waiting += sketches
                if len(waiting) > MERGED:
                    waiting = [_put_together(waiting)]
            if done:
                yield _frame(done, keyed)
        if waiting:
            yield _frame([(key, _put_together(waiting))], keyed)

    return merge


def percentiles(sketched: DataFrame, keys: list[str], percents: list[float], bounds: bool = False) -> DataFrame:
    """keys, measure, n_values and one column ``pNN`` per percentile (nearest rank) of sketches; with ``bounds`` also ``eNN``, the bound on
    the error of its rank as a share of n_values (``rank_bound``)."""
    names = [f"{p:g}".replace(".", "_") for p in percents]
    keyed = [*keys, "measure"]
    columns = [f"p{n}" for n in names] + ([f"e{n}" for n in names] if bounds else [])
    schema = ", ".join(f"`{k}` {sketched.schema[k].dataType.simpleString()}" for k in keyed) + ", n_values long, " + ", ".join(f"{c} double" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read_back = [Sketch.from_bytes(x) for x in pdf["sketch"]]
            n = np.array([s.n for s in read_back], dtype=np.int64)
            found = np.array([s.quantiles([p / 100 for p in percents]) for s in read_back], dtype=float).reshape(-1, len(percents))
            if bounds:
                found = np.column_stack([found, *(rank_bound(n, p / 100) for p in percents)])
            yield pd.concat([pdf[keyed].reset_index(drop=True).assign(n_values=n), pd.DataFrame(found, columns=columns)], axis=1)

    return sketched.select(*keyed, "sketch").mapInPandas(read, schema)


def rank_check(df: DataFrame, found: DataFrame, keys: list[str], percents: list[float], where: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Every percentile of ``found`` (``percentiles`` with bounds; non-null keys) against exact ranks in ``df``: keys, measure, percent, n_values (exact), within.

    within: the ranks that the value has among all values of its group come as near to the wanted rank as the bound allows (or one rank). One scan of
    ``df`` with counts per group; the percentiles, a few per group, are joined by their measured number.
    """
    held = Stash(found, "percentiles", {"n": F.count("*")})
    measures = sorted(r[0] for r in held.df.select("measure").distinct().collect())  # columns of df
    names = [f"{p:g}".replace(".", "_") for p in percents]

    def value(m: str) -> Column:
        low, high = (where or {}).get(m, (None, None))
        good = F.col(m).isNotNull() & ~F.isnan(m)
        return F.when(good if low is None else good & (F.col(m) > low) & (F.col(m) < high), F.col(m))

    rows = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), value(m).alias("v")) for m in measures]))).filter("v is not null")
    joined = sized_join(rows, held.df.drop("n_values"), [*keys, "measure"], row_bytes=64 + 16 * len(names), rows=held.seen["n"])
    counted = joined.groupBy(*keys, "measure").agg(
        F.count("*").alias("n_values"), *[f for n in names for f in (F.count_if(F.col("v") < F.col(f"p{n}")).alias(f"below{n}"), F.count_if(F.col("v") <= F.col(f"p{n}")).alias(f"upto{n}"), F.first(f"e{n}").alias(f"e{n}"))]
    )
    n = F.col("n_values")

    def judged(percent: float, name: str) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(n * percent / 100 - 1e-9))
        off = F.greatest(F.lit(0), F.col(f"below{name}") + 1 - rank, rank - F.col(f"upto{name}"))
        return F.struct(F.lit(float(percent)).alias("percent"), (off <= F.greatest(F.col(f"e{name}") * n, F.lit(0.0)) + F.when(F.col(f"e{name}") > 0, 1).otherwise(0)).alias("within"))

    return counted.select(*keys, "measure", "n_values", F.inline(F.array(*[judged(p, name) for p, name in zip(percents, names)])))


def daily(df: DataFrame, at: str, name: str = "day") -> DataFrame:
    """``df`` with the date of ``at``."""
    return df.withColumn(name, F.to_date(at))
