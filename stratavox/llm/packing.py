"""Documents into containers of a fixed number of tokens (problem 7).

Method, hierarchical multi-length packing: documents are routed to tiers of context sizes by length; every tier is packed on its own into
windows of its size, from the longest tier to the shortest; the gaps of its windows are filled from shorter tiers, the next one first;
windows of shorter tiers share containers; containers are then balanced over step groups.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
#: Documents meant for one packing task, and containers of one step group.
SHARD_DOCS = 20_000
GROUP = 8

# Fixed value: the split pattern that belongs to the public byte-level vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str, text: str, vocabulary: str) -> DataFrame:
    """id, n_tokens of every document by the vocabulary file (ranks); a null text has 0 tokens. Whole texts, equal ones of a batch once, no shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for pdf in batches:
            codes, texts = pd.factorize(pdf["t"])
            # a null text has code -1, the last of the numbers
            numbers = np.array([*(len(encoding.encode_ordinary(x)) for x in texts), 0], dtype=np.int64)
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": numbers[codes]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInPandas(count, "id long, n_tokens long")


class _Stock:
    """The pieces of one tier by length; finds the longest that fits."""

    def __init__(self, lengths: np.ndarray, members: np.ndarray, capacity: int):
        self.by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in members[np.argsort(lengths[members], kind="stable")[::-1]].tolist():
            self.by_length[lengths[i]].append(i)
        self.held = np.array([bool(x) for x in self.by_length])
        self.upto = np.maximum.accumulate(np.where(self.held, np.arange(len(self.held)), 0))

    def take(self, length: int) -> int:
        i = self.by_length[length].pop()
        if not self.by_length[length]:
            self.held[length] = False
            above = np.flatnonzero(self.held[length + 1 :])
            end = length + 1 + above[0] if len(above) else len(self.held)
            self.upto[length:end] = self.upto[length - 1]
        return i

    def best_with(self, other: _Stock, gap: int) -> tuple[int, int]:
        """Lengths of a piece of this tier and, if that fills more, one of the ``other`` (or 0) for a ``gap``; of equal fillings the longest first piece."""
        one = int(self.upto[gap])
        if one in (0, gap):
            return one, 0
        firsts = np.flatnonzero(self.held[1:gap]) + 1
        seconds = other.upto[gap - firsts]
        if other is self:  # a length held once is not there for both
            alone = (seconds == firsts) & np.array([len(self.by_length[f]) < 2 for f in firsts.tolist()], dtype=bool)
            seconds = np.where(alone, self.upto[np.maximum(firsts - 1, 0)], seconds)
        k = len(firsts) - 1 - int(np.argmax((firsts + seconds)[::-1]))
        return (int(firsts[k]), int(seconds[k])) if firsts[k] + seconds[k] > one else (one, 0)


def _pack_tier(own: _Stock, size: int) -> list[tuple[int, list[int]]]:
    """(gap, pieces) of the windows of one tier: best fit, the longest piece first."""
    windows = []
    while own.upto[size]:
        gap, pieces = size, []
        while gap and (length := int(own.upto[gap])):
            pieces.append(own.take(length))
            gap -= length
        windows.append((gap, pieces))
    return windows


def _fill(gap: int, pieces: list[int], shorter: list[_Stock]) -> int:
    """Fills a window from shorter tiers, the next one first: a piece of it, with the second piece, of it or a still shorter tier, that fills most. What is left."""
    for k, stock in enumerate(shorter):
        while gap and stock.upto[gap]:
            first, second, giver = 0, 0, stock
            for other in shorter[k:]:
                a, b = stock.best_with(other, gap)
                if a + b > first + second:
                    first, second, giver = a, b, other
                if first + second == gap:
                    break
            pieces.append(stock.take(first))
            if second:
                pieces.append(giver.take(second))
            gap -= first + second
    return gap


def _share(used: np.ndarray, capacity: int) -> np.ndarray:
    """A container for each window by best fit, the fullest first."""
    out = np.empty(len(used), dtype=np.int64)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: list[int] = []  # gaps that some container has, rising
    containers = 0
    for i in np.argsort(-used, kind="stable").tolist():
        at = bisect_left(held, used[i])
        if at < len(held):
            gap = held[at]
            out[i] = gaps[gap].pop()
            if not gaps[gap]:
                held.pop(at)
        else:
            gap, out[i], containers = capacity, containers, containers + 1
        left = gap - int(used[i])
        if left:
            if not gaps[left]:
                insort(held, left)
            gaps[left].append(int(out[i]))
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of pieces of 1 to ``capacity`` tokens.

    A piece belongs to the smallest tier it fits into. From the longest tier on, what is left of a tier is packed into windows of the tier's size;
    their gaps, the widest first, are filled from shorter tiers. Windows of tiers below ``capacity`` share containers.
    """
    sizes = sorted({t for t in tiers if t < capacity} | {capacity})
    tier = np.searchsorted(sizes, lengths)
    stocks = [_Stock(lengths, np.flatnonzero(tier == k), capacity) for k in range(len(sizes))]
    windows, used = [], []
    for k in reversed(range(len(sizes))):
        for gap, pieces in sorted(_pack_tier(stocks[k], sizes[k]), key=lambda w: -w[0]):
            left = _fill(gap, pieces, stocks[:k][::-1])
            windows.append(pieces)
            used.append(sizes[k] - left)
    container, offset = np.full(len(lengths), -1), np.zeros(len(lengths), dtype=np.int64)
    begin: dict[int, int] = {}
    for box, pieces in zip(_share(np.array(used, dtype=np.int64), capacity).tolist(), windows):
        at = begin.get(box, 0)
        for i in pieces:
            container[i], offset[i] = box, at
            at += int(lengths[i])
        begin[box] = at
    return container, offset


def balance_groups(container: np.ndarray, lengths: np.ndarray, group: int = GROUP) -> np.ndarray:
    """A step group per container (indexed by container): ``group`` containers each (the last fewer), dealt in serpentine order of attention cost
    (sum of squared lengths), so the groups' costs are close."""
    n = int(container.max()) + 1 if len(container) else 0
    cost = np.bincount(container, weights=lengths.astype(float) ** 2, minlength=n)
    groups = max(1, -(-n // group))
    order = np.argsort(-cost, kind="stable")
    turn, place = np.divmod(np.arange(n), groups)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.where(turn % 2, groups - 1 - place, place)
    return out


def pack_documents(counts: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, shard_docs: int = SHARD_DOCS, group: int = GROUP, n_docs: int | None = None) -> DataFrame:
    """Placement of all documents of ``counts`` (id, n_tokens): id, piece, tier, n_tokens, container_id, start (offset in the container), step_group.

    A document of at most ``capacity`` tokens is one piece. A longer one is cut into full containers and one rest. Documents without tokens
    have piece 0 of 0 tokens and no container. Ids must be unique to be told apart; repeated rows are packed each on its own.

    Documents are dealt to shards of about ``shard_docs`` by a hash of id and length, so no task packs more, whatever the number of documents;
    only ids and counts are shuffled. Each shard wastes at most the gaps of its last windows.
    """
    n = counts.count() if n_docs is None else n_docs
    shards = max(1, -(-n // shard_docs))
    tiers = tuple(t for t in tiers if t < capacity) + (capacity,)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n_tokens"], ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(dtype=np.int64)
        pieces = np.maximum(1, -(-sizes // capacity))
        doc = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lengths = np.minimum(sizes[doc] - piece * capacity, capacity)
        real = np.flatnonzero(lengths > 0)
        container, start = pack_lengths(lengths[real], capacity, tiers)
        step = balance_groups(container, lengths[real], group)
        shard = int(pdf["shard"].iloc[0])
        out = pd.DataFrame({"id": pdf["id"].to_numpy()[doc], "piece": piece.astype(np.int32), "tier": np.array(tiers, dtype=np.int32)[np.searchsorted(tiers, lengths)], "n_tokens": lengths})
        for name, base in (("container_id", container), ("start", start), ("step_group", step[container] if len(real) else step)):
            column = np.full(len(out), -1, dtype=np.int64)
            column[real] = base if name == "start" else base + (shard << 32)
            out[name] = pd.Series(column).astype("Int64").where(lengths > 0)
        return out

    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(shards)).cast("int"))
    schema = "id long, piece int, tier int, n_tokens long, container_id long, start long, step_group long"
    return dealt.groupBy("shard").applyInPandas(pack, schema)


def container_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens and their share."""
    each = placed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = each.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.expr("0L")).alias("n_tokens"))
    unused = F.col("n_containers") * capacity - F.col("n_tokens")
    return total.select("n_containers", "n_tokens", unused.alias("n_unused"), F.try_divide(unused, F.col("n_containers") * capacity).alias("unused_share"))


def packing_violations(placed: DataFrame, counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What a placement of ``counts`` (id, n_tokens; unique ids) breaks: rule, id (of a document or a container). No rows for a good one.

    Rules: ``lost`` (a document is absent or its pieces do not add up to its tokens), ``unknown`` (a placed document that is not in ``counts``), ``split`` (more pieces than
    its length asks for), ``unplaced`` (a piece with tokens but no container), ``overfull`` (a container above ``capacity``), ``overlap`` (pieces of a container overlap or leave a hole),
    ``torn`` (a container in several step groups).
    """
    docs = placed.groupBy("id").agg(F.sum("n_tokens").alias("found"), F.count("*").alias("pieces"), F.count_if((F.col("n_tokens") > 0) & F.col("container_id").isNull()).alias("homeless"))
    both = counts.select("id", "n_tokens").join(docs, "id", "full")
    asked = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))
    document = [
        ("unknown", F.col("n_tokens").isNull()), ("lost", F.col("n_tokens").isNotNull() & (F.coalesce("found", F.lit(-1)) != F.col("n_tokens"))),
        ("split", F.col("pieces") > asked), ("unplaced", F.col("homeless") > 0),
    ]
    held = placed.filter("container_id is not null")
    # pieces that fill a container from 0 without overlap have these sums: total = end of the last, and starts that add up along the way
    after = F.sum("n_tokens").over(W.partitionBy("container_id").orderBy("start", "n_tokens").rowsBetween(W.unboundedPreceding, -1))
    stepped = held.withColumn("__due", F.coalesce(after, F.lit(0)))
    boxes = stepped.groupBy(F.col("container_id").alias("id")).agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("start") != F.col("__due")).alias("wrong"), F.countDistinct("step_group").alias("groups"))
    container = [("overfull", F.col("used") > capacity), ("overlap", F.col("wrong") > 0), ("torn", F.col("groups") > 1)]
    told = lambda df, rules: df.select(F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))).alias("rule"), "id")
    return told(both, document).unionByName(told(boxes, container))
