import random
from collections import defaultdict

import numpy as np
import pytest

from stratavox.llm.packing import TIERS, balance_groups, container_report, pack_documents, pack_lengths, packing_violations, token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("shard", [50, 10_000])
def test_whole_pieces_and_no_overfull_container(spark, shard):
    rng = random.Random(shard)
    docs = [(i, rng.choice([0, 1, 5, 2048, 2049, 5000, rng.randint(1, 400), rng.randint(200, 3000)]), "x") for i in range(400)]
    df = spark.createDataFrame(docs, "id long, n_tokens long, tier string").drop("tier")
    rows = pack_documents(df, shard_docs=shard).collect()
    by_doc, by_box = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        if r["container_id"] is not None:
            by_box[r["container_id"]].append(r)
    for i, n, _ in docs:
        assert sum(r["n_tokens"] for r in by_doc[i]) == n
        assert len(by_doc[i]) == max(1, -(-n // 2048)) and sorted(r["piece"] for r in by_doc[i]) == list(range(len(by_doc[i])))
        assert all(r["n_tokens"] == 2048 for r in by_doc[i] if r["piece"] < len(by_doc[i]) - 1)
    for box in by_box.values():
        at = 0
        for r in sorted(box, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] > 0
            at += r["n_tokens"]
        assert at <= 2048 and len({r["step_group"] for r in box}) == 1
    groups = defaultdict(set)
    for box, items in by_box.items():
        groups[items[0]["step_group"]].add(box)
    assert max(map(len, groups.values())) <= 9
    report = container_report(pack_documents(df, shard_docs=shard)).first()
    assert report["n_tokens"] == sum(n for _, n, _ in docs) and report["n_containers"] == len(by_box)


def test_little_is_left_unused():
    rng = np.random.default_rng(1)
    lengths = np.minimum(np.maximum(rng.lognormal(6.2, 0.8, 20_000).astype(int), 1), 2048)
    container, _ = pack_lengths(lengths)
    used = np.bincount(container, weights=lengths)
    assert used.max() <= 2048 and 1 - lengths.sum() / (2048 * len(used)) < 0.01


def test_every_tier_is_packed_on_its_own():
    lengths = np.array([1500, 1500, 700, 600, 540, 300, 200, 100, 48])
    # the long windows take 540 and 500 = 300 + 200 from the next tiers; 700 and 600 open windows of 1,024 that share a container
    container, offset = pack_lengths(lengths)
    assert container[0] != container[1] and container[2] == container[3] and offset[2] in (0, 700, 748, 1024 - 300)
    used = np.bincount(container, weights=lengths)
    assert len(used) == 3 and used.max() <= 2048 and used.sum() == lengths.sum()
    rng = np.random.default_rng(4)
    many = np.minimum(np.maximum(rng.lognormal(6.2, 0.8, 6_000).astype(int), 1), 2048)
    placed = {tiers: pack_lengths(many, 2048, tiers)[0] for tiers in (TIERS, (2048,), (7, 300, 2048), (64, 512, 2048))}
    assert len({tuple(p) for p in placed.values()}) == 4
    for container in placed.values():
        used = np.bincount(container, weights=many)
        assert used.max() <= 2048 and 1 - many.sum() / (2048 * len(used)) < 0.01
    # a window of the longest tier takes from a shorter tier only what that tier holds
    long = many > 1024
    assert len(set(placed[TIERS][long])) == long.sum()


def test_odd_tiers_and_lengths():
    for lengths in ([], [1], [2048], [2048, 1], [5] * 900):
        for tiers in (TIERS, (), (5,), (5000, 3)):
            container, offset = pack_lengths(np.array(lengths, dtype=np.int64), 2048, tiers)
            used = np.bincount(container, weights=lengths) if lengths else np.zeros(0)
            assert used.sum() == sum(lengths) and (used <= 2048).all() and (not lengths or len(used) == -(-sum(lengths) // 2045) or len(lengths) < 3)


def test_violations_are_found(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([10, 3000, 0, 2048, 500])], "id long, n_tokens long")
    good = pack_documents(counts)
    assert packing_violations(good, counts).count() == 0
    rows = [r.asDict() for r in good.collect()]

    def broken(change):
        bad = [change(dict(r)) for r in rows]
        return {(r["rule"], r["id"]) for r in packing_violations(spark.createDataFrame([r for r in bad if r], good.schema), counts).collect()}

    box = {r["id"]: r["container_id"] for r in rows}
    assert broken(lambda r: None if r["id"] == 0 else r) >= {("lost", 0)}
    assert broken(lambda r: {**r, "n_tokens": 4} if r["id"] == 4 else r) >= {("lost", 4)}
    assert broken(lambda r: {**r, "container_id": None} if r["id"] == 4 else r) >= {("unplaced", 4)}
    assert broken(lambda r: {**r, "container_id": box[3], "start": 2048} if r["id"] == 4 else r) >= {("overfull", box[3])}
    assert broken(lambda r: {**r, "start": r["start"] + 1} if r["id"] == 4 else r) >= {("overlap", box[4])}
    assert broken(lambda r: {**r, "id": 77} if r["id"] == 4 else r) >= {("unknown", 77), ("lost", 4)}
    assert broken(lambda r: {**r, "step_group": 9} if r["id"] == 4 else r) >= {("torn", box[4])}
    assert packing_violations(good.unionByName(good.filter("id = 4")), counts).filter("rule = 'split'").count() == 1


def test_groups_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 800)
    container = np.arange(800)
    group = balance_groups(container, lengths)
    cost = np.bincount(group, weights=lengths.astype(float) ** 2)
    assert np.bincount(group).tolist() == [8] * 100 and cost.max() / cost.min() < 1.2


def test_tokens_of_odd_texts_and_empty(spark):
    import tiktoken

    texts = [None, "", "hello world", "x" * 50_000, "été <|endoftext|> ​", "hello world"]
    got = {r["id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "d long, t string"), "d", "t", VOCABULARY).collect()}
    assert got[0] == got[1] == 0 and got[2] == got[5] == 2 and got[3] > 1000 and got[4] > 5
    assert tiktoken is not None
    assert pack_documents(spark.createDataFrame([], "id long, n_tokens long")).count() == 0
    assert container_report(pack_documents(spark.createDataFrame([], "id long, n_tokens long"))).first()["n_containers"] == 0
