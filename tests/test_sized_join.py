import pytest

from stratavox.operators import sized_join as J
from stratavox.session import Stash, cluster_folder, scratch, shared_folder


def sides(spark):
    rows = [(1, i) for i in range(600)] + [(k, k) for k in range(2, 60)] + [(None, 5), (777, 1)]
    big = spark.createDataFrame(rows, "k int, v int").repartition(3)
    return rows, big, spark.createDataFrame([(k, f"n{k}") for k in range(60)], "k int, name string")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_and_broadcast_joins_agree(spark, how):
    rows, big, small = sides(spark)
    key = lambda r: str(tuple(r))
    plain = sorted(big.join(small, "k", how).select("k", "v", "name").collect(), key=key)
    salted = J.salted_join(big, small, ["k"], how, hot_rows=50).select("k", "v", "name")
    assert sorted(salted.collect(), key=key) == plain == sorted(J.sized_join(big, small, ["k"], how).select("k", "v", "name").collect(), key=key)


def test_only_hot_keys_are_salted(spark):
    _, big, _ = sides(spark)
    assert [tuple(r) for r in J.hot_key_salts(big, ["k"], hot_rows=50).collect()] == [(1, 12)]


def test_intermediate_tables_go_with_their_scratch(spark):
    from pathlib import Path

    with scratch():
        stash = Stash(spark.range(5), "test")
        place = Path(stash.path.removeprefix("file:"))
        assert stash.df.count() == 5 and place.exists()
    assert not place.exists()
    assert shared_folder(spark)


def test_a_cluster_needs_a_shared_folder():
    assert cluster_folder("hdfs://host/warehouse/") == "hdfs://host/warehouse"
    for own in ("", "file:/root/spark-warehouse", "/root/spark-warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            cluster_folder(own)
