import datetime as dt

from stratavox.operators.orphans import orphan_references, orphan_report

REFS = "ref_table string, ref_row long, ref_id int, loaded_at timestamp, extra string"
PARENTS = "id int, added_at timestamp, retired_at timestamp, extra string"


def at(month):
    return dt.datetime(2031, month, 1)


def found(spark, refs, parents):
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return sorted(tuple(r) for r in got.collect())


def test_missing_early_deleted_and_limits(spark):
    parents = [(1, None, None, ""), (2, at(3), at(6), ""), (3, at(1), at(2), ""), (3, at(4), at(5), ""), (None, None, None, "")]
    refs = [
        ("t", 1, 1, at(1), ""), ("t", 2, 2, at(2), ""), ("t", 3, 2, at(3), ""), ("t", 4, 2, at(5), ""), ("t", 5, 2, at(6), ""), ("t", 6, 9, at(1), ""),
        ("t", 6, 9, at(1), ""), ("t", 7, None, at(1), ""), ("t", 8, 9, None, ""), ("t", 9, 2, None, ""), ("t", 10, 3, at(4), ""), ("t", 11, 3, at(3), ""),
    ]
    expect = [
        ("t", 2, 2, "2031-02", "early"), ("t", 5, 2, "2031-06", "deleted"), ("t", 6, 9, "2031-01", "missing"), ("t", 8, 9, None, "missing"), ("t", 11, 3, "2031-03", "deleted"),
    ]
    assert found(spark, refs, parents) == expect


def test_empty_sides(spark):
    assert found(spark, [], [(1, None, None, "")]) == []
    assert found(spark, [("t", 1, 1, at(1), "")], []) == [("t", 1, 1, "2031-01", "missing")]


def test_report_counts_distinct(spark):
    refs = [("t", 1, 9, at(1), ""), ("t", 1, 8, at(1), ""), ("t", 2, 9, at(1), ""), ("t", 2, 9, at(1), "")]
    got = orphan_report(spark.createDataFrame(refs, REFS), spark.createDataFrame([], PARENTS)).collect()
    assert [tuple(r) for r in got] == [("t", "2031-01", "missing", 3, 2, 2)]
