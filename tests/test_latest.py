import datetime as dt

from stratavox.operators.latest import current_cells

SCHEMA = "cell_ord long, image_name string, channel int, det_no int, loaded_at timestamp, extra string"


def at(day):
    return dt.datetime(2031, 1, day)


def test_latest_wins_and_ties_take_the_largest_number(spark):
    rows = [(1, "a", 1, 1, at(1), "x"), (2, "a", 1, 1, at(2), "x"), (3, "a", 1, 1, at(2), "x"), (4, "a", 2, 1, None, "x"), (5, None, None, None, None, "x"), (6, None, None, None, at(1), "x")]
    got = current_cells(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["cell_ord"] for r in got) == [3, 4, 6]


def test_empty_table(spark):
    assert current_cells(spark.createDataFrame([], SCHEMA)).count() == 0
