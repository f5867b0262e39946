from __future__ import annotations

import pytest
from helpers import rows

from shelfwise.operators.interactions import collapse, collapse_joined
from shelfwise.schemas import validate_columns
from shelfwise.sources import triplets


def write(path, text):
    path.write_text(text)
    return str(path)


def triplet_table(spark, data):
    return spark.createDataFrame(data, "row string, col string, data double")


def test_semicolon_file_and_wrong_separator(spark, tmp_path):
    path = write(tmp_path / "a.csv", "row;col;data\n1;7;2.5\n2;8;NaN\n")
    assert rows(triplets.read_interactions(spark, path)) == [("1", "7", 2.5), ("2", "8", None)]
    with pytest.raises(ValueError):
        triplets.read_interactions(spark, path, sep=",")


def test_comma_file_with_other_column_order(spark, tmp_path):
    path = write(tmp_path / "b.csv", "data,row,col\n2.5,1,7\n")
    assert rows(triplets.read_interactions(spark, path, sep=",")) == [("1", "7", 2.5)]


def test_missing_column(spark, tmp_path):
    path = write(tmp_path / "c.csv", "row;col\n1;2\n")
    with pytest.raises(ValueError, match="data"):
        triplets.read_triplets(spark, path)
    with pytest.raises(ValueError):
        validate_columns(["row"], ["row", "col"], "x")


def test_null_ids_are_left_out_and_counted(spark):
    source = triplet_table(spark, [(None, "1", 1.0), ("1", None, 1.0), ("1", "1", None)])
    assert rows(triplets.read_interactions(spark, source)) == [("1", "1", None)]
    assert triplets.null_ids(spark, source).first()["dropped"] == 2


def test_outer_joins_keep_every_item(spark):
    asset = triplet_table(spark, [("a", "0", 1.0)])
    price = triplet_table(spark, [("b", "0", 2.0)])
    subclass = triplet_table(spark, [("c", "5", 1.0)])
    found = {r["contentId"]: tuple(r)[1:] for r in triplets.item_info(spark, asset, price, subclass).collect()}
    assert found == {"a": (1.0, None, None, None), "b": (None, 2.0, None, None), "c": (None, None, 5, 1.0)}


def test_user_fanout_depends_on_the_order_of_join_and_sum(spark):
    interactions = triplet_table(spark, [("u1", "i1", 5.0)])
    age = triplet_table(spark, [("u1", "0", 0.5)])
    region = triplet_table(spark, [("u1", "1", 1.0), ("u1", "2", 1.0)])
    joined = triplets.interactions_users(spark, interactions, age, region)
    assert joined.count() == 2
    assert rows(collapse_joined(joined, 1)) == [("u1", "i1", 10.0)]
    assert rows(collapse(triplets.read_interactions(spark, interactions), 1)) == [("u1", "i1", 5.0)]


def test_written_triplets_read_back(spark, tmp_path):
    source = triplet_table(spark, [("1", "2", 0.1), ("x", "y", -3.0)])
    path = triplets.write_triplets(source, str(tmp_path / "out"))
    assert rows(triplets.read_triplets(spark, path)) == rows(source)


def test_recs_are_written_by_model(spark, tmp_path):
    recs = spark.createDataFrame([("m", "u", 1, "i", 0.5)], "model string, personId string, rank int, contentId string, score double")
    path = triplets.write_recs(recs, str(tmp_path / "recs"))
    assert rows(spark.read.parquet(path), *recs.columns) == rows(recs)


def test_other_column_order_and_bad_numbers_fail(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("row;col;data\nu;i;1.0\n")
    (folder / "b.csv").write_text("col;row;data\ni;u;1.0\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        triplets.read_interactions(spark, str(folder)).collect()
    bad = tmp_path / "bad.csv"
    bad.write_text("row;col;data\nu;i;abc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        triplets.read_interactions(spark, str(bad)).collect()


def test_bad_rows_are_put_aside_with_a_reason(spark, tmp_path):
    lines = ["1;7;2.5", "2;8;many", "3;9", "4;9;1;1", ";9;1", "5;;1", "6;x9;1", "7;9;", "8;9;NaN", '"9;9";9;1', "", "10;9;1e3"]
    path = write(tmp_path / "bad.csv", "\n".join(["row;col;data", *lines]) + "\n")
    good, rejects = triplets.scan_triplets(spark, path, whole_numbers=("col",))
    assert sorted(rows(good), key=str) == sorted(
        [("1", "7", 2.5), ("7", "9", None), ("8", "9", None), ("9;9", "9", 1.0), ("10", "9", 1000.0)], key=str
    )
    found = {(r["line"], r["reason"]) for r in rejects.collect()}
    assert found == {
        ("2;8;many", "value"), ("3;9", "fields"), ("4;9;1;1", "fields"), (";9;1.0", "id"), ("5;;1.0", "id"), ("6;x9;1.0", "number"),
    }
    assert all(r["file"].endswith("bad.csv") for r in rejects.collect())
    assert {r["reason"]: r["n"] for r in triplets.reject_counts(rejects).collect()} == {"value": 1, "fields": 2, "id": 2, "number": 1}
    assert rows(triplets.read_interactions(spark, good))[0][0] in {"1", "7", "8", "9;9", "10"}
    with pytest.raises(ValueError):
        triplets.scan_triplets(spark, path, sep=",")


def test_item_table_from_a_file_with_bad_rows(spark, tmp_path):
    """What the scan keeps goes into the item table; the plain reader ends on the same file."""
    path = write(tmp_path / "subclass.csv", "data;row;col\n1;a;5\nno;a;6\n1;b;c7\n1;c;8\n")
    good, rejects = triplets.scan_triplets(spark, path, whole_numbers=("col",))
    none = triplet_table(spark, [])
    found = {r["contentId"]: r["category_no"] for r in triplets.item_info(spark, none, none, good).collect()}
    assert found == {"a": 5, "c": 8} and rejects.count() == 2
    with pytest.raises(Exception):
        triplets.item_info(spark, none, none, path).collect()


def test_a_file_with_a_header_alone(spark, tmp_path):
    good, rejects = triplets.scan_triplets(spark, write(tmp_path / "none.csv", "row;col;data\n"))
    assert good.count() == rejects.count() == 0
