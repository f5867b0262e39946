from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from helpers import random_ratings, rows
from pyspark.sql import functions as F

from shelfwise import settings
from shelfwise.operators import interactions as ops
from shelfwise.operators.evaluation import recs_by_model, truth, truth_counts, truth_lists
from shelfwise.operators.indexing import cutoff, global_rank, hash_index
from shelfwise.operators.split import exact_split, part, stratified_split
from shelfwise.plans import workflow
from shelfwise.sources import triplets, views


def test_collapse_sums_and_reads_null_as_nothing(ratings):
    table = ratings([("u1", "i1", 1.0), ("u1", "i1", 2.0), ("u1", "i2", None)])
    assert rows(ops.collapse(table, 1)) == [("u1", "i1", 3.0), ("u1", "i2", 0.0)]


def test_threshold_counts_distinct_items(ratings):
    table = ratings([("u1", "i1", 1.0), ("u1", "i1", 2.0), ("u1", "i2", 1.0), ("u2", "i1", 1.0)])
    assert rows(ops.active_users(table, 2)) == [("u1", 2)]
    assert ops.active_interactions(table, 2).count() == 3
    assert ops.active_users(table, 3).count() == ops.collapse(table, 3).count() == 0


def test_rating_cells_average_and_drop_empty(ratings):
    table = ratings([("u", "a", 1.0), ("u", "a", 3.0), ("u", "b", None)])
    assert rows(ops.rating_cells(table)) == [("u", "a", 2.0)]


def test_grid_is_counted(ratings):
    table = ratings([("u", "a", 1.0), ("u", "b", 3.0), ("v", "c", 1.0)])
    assert rows(ops.user_item_grid(table)) == [("u", 3), ("v", 3)]


def expected_test_rows(data, size, seed):
    found = set()
    for user in {u for u, _, _ in data}:
        items = [i for u, i, _ in data if u == user]
        order = sorted(items, key=lambda i: (hashlib.md5(f"{user}|{i}|{seed}".encode()).hexdigest(), i))
        found |= {(user, i) for i in order[: math.floor(len(items) * size + 0.5)]}
    return found


@pytest.mark.parametrize("hot_rows", [None, 7])
@pytest.mark.parametrize("size", [0.2, 0.5])
def test_split_by_definition_also_for_hot_users(ratings, hot_rows, size):
    data = random_ratings(3, 9, 40, 0.3, hot_user=4)
    assigned = stratified_split(ratings(data), size, 42, hot_rows)
    assert rows(assigned.drop("split")) == sorted(data)
    test = {(u, i) for u, i, _ in rows(part(assigned, "test"))}
    assert test == expected_test_rows(data, size, 42)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_preparation_deals_rows_to_as_many_tasks_as_they_need(ratings, monkeypatch):
    data = random_ratings(8, 30, 20, 0.5)
    monkeypatch.setattr(settings, "TASK_ROWS", 20)
    assigned = workflow.assign(ratings([*data, ("few", "i000", 1.0)]), 2, 0.2, 42)
    assert assigned.rdd.getNumPartitions() == -(-len(data) // 20) > 4
    assert rows(assigned.drop("split")) == sorted(data)
    test = {(u, i) for u, i, _ in rows(part(assigned, "test"))}
    assert test == expected_test_rows(data, 0.2, 42)


def test_assign_counts_users_once(ratings, monkeypatch):
    data = random_ratings(8, 9, 40, 0.3, hot_user=4)
    written = []
    keep = workflow.cut_lineage
    monkeypatch.setattr(workflow, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    for hot_rows in (None, 7):
        monkeypatch.setattr(settings, "HOT_KEY_ROWS", hot_rows or 1_000_000)
        assigned = workflow.assign(ratings([*data, ("few", "i000", 1.0)]), 2, 0.2, 42)
        assert rows(assigned.drop("split")) == sorted(data)
        assert {(u, i) for u, i, _ in rows(part(assigned, "test"))} == expected_test_rows(data, 0.2, 42)
    assert written == [["personId", "contentId", "result"], ["personId", "n"]] * 2


def test_active_pairs_are_passed_unsorted(ratings):
    pairs = ratings([("u1", "i1", 1.0), ("u1", "i2", 1.0), ("u2", "i1", 1.0)])
    kept = ops.keep_active(pairs, 2)
    assert rows(kept) == [("u1", "i1", 1.0), ("u1", "i2", 1.0)]
    assert "SortMergeJoin" not in plan_of(kept) and "Sort " not in plan_of(kept)


def test_repeated_rows_are_counted_instead_of_joined(spark, ratings):
    table = ratings(
        [("u1", "i1", 1.5), ("u1", "i1", 2.0), ("u1", "i2", None), ("u2", "i1", 4.0), ("u2", "i3", 1.0), ("u3", "i1", 1.0)]
    )
    users = spark.createDataFrame([("u1", 1), ("u1", 2), ("u1", 3), ("u9", 1), (None, 1)], "personId string, region_no bigint")
    found = ops.collapse_repeated(table, users, 2)
    assert rows(found) == rows(ops.collapse_joined(table.join(users, "personId", "left"), 2))
    assert rows(found) == [("u1", "i1", 10.5), ("u1", "i2", 0.0), ("u2", "i1", 4.0), ("u2", "i3", 1.0)]
    # The pair sums are in a table: no task adds up pairs beside joining them.
    assert "contentId" not in "".join(x for x in plan_of(found).splitlines() if "HashAggregate" in x)


def test_orders_meet_lines_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id % 50 as l_orderkey", "id as l_partkey", "1.0D as l_quantity").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    plain = rows(views.interactions(spark, str(tmp_path)))
    monkeypatch.setattr(settings, "TASK_ROWS", 10)
    dealt = views.interactions(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 20 and rows(dealt) == plain and len(plain) == 160


@pytest.mark.parametrize("size", [0.2, 0.37])
@pytest.mark.parametrize("hot_rows", [None, 7])
def test_exact_split_shares_the_total_by_largest_remainder(ratings, size, hot_rows):
    data = random_ratings(5, 23, 15, 0.4, hot_user=4)
    n = Counter(u for u, _, _ in data)
    total = math.ceil(round(len(data) * size, 9))
    want = {u: c * total // len(data) for u, c in n.items()}
    place = lambda u: (-(n[u] * total % len(data)), int(hashlib.md5(f"{u}|42".encode()).hexdigest()[:15], 16), u)
    for u in sorted(n, key=place)[: total - sum(want.values())]:
        want[u] += 1
    assigned = exact_split(ratings(data), size, 42, hot_rows)
    test = rows(part(assigned, "test"))
    assert len(test) == total and Counter(u for u, _, _ in test) == {u: c for u, c in want.items() if c}
    for u, c in want.items():
        items = sorted((i for x, i, _ in data if x == u), key=lambda i: (hashlib.md5(f"{u}|{i}|42".encode()).hexdigest(), i))
        assert {i for x, i, _ in test if x == u} == set(items[:c])


def test_exact_split_of_nothing_and_of_whole_shares(ratings):
    assert exact_split(ratings([])).count() == 0
    assigned = exact_split(ratings([(u, f"i{k}", 1.0) for u in "ab" for k in range(5)]))
    assert rows(assigned.groupBy("personId", "split").count()) == [("a", "test", 1), ("a", "train", 4), ("b", "test", 1), ("b", "train", 4)]


def test_one_models_lists_are_written_alone(spark, tmp_path):
    schema = "model string, personId string, rank int, contentId string, score double"
    one = spark.createDataFrame([("a", "u", 1, "x", 1.0), ("b", "u", 2, "y", 1.0), ("b", "u", 1, "z", 2.0)], schema)
    path = triplets.write_recs(one, str(tmp_path / "recs"))
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "recs" / "model=a").iterdir()}
    triplets.replace_recs(spark.createDataFrame([("b", "v", 1, "w", 1.0)], schema), path)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "recs" / "model=a").iterdir()} == kept
    wide = recs_by_model(triplets.read_recs(spark, path), ["a", "b", "c"])
    assert wide.columns == ["personId", "a", "b", "c"]
    assert rows(wide) == [("u", ["x"], [], []), ("v", [], ["w"], [])]


def test_truth_keeps_train_users_only(ratings):
    train = ratings([("u1", "a", 1.0), ("u2", "b", 1.0)])
    test = ratings([("u1", "c", 1.0), ("u3", "d", 1.0)])
    assert rows(truth(train, test)) == [("u1", "a", "train"), ("u1", "c", "test"), ("u2", "b", "train")]
    assert rows(truth_counts(train, test)) == [("u1", 1, 1), ("u2", 1, 0)]
    found = {r["personId"]: (r["true_train"], r["true_test"]) for r in truth_lists(train, test).collect()}
    assert found == {"u1": (["a"], ["c"]), "u2": (["b"], [])}


def test_a_user_is_one_row_however_long(ratings):
    train = ratings([("u", f"i{n:05d}", 1.0) for n in range(12_000)])
    found = truth_lists(train, ratings([("u", "z", 1.0)])).collect()
    assert [(len(r["true_train"]), r["true_test"]) for r in found] == [(12_000, ["z"])]


@pytest.mark.parametrize("bucket_rows", [10_000, 37])
def test_global_rank(spark, bucket_rows):
    table = spark.range(500).select(
        F.col("id").cast("string").alias("contentId"), F.pmod(F.col("id") * 7, F.lit(13)).cast("double").alias("score")
    )
    ranked = global_rank(table, [-F.col("score"), F.col("contentId")], "r", bucket_rows)
    found = [(r["contentId"], r["score"]) for r in ranked.orderBy("r").collect()]
    assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert sorted(r["r"] for r in ranked.collect()) == list(range(1, 501))


def test_hash_index_is_dense(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("id"))
    numbers = sorted(r["n"] for r in hash_index(ids, "id", "n", 100).collect())
    assert numbers == list(range(100))


def test_cutoff_counts_exactly(spark):
    table = spark.createDataFrame([(v,) for v in (5, 1, 9, 5, 70_000_000, 5, 3)], "v bigint")
    for n in range(1, 8):
        limit, ties = cutoff(table, "v", n, 100_000_000)
        values = sorted((5, 1, 9, 5, 70_000_000, 5, 3))
        assert limit == values[n - 1]
        assert sum(v < limit for v in values) + ties == n
    with pytest.raises(ValueError):
        cutoff(table, "v", 8, 100_000_000)
