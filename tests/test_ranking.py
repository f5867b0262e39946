from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from helpers import brute_topk, lists, random_ratings, rows

from shelfwise.functions import kernels
from shelfwise.models.popularity import fit_popularity, recommend_popular
from shelfwise.operators import evaluation, ranking
from shelfwise.operators.vectors import weighted_sums

RECS = "model string, personId string, rank int, contentId string, score double"


def test_popularity_ties_and_seen_items(ratings):
    train = ratings([("u1", "i1", 9.0), ("u2", "i2", 9.0), ("u3", "i3", 1.0)])
    found = lists(recommend_popular(fit_popularity(train), train, 3))
    assert found["u1"] == ["i2", "i3"]
    assert found["u3"] == ["i1", "i2"]
    free = lists(recommend_popular(fit_popularity(train), train, 3, exclude_seen=False))
    assert free["u1"] == ["i1", "i2", "i3"]


@pytest.mark.parametrize("head_ranks", [None, 2])
@pytest.mark.parametrize("bucket_rows", [None, 5])
def test_popularity_by_definition_with_a_user_who_saw_nearly_all(ratings, head_ranks, bucket_rows):
    data = [r for r in random_ratings(1, 12, 30, 0.25, hot_user=3) if r[:2] != ("u003", "i017")]
    train = ratings(data)
    scores = {}
    for _, item, value in data:
        scores[item] = scores.get(item, 0) + value
    ranked = ranking.rank_items(
        train.groupBy("contentId").sum("result").withColumnRenamed("sum(result)", "score"), bucket_rows
    )
    users = train.select("personId").distinct()
    found = lists(ranking.rank_shared_items(ranked, users, train, 4, head_ranks))
    for user in {u for u, _, _ in data}:
        seen = {i for u, i, _ in data if u == user}
        assert found.get(user, []) == [i for i, _ in brute_topk({i: s for i, s in scores.items() if i not in seen}, 4)]


@pytest.mark.parametrize("k", [0, -1, 1.5])
def test_bad_k(ratings, k):
    train = ratings([("u1", "i1", 9.0)])
    with pytest.raises(ValueError):
        recommend_popular(fit_popularity(train), train, k)
    with pytest.raises(ValueError):
        ranking.top_k(train.withColumnRenamed("result", "score"), k)


@pytest.mark.parametrize("block_bytes", [None, 8 * 5 * 3 * 4])
def test_factor_topk_by_definition(spark, block_bytes):
    rng = np.random.default_rng(0)
    users, items = rng.integers(-2, 3, (17, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    user_table = spark.createDataFrame([(f"u{n}", v.tolist()) for n, v in enumerate(users)], "personId string, factors array<double>")
    item_table = spark.createDataFrame([(f"i{n}", v.tolist()) for n, v in enumerate(items)], "contentId string, factors array<double>")
    pairs = [("u0", f"i{n}") for n in range(38)] + [("u1", "i3")]
    seen = spark.createDataFrame(pairs, "personId string, contentId string")
    found = lists(ranking.factor_topk(user_table, item_table, 5, seen, block_bytes))
    for n, vector in enumerate(users):
        scores = {f"i{m}": float(vector @ w) for m, w in enumerate(items) if (f"u{n}", f"i{m}") not in pairs}
        assert found[f"u{n}"] == [i for i, _ in brute_topk(scores, 5)]


def test_a_group_of_items_gives_what_a_user_needs_of_it(spark, monkeypatch):
    """k items and as many as the user has seen of the group, not of all groups."""
    rng = np.random.default_rng(1)
    users = spark.createDataFrame([(f"u{n}", v.tolist()) for n, v in enumerate(rng.random((4, 2)))], "personId string, factors array<double>")
    items = spark.createDataFrame([(f"i{n}", v.tolist()) for n, v in enumerate(rng.random((60, 2)))], "contentId string, factors array<double>")
    seen = spark.createDataFrame([("u0", f"i{n}") for n in range(50)], "personId string, contentId string")
    scored = []
    keep = ranking.exclude_seen
    monkeypatch.setattr(ranking, "exclude_seen", lambda rows_, pairs: scored.append(rows_) or keep(rows_, pairs))
    found = lists(ranking.factor_topk(users, items, 3, seen, 64 * 12))
    assert all(len(picked) == 3 for picked in found.values())
    # Five groups of items.
    assert scored[0].where("personId = 'u0'").count() <= 5 * 3 + 50


@pytest.mark.parametrize("scale", [1.0, 2.0**54])
def test_best_items_over_many_blocks_with_ties(monkeypatch, scale):
    monkeypatch.setattr(kernels, "SCORE_USERS", 4)
    monkeypatch.setattr(kernels, "SCORE_ITEMS", 8)
    rng = np.random.default_rng(2)
    # Whole numbers, so that products are exact.
    users, items = rng.integers(-4, 5, (11, 3)) * scale, rng.integers(-4, 5, (90, 3)).astype(float)
    items[40:80] = items[:40]
    n_seen = rng.integers(0, 30, 11)
    names, ids = [f"u{n}" for n in range(11)], np.array([f"i{n:02d}" for n in range(90)], dtype=object)
    table = pa.table({"personId": names, "factors": kernels.list_column(users), "n_seen": n_seen})
    found = {}
    for batch in kernels.score_block(table, (ids, items), 2):
        for user, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(user, []).append(item)
    for n, user in enumerate(names):
        scores = dict(zip(ids, np.einsum("ij,j->i", items, users[n])))
        assert found[user] == [i for i, _ in brute_topk(scores, n_seen[n] + 2)]


def test_ids_that_score_alike_are_not_all_ranked(monkeypatch):
    """Items whose scores differ by less than single precision tells come first by id, the best ones last."""
    rng = np.random.default_rng(4)
    items = np.r_[rng.standard_normal((40_000, 4)) * 1e-9, rng.random((2_000, 4))]
    users = rng.random((8, 4))
    ranked = []
    keep = kernels._best_rows
    monkeypatch.setattr(kernels, "_best_rows", lambda row, *rest: ranked.append(len(row)) or keep(row, *rest))
    row, col, score = kernels._best_items(users, items, items.astype(np.float32), np.full(8, 5))
    for n in range(8):
        assert col[row == n].tolist() == [i for i, _ in brute_topk(dict(enumerate(items @ users[n])), 5)]
    assert sum(ranked) < 8 * 1_000


def test_factor_topk_without_items(spark):
    users = spark.createDataFrame([("u", [1.0])], "personId string, factors array<double>")
    items = spark.createDataFrame([], "contentId string, factors array<double>")
    assert ranking.factor_topk(users, items, 3).count() == 0


@pytest.mark.parametrize("block_bytes", [None, 1])
def test_weighted_sums(spark, ratings, block_bytes):
    data = random_ratings(5, 20, 15, 0.4, values=(-3, 4), hot_item=2)
    vectors = {f"i{n:03d}": [float(n), 1.0] for n in range(15)}
    table = spark.createDataFrame(list(vectors.items()), "contentId string, factors array<double>")
    found = {r["personId"]: r["factors"] for r in weighted_sums(ratings(data), table, "contentId", "personId", block_bytes).collect()}
    for user in {u for u, _, _ in data}:
        want = sum(np.array(vectors[i]) * v for u, i, v in data if u == user)
        assert np.allclose(found[user], want)


def test_metric_cases(spark, ratings):
    train = ratings([("a", "t", 1.0), ("b", "t", 1.0), ("c", "t", 1.0)])
    test = ratings([("a", "x", 1.0), ("a", "y", 1.0)] + [("b", f"i{n}", 1.0) for n in range(12)])
    recs = spark.createDataFrame(
        [("m", "a", 1, "x", 1.0), ("m", "a", 2, "z", 0.5)] + [("m", "b", n + 1, f"i{n}", 1.0) for n in range(10)] + [("none", "a", 1, "q", 0.0)],
        RECS,
    )
    per_user = {(r["model"], r["personId"]): r["score"] for r in evaluation.hits_per_user(recs, train, test).collect()}
    assert per_user[("m", "a")] == pytest.approx(1 / 2.001)
    assert per_user[("m", "b")] == pytest.approx(1.0)
    assert per_user[("m", "c")] == 0.0
    assert len(per_user) == 6
    rates = dict(rows(evaluation.hit_rate_at_k(recs, train, test)))
    assert rates == {"m": pytest.approx((1 / 2.001 + 1.0) / 3), "none": 0.0}
    assert dict(rows(evaluation.compare(recs, train, test))) == {"m": 0.5, "none": 0.0}


def test_map_at_k(spark, ratings):
    train = ratings([("a", "t", 1.0), ("b", "t", 1.0)])
    test = ratings([("a", "x", 1.0), ("a", "y", 1.0)])
    recs = spark.createDataFrame([("m", "a", 1, "x", 1.0), ("m", "a", 2, "z", 0.5), ("m", "a", 3, "y", 0.4)], RECS)
    assert rows(evaluation.map_at_k(recs, train, test, 3))[0][1] == pytest.approx((1 + 2 / 3) / 2 / 2)


def test_metrics_count_the_train_users_once(spark, ratings, monkeypatch):
    train = ratings([("a", "t", 1.0), ("a", "s", 1.0), ("b", "t", 1.0), (None, "t", 1.0)])
    recs = spark.createDataFrame([("m", "a", 1, "x", 1.0), ("m", "c", 1, "x", 1.0)], RECS)
    test = ratings([("a", "x", 1.0), ("c", "x", 1.0)])
    written = []
    keep = evaluation.cut_lineage
    monkeypatch.setattr(evaluation, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    # Lists of users without train rows do not count, nor does a null user.
    assert rows(evaluation.hit_rate_at_k(recs, train, test)) == [("m", pytest.approx(1 / 1.001 / 2))]
    assert rows(evaluation.map_at_k(recs, train, test)) == [("m", pytest.approx(1 / 2))]
    assert written == [["personId", "n_train", "n_test"]] * 2


def test_wide_lists(spark):
    recs = spark.createDataFrame([("m", "u", 2, "b", 0.1), ("m", "u", 1, "z", 0.2)], RECS)
    assert evaluation.recs_wide(recs).first()["items"] == ["z", "b"]


def test_lists_longer_than_k_are_cut(spark, ratings):
    train, test = ratings([("u", "seen", 1.0)]), ratings([("u", f"i{n}", 1.0) for n in range(10)])
    recs = spark.createDataFrame(
        [("m", "u", n + 1, f"i{n}", 1.0 - n / 10) for n in range(10)],
        "model string, personId string, rank int, contentId string, score double",
    )
    assert evaluation.hit_rate_at_k(recs, train, test, 5).first()["score"] == 1.0
    assert evaluation.hits_per_user(recs, train, test, 5).first()["hits"] == 5
