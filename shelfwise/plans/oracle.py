"""The registered queries as plain SQL, for a second engine over the same tables."""

from __future__ import annotations

import re

MIN_ITEMS = 30
SEED = 42
K = 10

# Named steps; a query gets the steps whose names it reads.
_STEPS = {
    "interactions": """
        SELECT CAST(o_custkey AS VARCHAR) AS "personId", CAST(l_partkey AS VARCHAR) AS "contentId",
               CAST(l_quantity AS DOUBLE) AS result
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "asset": """
        SELECT CAST(p_partkey AS VARCHAR) AS "contentId", CAST(p_size AS DOUBLE) AS asset
        FROM part WHERE p_size > 5""",
    "price": """
        SELECT CAST(p_partkey AS VARCHAR) AS "contentId", p_retailprice / 1000 AS price
        FROM part WHERE p_retailprice >= 950""",
    "subclass": """
        SELECT CAST(p_partkey AS VARCHAR) AS "contentId", CAST(p_size AS BIGINT) AS category_no,
               CAST(1 AS DOUBLE) AS category_flag
        FROM part WHERE p_size < 46
        UNION ALL
        SELECT CAST(p_partkey AS VARCHAR), CAST(p_size + 100 AS BIGINT), CAST(1 AS DOUBLE)
        FROM part WHERE p_size > 40""",
    "items": """
        SELECT * FROM asset FULL OUTER JOIN price USING ("contentId") FULL OUTER JOIN subclass USING ("contentId")""",
    "age": """
        SELECT CAST(c_custkey AS VARCHAR) AS "personId", c_acctbal / 10000 AS age
        FROM customer WHERE c_acctbal > 0""",
    "region_one": """
        SELECT CAST(c_custkey AS VARCHAR) AS "personId", CAST(c_nationkey AS BIGINT) AS region_no,
               CAST(1 AS DOUBLE) AS region_flag
        FROM customer WHERE c_nationkey <> 7""",
    "region_multi": """
        SELECT * FROM region_one
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), CAST(c_nationkey + 25 AS BIGINT), CAST(1 AS DOUBLE)
        FROM customer WHERE c_acctbal > 9000""",
    "people": """SELECT * FROM region_one FULL OUTER JOIN age USING ("personId")""",
    "people_multi": """SELECT * FROM region_multi FULL OUTER JOIN age USING ("personId")""",
    "pairs": """
        SELECT "personId", "contentId", coalesce(sum(result), 0.0) AS result FROM interactions GROUP BY 1, 2""",
    "active": f"""
        SELECT "personId", count(*) AS n_items FROM pairs GROUP BY 1 HAVING count(*) >= {MIN_ITEMS}""",
    "collapsed": """SELECT * FROM pairs WHERE "personId" IN (SELECT "personId" FROM active)""",
    "assigned": f"""
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY "personId"
                      ORDER BY md5("personId" || '|' || "contentId" || '|{SEED}'), "contentId")
                    <= floor(count(*) OVER (PARTITION BY "personId") * 0.2 + 0.5)
                  THEN 'test' ELSE 'train' END AS split
        FROM collapsed""",
    "train": """SELECT "personId", "contentId", result FROM assigned WHERE split = 'train'""",
    "test": """SELECT "personId", "contentId", result FROM assigned WHERE split = 'test'""",
    "users": """SELECT DISTINCT "personId" FROM train""",
    "cat": """SELECT DISTINCT "contentId" FROM train""",
    "popular": """
        SELECT "contentId", score, row_number() OVER (ORDER BY round(score, 9) DESC, "contentId") AS pop_rank
        FROM (SELECT "contentId", sum(result) AS score FROM train GROUP BY 1)""",
    "popular_recs": f"""
        SELECT 'popularity' AS model, "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", score
        FROM (SELECT u."personId", p."contentId", p.score,
                     row_number() OVER (PARTITION BY u."personId" ORDER BY p.pop_rank) AS "rank"
              FROM users u CROSS JOIN popular p
              WHERE p.pop_rank <= {K} + (SELECT max(n_items) FROM active)
                AND NOT EXISTS (SELECT 1 FROM train t
                                WHERE t."personId" = u."personId" AND t."contentId" = p."contentId"))
        WHERE "rank" <= {K}""",
    "n_test": """
        SELECT u."personId", count(t."contentId") AS n_test
        FROM users u LEFT JOIN test t ON t."personId" = u."personId" GROUP BY 1""",
    "alike": """
        SELECT a."personId" AS u, b."personId" AS v, round(corr(a.result, b.result), 9) AS sim
        FROM train a JOIN train b ON a."contentId" = b."contentId" AND a."personId" < b."personId"
        WHERE a.result <> 0 AND b.result <> 0
        GROUP BY 1, 2
        HAVING min(a.result) < max(a.result) AND min(b.result) < max(b.result)""",
    "links": """
        SELECT u AS "personId", v AS neighbour, sim FROM alike
        UNION ALL SELECT v, u, sim FROM alike""",
    "cf": """
        SELECT b."personId", t."contentId", sum(t.result) AS score
        FROM links b JOIN train t ON t."personId" = b.neighbour
        WHERE b.sim > 0 GROUP BY 1, 2""",
    "cf_unseen": """
        SELECT c.* FROM cf c WHERE NOT EXISTS (SELECT 1 FROM train t
            WHERE t."personId" = c."personId" AND t."contentId" = c."contentId")""",
    "cf_recs": f"""
        SELECT 'neighbours' AS model, "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", score
        FROM (SELECT *, row_number() OVER (PARTITION BY "personId"
                        ORDER BY round(score, 9) DESC, "contentId") AS "rank" FROM cf_unseen)
        WHERE "rank" <= {K}""",
    "user_no": """
        SELECT "personId", row_number() OVER (ORDER BY md5("personId"), "personId") - 1 AS user_no FROM users""",
    "item_no": """
        SELECT "contentId", row_number() OVER (ORDER BY md5("contentId"), "contentId") - 1 AS item_no FROM cat""",
}


def _sample(name: str, wanted: str, exclude: bool) -> str:
    """Steps of a negative sample: the first n distinct free pairs among draws, or all where all are wanted."""
    taken = """WHERE NOT EXISTS (SELECT 1 FROM train t JOIN user_no u USING ("personId") JOIN item_no i USING ("contentId")
                        WHERE u.user_no = d.user_no AND i.item_no = d.item_no)""" if exclude else ""
    free = "count(*) FROM train" if exclude else "0"
    number = "CAST('0x' || substr(md5('{seed}|{side}|' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT)"
    user = number.format(seed=SEED, side="user")
    item = number.format(seed=SEED, side="item")
    return f"""{name}_size AS (
        SELECT n_users, n_items, least({wanted}, free) AS n, free FROM (
            SELECT (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM cat) AS n_items,
                   (SELECT count(*) FROM users) * (SELECT count(*) FROM cat) - (SELECT {free}) AS free)),
    {name}_draw AS (
        SELECT id, {user} % (SELECT n_users FROM {name}_size) AS user_no,
               {item} % (SELECT n_items FROM {name}_size) AS item_no
        FROM (SELECT unnest(range(0, (SELECT CASE WHEN n < free THEN CAST(
            (1.5 * ln(free / (free - n)) + 10 * sqrt(n) / free) * n_users * n_items + 1000 AS BIGINT) ELSE 0 END
            FROM {name}_size))) AS id)),
    {name}_first AS (
        SELECT user_no, item_no, min(id) AS id FROM {name}_draw d {taken} GROUP BY 1, 2),
    {name}_no AS (
        SELECT user_no, item_no FROM (
            SELECT user_no, item_no, row_number() OVER (ORDER BY id) AS r FROM {name}_first)
        WHERE r <= (SELECT n FROM {name}_size)
        UNION ALL
        SELECT user_no, item_no FROM (SELECT u.user_no, i.item_no FROM user_no u CROSS JOIN item_no i
            WHERE (SELECT n = free FROM {name}_size)) d {taken}),
    {name} AS (
        SELECT "personId", "contentId" FROM {name}_no JOIN user_no USING (user_no) JOIN item_no USING (item_no))"""


_SAMPLES = {
    "negatives": _sample("negatives", "4 * (SELECT count(*) FROM train)", False),
    "free_negatives": _sample("free_negatives", "4 * (SELECT count(*) FROM train)", True),
    "fm_negatives": _sample("fm_negatives", "100000", False),
}


def _needed(text: str) -> list[str]:
    """The steps ``text`` reads, directly or through others, in definition order."""
    found: set[str] = set()

    def visit(sql: str) -> None:
        for name, body in {**_STEPS, **_SAMPLES}.items():
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                found.add(name)
                visit(body)

    visit(text)
    return [name for name in {**_STEPS, **_SAMPLES} if name in found]


def _query(text: str) -> str:
    steps = [_SAMPLES[name] if name in _SAMPLES else f"{name} AS ({_STEPS[name]})" for name in _needed(text)]
    return ("WITH " + ",\n    ".join(steps) + "\n" if steps else "") + text


def _hit_rate(recs: str, tests: str = "test", digits: int = 9) -> str:
    return f"""
        SELECT m.model, round(avg(coalesce(h.hits, 0) / least(n.n_test + 0.001, {float(K)})), {digits}) AS score
        FROM (SELECT DISTINCT model FROM {recs}) m CROSS JOIN
             (SELECT u."personId", count(t."contentId") AS n_test
              FROM users u LEFT JOIN {tests} t ON t."personId" = u."personId" GROUP BY 1) n
        LEFT JOIN (SELECT r.model, r."personId", count(*) AS hits
                   FROM {recs} r JOIN {tests} t ON t."personId" = r."personId" AND t."contentId" = r."contentId"
                   GROUP BY 1, 2) h ON h."personId" = n."personId" AND h.model = m.model
        GROUP BY 1"""


_ALL_BUT = f"""
    SELECT 'neighbours' AS model, "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", score FROM (
        SELECT "personId", "contentId", score,
               row_number() OVER (PARTITION BY "personId" ORDER BY round(score, 9) DESC, "contentId") AS "rank"
        FROM (SELECT u."personId", p."contentId", p.score - coalesce(m.minus, 0) AS score
              FROM users u CROSS JOIN popular p
              LEFT JOIN (SELECT b."personId", t."contentId", sum(t.result) AS minus
                         FROM links b JOIN train t ON t."personId" = b.neighbour
                         WHERE b.sim <= -0.5 GROUP BY 1, 2) m
                ON m."personId" = u."personId" AND m."contentId" = p."contentId"
              LEFT JOIN train t ON t."personId" = u."personId" AND t."contentId" = p."contentId"
              WHERE t."personId" IS NULL))
    WHERE "rank" <= {K}"""

_FILLED = f"""
    SELECT 'neighbours' AS model, "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", score FROM (
        SELECT u."personId", p."contentId", coalesce(c.score, 0.0) AS score,
               row_number() OVER (PARTITION BY u."personId" ORDER BY (c.score IS NULL)::INT,
                                  round(c.score, 9) DESC, CASE WHEN c.score IS NULL THEN p.pop_rank END,
                                  p."contentId") AS "rank"
        FROM users u CROSS JOIN popular p
        LEFT JOIN (SELECT b."personId", t."contentId", sum(t.result) AS score
                   FROM links b JOIN train t ON t."personId" = b.neighbour
                   WHERE b.sim > 0.9999 GROUP BY 1, 2) c
          ON c."personId" = u."personId" AND c."contentId" = p."contentId"
        LEFT JOIN train t ON t."personId" = u."personId" AND t."contentId" = p."contentId"
        WHERE t."personId" IS NULL)
    WHERE "rank" <= {K}"""

_BODIES = {
    "scan_interactions": "SELECT * FROM interactions",
    "item_info": "SELECT * REPLACE (CAST(category_no AS DOUBLE) AS category_no) FROM items",
    "user_info": "SELECT * REPLACE (CAST(region_no AS DOUBLE) AS region_no) FROM people",
    "interactions_users": """
        SELECT * REPLACE (CAST(region_no AS DOUBLE) AS region_no) FROM interactions LEFT JOIN people USING ("personId")""",
    "item_info_fanout": """
        SELECT "contentId", count(*) AS feature_rows FROM items
        WHERE "contentId" IN (SELECT "contentId" FROM cat) GROUP BY 1""",
    "active_users": "SELECT * FROM active",
    "active_interactions": """SELECT * FROM interactions WHERE "personId" IN (SELECT "personId" FROM active)""",
    "collapsed_interactions": "SELECT * FROM collapsed",
    "collapsed_with_fanout": """
        SELECT "personId", "contentId", coalesce(sum(result), 0.0) AS result
        FROM interactions LEFT JOIN people_multi USING ("personId")
        WHERE "personId" IN (SELECT "personId" FROM active) GROUP BY 1, 2""",
    "split_assignment": "SELECT * FROM assigned",
    "split_exact_total": f"""
        SELECT c.*, CASE WHEN row_number() OVER (PARTITION BY "personId"
                      ORDER BY md5("personId" || '|' || "contentId" || '|{SEED}'), "contentId")
                    <= s.whole + CASE WHEN s.place <= s.total - s.given THEN 1 ELSE 0 END
                  THEN 'test' ELSE 'train' END AS split
        FROM collapsed c JOIN (
            SELECT *, sum(whole) OVER () AS given,
                   row_number() OVER (ORDER BY rest DESC, md5("personId" || '|{SEED}'), "personId") AS place
            FROM (SELECT "personId", count(*) * t.total // t.n AS whole, count(*) * t.total % t.n AS rest, t.total
                  FROM collapsed, (SELECT count(*) AS n, CAST(ceil(count(*) * 2 / 10.0) AS BIGINT) AS total
                                   FROM collapsed) t
                  GROUP BY "personId", t.total, t.n)) s USING ("personId")""",
    "ground_truth": """
        SELECT a."personId", a.n_train, n.n_test, a.true_train, coalesce(b.true_test, '') AS true_test
        FROM (SELECT "personId", count(*) AS n_train, string_agg("contentId", ',' ORDER BY "contentId") AS true_train
              FROM train GROUP BY 1) a
        JOIN n_test n USING ("personId")
        LEFT JOIN (SELECT "personId", string_agg("contentId", ',' ORDER BY "contentId") AS true_test
                   FROM test GROUP BY 1) b USING ("personId")""",
    "rating_cells": """SELECT "personId", "contentId", avg(result) AS result FROM train GROUP BY 1, 2""",
    "catalogue": "SELECT * FROM cat",
    "user_item_grid": """
        SELECT u."personId", count(*) AS n_candidates FROM users u CROSS JOIN cat c GROUP BY 1""",
    "item_popularity": """SELECT "contentId", score FROM popular""",
    "top_items": f"""SELECT "contentId", score FROM popular WHERE pop_rank <= {K}""",
    "candidates_unseen": f"""
        SELECT u."personId", p.pop_rank
        FROM users u CROSS JOIN popular p
        JOIN (SELECT u."personId", count(p.pop_rank) AS c
              FROM users u LEFT JOIN train t ON t."personId" = u."personId"
              LEFT JOIN popular p ON p."contentId" = t."contentId"
                AND p.pop_rank <= {K} + (SELECT count(*) FROM train o WHERE o."personId" = u."personId")
              GROUP BY 1) s ON s."personId" = u."personId"
        LEFT JOIN train t ON t."personId" = u."personId" AND t."contentId" = p."contentId"
        WHERE p.pop_rank <= {K} + s.c AND t."personId" IS NULL""",
    "popularity_topk": "SELECT * FROM popular_recs",
    "recs_round_trip": "SELECT * FROM popular_recs",
    "load_rejects": """
        SELECT CASE kind WHEN 0 THEN 'value' WHEN 1 THEN 'fields' WHEN 2 THEN 'id' ELSE 'number' END AS reason, count(*) AS n
        FROM (SELECT (o_custkey * 31 + l_partkey * 7) % 20 AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey) k
        WHERE kind < 4 GROUP BY 1""",
    "load_kept": """
        SELECT o_custkey::VARCHAR AS "personId", l_partkey::VARCHAR AS "contentId", l_quantity::DOUBLE AS result
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (o_custkey * 31 + l_partkey * 7) % 20 > 3""",
    "dropped_rows": "SELECT count(*) AS dropped FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 WHERE p_partkey IS NULL",
    "svd_gram_check": """
        SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS dot, 0.0::DOUBLE AS residual
        FROM (SELECT unnest(range(least(100, (SELECT count(*) FROM cat)))) AS i) a,
             (SELECT unnest(range(least(100, (SELECT count(*) FROM cat)))) AS j) b""",
    "learned_list_check": f"""
        SELECT m.model, u."personId", least({K}, (SELECT count(*) FROM cat) - count(*)) AS n, true AS ranks_whole,
               true AS scores_fall, 0 AS n_seen
        FROM train u CROSS JOIN (VALUES ('svd'), ('content'), ('fm')) m(model) GROUP BY 1, 2""",
    "recs_by_model": """
        SELECT "personId", string_agg("contentId", ',' ORDER BY "rank") AS popularity,
               coalesce(string_agg("contentId", ',' ORDER BY "rank") FILTER ("rank" <= 3), '') AS top3, '' AS "none"
        FROM popular_recs GROUP BY 1""",
    "recs_wide": """
        SELECT model, "personId", string_agg("contentId", ',' ORDER BY "rank") AS items
        FROM popular_recs GROUP BY 1, 2""",
    "hits_per_user": f"""
        SELECT 'popularity' AS model, n."personId", coalesce(h.hits, 0) AS hits, n.n_test,
               round(coalesce(h.hits, 0) / least(n.n_test + 0.001, {float(K)}), 9) AS score
        FROM n_test n LEFT JOIN
             (SELECT r."personId", count(*) AS hits FROM popular_recs r
              JOIN test t ON t."personId" = r."personId" AND t."contentId" = r."contentId" GROUP BY 1) h
             ON h."personId" = n."personId" """,
    "hit_rate_popularity": _hit_rate("popular_recs"),
    "hit_rate_empty_test": _hit_rate(
        "popular_recs", "(SELECT * FROM test WHERE result > (SELECT avg(result) FROM test))"
    ),
    "map_at_k": f"""
        SELECT 'popularity' AS model,
               round(avg(coalesce(h.total, 0) / least(greatest(n.n_test, 1), {K})), 9) AS score
        FROM n_test n LEFT JOIN
             (SELECT "personId", sum(nth / "rank") AS total FROM (
                SELECT r."personId", r."rank",
                       row_number() OVER (PARTITION BY r."personId" ORDER BY r."rank") AS nth
                FROM popular_recs r JOIN test t ON t."personId" = r."personId" AND t."contentId" = r."contentId")
              GROUP BY 1) h ON h."personId" = n."personId" """,
    "user_similarity": "SELECT * FROM alike",
    "cf_neighbours": "SELECT * FROM links WHERE sim > 0",
    "cf_scores": "SELECT * FROM cf",
    "cf_topk": "SELECT * FROM cf_recs",
    "cf_topk_with_seen": f"""
        SELECT 'neighbours' AS model, "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", score
        FROM (SELECT *, row_number() OVER (PARTITION BY "personId"
                        ORDER BY round(score, 9) DESC, "contentId") AS "rank" FROM cf)
        WHERE "rank" <= {K}""",
    "cf_topk_alpha_negative": _ALL_BUT,
    "cf_topk_fill_popular": _FILLED,
    "hit_rate_cf": _hit_rate("cf_recs"),
    "factor_topk": f"""
        SELECT "personId", CAST("rank" AS INTEGER) AS "rank", "contentId", round(round(score, 9), 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY "personId"
                        ORDER BY round(score, 9) DESC, "contentId") AS "rank"
              FROM (SELECT CAST(a.vec_id AS VARCHAR) AS "personId", CAST(b.vec_id AS VARCHAR) AS "contentId",
                           list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
                    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
        WHERE "rank" <= {K}""",
    "negative_pairs": "SELECT * FROM negatives",
    "negative_pairs_excluding_positives": "SELECT * FROM free_negatives",
    "content_train": """
        SELECT "contentId", asset, price, CAST(category_no AS DOUBLE) AS category_no, label
        FROM (SELECT "contentId", result AS label FROM train
              UNION ALL SELECT "contentId", 0.0 FROM negatives) l
        LEFT JOIN items USING ("contentId")""",
    "content_candidates": """
        SELECT i."contentId", i.asset, i.price, CAST(i.category_no AS DOUBLE) AS category_no,
               (SELECT count(*) FROM users) - coalesce(s.seen_by, 0) AS n_users
        FROM items i LEFT JOIN
             (SELECT "contentId", count(DISTINCT "personId") AS seen_by FROM train GROUP BY 1) s USING ("contentId")""",
    "fm_train": """
        SELECT "personId", "contentId", result AS label FROM train
        UNION ALL SELECT "personId", "contentId", 0.0 FROM fm_negatives""",
    "model_comparison": _hit_rate("(SELECT * FROM popular_recs UNION ALL SELECT * FROM cf_recs)", digits=3),
}

ORACLE_SQL: dict[str, str] = {name: _query(body) for name, body in _BODIES.items()}
