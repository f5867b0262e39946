from __future__ import annotations

import numpy as np


def rows(df, *columns):
    """Sorted tuples of the named columns, or of all."""
    picked = df.select(*columns) if columns else df
    return sorted(tuple(row) for row in picked.collect())


def random_ratings(seed, users, items, share, values=(1, 6), hot_item=None, hot_user=None):
    """Random (user, item, value) rows; optionally one item or user with everything."""
    rng = np.random.default_rng(seed)
    found = {}
    for u in range(users):
        for i in range(items):
            if rng.random() < share or i == hot_item or u == hot_user:
                found[(f"u{u:03d}", f"i{i:03d}")] = float(rng.integers(*values))
    return [(u, i, v) for (u, i), v in found.items()]


def dense(data):
    users = sorted({u for u, _, _ in data})
    items = sorted({i for _, i, _ in data})
    matrix = np.zeros((len(users), len(items)))
    for u, i, v in data:
        matrix[users.index(u), items.index(i)] = v
    return users, items, matrix


def brute_similarity(data):
    """{(u, v): correlation} by definition."""
    users, _, matrix = dense(data)
    found = {}
    for a in range(len(users)):
        for b in range(a + 1, len(users)):
            common = (matrix[a] != 0) & (matrix[b] != 0)
            x, y = matrix[a][common], matrix[b][common]
            if len(np.unique(x)) > 1 and len(np.unique(y)) > 1:
                found[(users[a], users[b])] = round(float(np.corrcoef(x, y)[0, 1]), 9)
    return found


def brute_topk(scores, k):
    """Best k (item, score) of {item: score} by the ranking rule."""
    return sorted(scores.items(), key=lambda pair: (-round(pair[1], 9), pair[0]))[:k]


def lists(recs):
    """{user: [item, ...]} in rank order, after checking that ranks have no gaps."""
    found = {}
    for row in sorted(recs.collect(), key=lambda r: (r["personId"], r["rank"])):
        found.setdefault(row["personId"], []).append(row["contentId"])
        assert row["rank"] == len(found[row["personId"]])
    return found
