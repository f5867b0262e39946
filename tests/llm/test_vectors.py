from __future__ import annotations

import math

import numpy as np
import pytest

from shelfwise.llm import vectors

from .conftest import SF


def brute(rows, cosine=0.93):
    usable = {}
    for k, (_, x, label) in enumerate(rows):
        if label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            v = np.array(x, float) / np.abs(x).max()
            usable[k] = (label, v / np.linalg.norm(v))
    near = {k: [] for k in range(len(rows))}
    for i, (a, x) in usable.items():
        for j, (b, y) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= cosine:
                near[i].append(j)
    out = []
    for k, (d, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((d, len(near[k]), least, d is not None and d == least))
    return sorted(out, key=str)


def report(df, **settings):
    return sorted(map(tuple, vectors.link_report(df, **settings).collect()), key=str)


def test_table_recall_is_whole(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert report(df) == brute(rows)


@pytest.mark.parametrize("settings", [{}, {"rows": 16, "centres": 5}, {"sample": 20, "codewords": 4}])
def test_crowds_chains_and_odd_vectors(spark, settings):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        x = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), x.tolist(), int(rng.integers(2))))
            x = x + rng.normal(size=16) * 0.2
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [None] * 16, 1), (2004, [float("nan")] * 16, 1),
        (2005, [float("inf")] + [1.0] * 15, 1), (2006, rows[0][1], None), (None, rows[0][1], rows[0][2]),
        (5, rows[5][1], rows[5][2]), (2007, [1e200] * 16, 0), (2008, [1e-200] * 16, 0), (2009, [1.0, 2.0], 0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    assert report(df, **settings) == brute(rows)


def test_without_usable_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert report(df) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert report(df.limit(0)) == []


def test_lookup_distances_are_within_the_coding_error():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = vectors.Quantiser.fit(x[:200], 8, 6, 16, 1)
    home, codes, error = q.code(x)
    assert (error > 0).all()
    for h in range(8):
        own = home == h
        near = vectors._distances(x, x[own]) <= 0.6**2
        assert (q.passing(x, h, codes[own], error[own], 0.6) >= near).all()


def test_of_two_near_vectors_one_visits_the_other(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()
    rng = np.random.default_rng(9)
    x = np.array([r[0] for r in given], float)
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.25 * np.abs(x).mean(), rng.normal(size=(200, x.shape[1]))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = math.sqrt(2 - 2 * 0.93)
    for centres in (2, 24):
        q = vectors.Quantiser.fit(x, centres, 8, 16, 1)
        home, visits = q.code(x)[0], q.probes(x, reach)
        i, j = np.nonzero(x @ x.T >= 0.93)
        assert len(i) > len(x) and (visits[i, home[j]] | visits[j, home[i]]).all()
    assert visits.mean() < 0.7


def test_a_crowd_leaves_a_task_as_counts_not_pairs(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(k, 1, v.tolist(), 1) for k, v in enumerate(x)], "rep long, label int, unit array<double>, n long")
    found = vectors._links(units, vectors.Quantiser.fit(x, 4, 4, 16, 1), 0.93, 1024).collect()
    assert len(found) <= 4 * 4 * 2 * 300
    links = {}
    for r in found:
        if r["other"] is None:
            links[r["rep"]] = links.get(r["rep"], 0) + r["links"]
    assert links == {k: 299 for k in range(300)}
