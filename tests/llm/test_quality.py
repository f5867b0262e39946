from __future__ import annotations

import zlib

import numpy as np

from shelfwise.llm import quality

from .conftest import SF


def test_held_out_accuracy_and_columns(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good = np.array([r["score"] for r, q in held if q == 1])
    bad = np.array([r["score"] for r, q in held if q == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) AS quality"
    )
    one, two = (quality.learn(docs, x) for x in (labels, flipped))
    assert np.allclose(one.weights, two.weights) and one.threshold == two.threshold


def test_threshold_covers_all_labels(spark):
    """However small the sample of the fit, the share of label 0 lies under the threshold."""
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for per_label in (5, 12):
        rows = quality.quality_report(docs, labels, per_label).collect()
        seen = [(r["predicted"], quality_of[r["doc_id"]]) for r in rows if r["doc_id"] in quality_of and not r["held_out"]]
        rejected, zeros = (sum(x[i] == 0 for x in seen) for i in (0, 1))
        assert len(seen) > 100 and abs(rejected - zeros) <= 1


def test_weights_rise_with_preference_and_threshold_is_the_quantile():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1, 1, (900, 3)), rng.normal(-1, 1, (300, 3))
    ranker = quality.fit_pairs(good, bad, 0.25)
    assert ranker.score(good).mean() > ranker.score(bad).mean() + 0.3
    assert abs((np.concatenate([ranker.score(good), ranker.score(bad)]) < quality.CUT).mean() - 0.25) < 0.01


def test_odd_rows(spark, corpus, odd_rows):
    docs = corpus(odd_rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 1), (6, 1), (6, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == len(odd_rows)
    assert {r["score"] for r in rows if r["doc_id"] == 2} == {r["score"] for r in rows if r["doc_id"] == 3}
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    kept = quality.drop_rejected(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert quality.quality_report(corpus([]), labels).count() == 0
