from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import mixing

from .conftest import SF


def fill(sizes, weights, most=3.0):
    """Water filling round by round: who is over its cap stops there, the rest shares again."""
    target, live, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while live:
        total = sum(weights[s] for s in live)
        full = {s for s in live if left * weights[s] / total >= most * sizes[s]}
        if not full:
            for s in live:
                target[s] = left * weights[s] / total
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        live -= full
    return target


def test_targets_match_filling_round_by_round(spark):
    sizes = {"a": 100, "b": 3, "c": 40, "d": 0, "é": 7, None: 55}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]), None]
    expected = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert got == pytest.approx(expected)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_report_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_report(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]))
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sorted(rows) == sorted(mixing.mix_report(docs).collect())


def test_taken_words_come_near_the_targets(spark, corpus):
    docs = corpus([(i, "w " * (1 + i * 7919 % 300), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)])
    taken, target = defaultdict(int), {}
    for r in mixing.mix_report(docs).collect():
        source = r["doc_id"] % 5 if r["doc_id"] % 3 else "hot"
        taken[source] += r["taken"]
        target[source] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 600


def test_mix_emits_rows_as_often_as_the_report_says(spark, corpus, odd_rows):
    docs = corpus(odd_rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    report = mixing.mix_report(docs)
    assert report.count() == len(odd_rows)
    words = mixed.agg(F.sum(mixing.word_count())).first()[0] or 0
    assert words == report.agg(F.sum("taken")).first()[0]
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies[1] % 2 == 0  # both rows of a repeated document alike


def test_empty_table(corpus):
    assert mixing.mix_report(corpus([])).count() == 0
    assert mixing.mix(corpus([])).count() == 0
