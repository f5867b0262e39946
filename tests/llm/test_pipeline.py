from __future__ import annotations

import corpus_pipeline

from shelfwise.llm import decontam
from shelfwise.llm.quality import CUT, learn, features
from shelfwise.settings import cut_lineage

from .conftest import SF
from .test_simhash import classes, fingerprint

import numpy as np


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    ids = [sorted(r["doc_id"] for r in rows) for rows in kept]
    ranker = learn(source, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {d: ranker.score(np.array([features(t.encode())]))[0] for d, t in texts.items()}
    assert ids[0] == sorted(d for d in texts if score[d] >= CUT)
    prints = [(d, fingerprint(texts[d])) for d in ids[0]]
    assert ids[1] == sorted(set(classes(prints)))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontam.leak_report(source, bench).collect()}
    assert ids[2] == [d for d in ids[1] if d not in leaked]
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(d) for d in ids[3]) <= 3
    assert ids[4] == ids[3] and {r["shard"] for r in kept[4]} <= set(range(16))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == ids[4]


def folder(spark, path, docs, labels=(), benchmark=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_odd_rows_and_clashing_names(spark, corpus, odd_rows, tmp_path):
    clean = [(10 + i, " ".join(f"w{i}x{k}" for k in range(40)), "c") for i in range(6)]
    leak = (30, "a b " + clean[0][1].replace("w0", "leak") + " c", "c")
    sf_dir = folder(spark, tmp_path, corpus([*odd_rows, *clean, leak]), benchmark=[(1, clean[0][1].replace("w0", "leak")), (2, None)])
    stages = kept_by_stage(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [s.columns for s in stages[:4]] == [source.columns] * 4
    ids = [sorted((r["doc_id"] for r in s.collect()), key=str) for s in stages]
    everything = sorted((r["doc_id"] for r in source.collect()), key=str)
    assert ids[0] == everything
    # One of the equal texts, one of those without words, and every other text.
    assert ids[1] == sorted([1, 2, 5, 6, *range(10, 16), 30], key=str)
    assert ids[2] == [d for d in ids[1] if d != 30]
    assert set(ids[3]) <= set(ids[2]) and set(range(10, 16)) <= set(ids[3]) and 2 not in ids[3]
    assert ids[4] == ids[3]
    assert sorted((r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()), key=str) == ids[4]


def test_empty_tables(spark, corpus, tmp_path):
    sf_dir = folder(spark, tmp_path, corpus([]))
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "size"]
