from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash
from shelfwise.llm.components import components

from .conftest import SF


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, distance=2):
    """Component of each (id, fingerprint) by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_report_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    expected = {(d, f"{p:016x}", c) for (d, p), c in zip(prints, classes(prints), strict=True)}
    assert {tuple(r) for r in simhash.simhash_report(docs).collect()} == expected


def test_odd_rows(corpus, odd_rows):
    got = simhash.simhash_report(corpus(odd_rows)).collect()
    prints = [(d, fingerprint(t)) for d, t, _ in odd_rows]
    expected = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, classes(prints), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert simhash.simhash_report(corpus([])).count() == 0


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_join_what_all_pairs_join(spark, bucket):
    """Clusters, chains and lone fingerprints; a small bucket forces the finer blocks."""
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fingerprint long")
    edges = simhash.close_links(rows, 2, bucket).collect()
    for e in edges:
        assert ((e["u"] ^ e["v"]) & (2**64 - 1)).bit_count() <= 64
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    expected = classes(list(zip(signed, values, strict=True)))
    assert [roots.get(s, s) for s in signed] == expected


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), (1, 0)], "u long, v long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000)}


def test_one_row_of_each_component_stays(corpus, odd_rows):
    docs = corpus(odd_rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in simhash.simhash_report(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    assert simhash.drop_near_copies(corpus([])).count() == 0
