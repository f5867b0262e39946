from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import substrings
from shelfwise.llm.licenses import Automaton
from shelfwise.llm.tables import Hashes, rolled

from .conftest import SF


def brute(rows, width=13):
    windows = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    order = [(float("inf") if d is None else d, w) for d, w in split]
    for d, w in order:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            windows[key] = min(d, windows.get(key, d))
    out = []
    for (d, _), (o, w) in zip(split, order, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if windows[tuple(w[k : k + width])] < o:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(docs, **settings):
    return sorted(map(tuple, substrings.passage_report(docs, **settings).collect()), key=str)


def test_automaton_gives_matching_statistics():
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(40)] for _ in range(6)]
    automaton = Automaton()
    for t in texts:
        automaton.add(t)
    known = {tuple(t[a:b]) for t in texts for a in range(41) for b in range(a, 41)}
    query = [rng.randrange(4) for _ in range(300)]
    state = matched = 0
    for i, word in enumerate(query):
        state, matched = automaton.step(state, matched, word)
        longest = max(n for n in range(i + 2) if tuple(query[i + 1 - n : i + 1]) in known)
        assert matched == longest


@pytest.mark.parametrize("settings", [{}, {"bits": 8}, {"seen": 1}])
def test_small_vocabulary_against_all_windows(corpus, settings):
    """Common words, passages copied with changes, repeats inside one text, tied and null ids."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(10, 90))] for _ in range(12)]
    rows = []
    for d in range(60):
        words = list(rng.choice(base)) + list(rng.choice(base))[: rng.randrange(60)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "x"
        rows.append((None if d % 17 == 3 else d // 2, " ".join(words), "a"))
    rows += [(100, "of " * 400, "a"), (101, "of " * 50, "b"), (99, "of " * 13, "b")]
    assert report(corpus(rows), **settings) == brute([r[:2] for r in rows])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[2] for r in expected) > 1000
    assert report(docs) == expected


@pytest.mark.parametrize("settings", [{"crowd": 1}, {"crowd": 3, "bits": 8}, {"crowd": 2, "seen": 1}])
def test_crowded_anchors_give_the_same(corpus, settings):
    """As above, with most anchors split by window."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(40)}" for _ in range(40)] for _ in range(8)]
    rows = [(d // 2, " ".join(rng.choice(base)[rng.randrange(9) :] + rng.choice(base)), "a") for d in range(60)]
    rows += [(100, "of " * 90, "a"), (None, "of " * 50, "b"), (99, "of " * 13, "b")]
    assert report(corpus(rows), **settings) == brute([r[:2] for r in rows])


def test_a_short_phrase_in_many_documents_does_not_gather(corpus, monkeypatch):
    """A phrase shorter than a window, other words around it each time: no shard grows with the documents."""
    rng = random.Random(6)
    hashes = Hashes()
    phrases = [[f"p{k}_{i}" for i in range(6)] for k in range(2000)]
    phrase = min(phrases, key=lambda p: int(rolled(hashes.of([w.encode() for w in p]), 5).min()))
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(d, " ".join(noise(15) + phrase + noise(15)), "a") for d in range(400)]
    rows += [(1000 + d, rows[d][1] + " end", "a") for d in range(0, 400, 9)]
    gathered = Counter()
    asked = substrings._asked

    def watched(*args):
        out = asked(*args).cache()
        gathered.update({r["h"]: r["n"] for r in out.where("n > 0").groupBy("h").agg(F.count_distinct("words").alias("n")).collect()})
        return out

    monkeypatch.setattr(substrings, "_asked", watched)
    assert report(corpus(rows), crowd=50) == brute([r[:2] for r in rows])
    assert max(n for n in gathered.values()) <= 50


def test_words_that_share_half_a_hash_are_different(corpus):
    """These two first words agree in 32 bits of their hashes."""
    rest = "c885440 c403958 c794772 c933488 c441001 c42450 c271493 c536110 c509532 c424604 c962838 c821872"
    low = [Hashes()[w.encode()] & 0xFFFFFFFF for w in ("tok17480", "tok29079")]
    assert low[0] == low[1]
    rows = [(1, f"tok17480 {rest}", "a"), (2, f"tok29079 {rest}", "a"), (3, f"tok29079 {rest}", "a")]
    got = report(corpus(rows))
    assert got == brute([r[:2] for r in rows]) and [r[2] for r in got] == [0, 0, 13]


def test_many_copies_of_a_row_share_one_answer(spark, corpus):
    """A row repeated with a null id, after a document that has its words: answers do not grow with the copies."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = corpus([(1, f"{text} more", "a")] + [(None, text, "a")]).repartition(1)
    many = docs.where("doc_id is not null").union(
        docs.where("doc_id is null").crossJoin(spark.range(20_000).select("id").alias("n")).drop("id")
    )
    answers = substrings.covered_windows(many)
    sizes = answers.select(F.size("windows").alias("n")).collect()
    assert len(sizes) == 1 and sizes[0]["n"] <= 60
    got = substrings.passage_report(many).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 1), (None, 60, 20_000)]


def test_a_passage_reaches_its_shard_a_few_times_in_any_order(spark, corpus):
    phrase = " ".join(f"p{i}" for i in range(20))
    rows = [(d, phrase, "a") for d in range(3000, 0, -1)]
    docs = corpus(rows).repartition(1).sortWithinPartitions(F.desc("doc_id"))
    marks = spark.sparkContext.broadcast(substrings._marks(docs, 13, 5, 28, 4_000))
    asked = substrings._asked(docs, marks, 13, 5, 200_000)
    assert asked.where("n > 0").groupBy("h").count().agg(F.max("count")).first()[0] <= 10
    assert [r[2] for r in sorted(substrings.passage_report(docs).collect())] == [0] + [20] * 2999


def test_odd_rows_and_texts(corpus, odd_rows):
    assert report(corpus(odd_rows)) == brute([r[:2] for r in odd_rows])
    assert report(corpus([])) == []
    rows = [(1, "a b  c d e f g h i j k l m tail", "s"), (2, "new\ta b c d e f g h i j k l m", "s"), (3, None, "s")]
    kept = substrings.drop_passages(corpus(rows))
    assert kept.columns == corpus(rows).columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: rows[0][1], 2: "new", 3: None}
