from __future__ import annotations

import random

from shelfwise.llm import decontam
from shelfwise.llm.queries import op2_decontamination

from .conftest import SF


def brute(docs, items, width=13, substitutions=2, least=5):
    found = {}
    for d, t in docs:
        w = decontam.words_of(t)
        for i, u in items:
            v = decontam.words_of(u)
            n = min(width, len(v))
            if n < least:
                continue
            allowed = substitutions if n == width else 0
            hits = {
                p
                for p in range(len(w) - n + 1)
                for q in range(len(v) - n + 1)
                if sum(a != b for a, b in zip(w[p : p + n], v[q : q + n], strict=True)) <= allowed
            }
            if hits:
                found[d, i] = (len(hits), len({p + j for p in hits for j in range(n)}), min(hits))
    return found


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([30, 13, 14, 40, 8, 5, 3, 0])]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(120))
        item = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            if item:
                item[rng.randrange(len(item))] = "other"
        at = rng.randrange(len(words) + 1)
        text = " ".join(words[:at] + (item if d % 2 else item[: len(item) // 2]) + words[at:])
        docs.append((d, text.upper() if d % 3 else text.replace(" ", ", ")))
    return docs, items


def test_report_equals_all_windows(spark, corpus):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 10
    for block in (decontam.BLOCK, 20):
        rows = decontam.leak_report(corpus([(*r, "a") for r in docs]), bench, block=block).collect()
        got = {(r["doc_id"], r["item_id"]): (r["windows"], r["overlap_words"], r["first_word"]) for r in rows}
        assert got == expected


def test_short_items_with_one_changed_word(spark, corpus, tmp_path):
    """The query finds items of 5 to 12 words with one word changed anywhere, not with two."""
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(4, 13)]
    docs = []
    for n, text in items:
        for changed in [(k,) for k in range(n)] + [(0, n - 1)]:
            words = [f"new{k}" if k in changed else w for k, w in enumerate(text.split())]
            docs.append((100 * n + len(docs), "a b " + " ".join(words) + " c", "s"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["item_id"], r["overlap_words"]) for r in op2_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(d, n, n) for d, t, _ in docs for n in range(5, 13) if f"i{n}x" in t and t.count("new") == 1}


def test_masks_ignore_any_two_positions():
    masks = [set(m.tolist()) for m in decontam.seeds(13)]
    for a in range(13):
        for b in range(13):
            assert any(a not in m and b not in m for m in masks)


def test_leaks_go_and_clean_rows_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontam.leak_report(docs, bench).collect()}
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - leaked
    assert leaked


def test_odd_rows(spark, corpus, odd_rows):
    bench = spark.createDataFrame([(1, None), (None, "word " * 20), (None, "word " * 20), (2, "")], "item_id long, text string")
    docs = corpus(odd_rows)
    rows = decontam.leak_report(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["overlap_words"]) for r in rows] == [(5, None, 30_000)]
    assert decontam.drop_leaks(docs, bench).count() == len(odd_rows) - 1
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(odd_rows)
    assert decontam.leak_report(corpus([]), bench).count() == 0


def test_a_window_that_many_items_share(spark, corpus, monkeypatch):
    """Hits are checked a few at a time, and the benchmark comes in blocks: every item is found all the same."""
    monkeypatch.setattr(decontam, "PAIRS", 7)
    shared = [f"s{k}" for k in range(13)]
    items = [(n, " ".join([f"a{n}", *shared, f"b{n}"])) for n in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = corpus([(d, " ".join([f"d{d}", *shared, "x", *shared]), "s") for d in range(3)] + [(3, "s0 s1 s2", "s")])
    index, last = next(decontam.blocks(bench))
    words = [decontam.words_of(r["text"]) for r in docs.orderBy("doc_id").collect()]
    found = index.leaks(decontam.Hashes().of(sum(words, [])), [len(w) for w in words])
    assert last and [len(f) for f in found] == [200, 200, 200, 0]
    item = decontam.words_of(items[0][1])
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    places = [q for q in range(16) if any(near(words[0][q : q + 13], item[k : k + 13]) for k in range(3))]
    assert {tuple(sorted(own)) for f in found for own in f.values()} == {tuple(places)}
    made = list(decontam.blocks(bench, 500))
    assert len(made) == 7 and [x for _, x in made] == [False] * 6 + [True]
    assert sorted(i for index, _ in made for i in index.ids) == list(range(200))
    for block in (500, 10**6):
        rows = decontam.leak_report(docs, bench, block).collect()
        assert {(r["doc_id"], r["item_id"], r["windows"], r["overlap_words"]) for r in rows} == {
            (d, n, len(places), len({q + o for q in places for o in range(13)})) for d in range(3) for n in range(200)
        }
        assert len(rows) == 600
    assert [r["doc_id"] for r in decontam.drop_leaks(docs, bench, 500).collect()] == [3]
