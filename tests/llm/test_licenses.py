from __future__ import annotations

import random
import re

from shelfwise.llm import licenses

from .conftest import SF


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (
        len(words),
        len(found),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in found})),
    )


def test_base_columns_against_a_plain_search(spark, corpus, odd_rows):
    rng = random.Random(1)
    pieces = ["under the MIT license", "Apache License, Version 2.0", "CC-BY-NC", "cc by", "under the", "É mit", "x9"]
    rows = [(i, rng.choice([" ", "\n", ". "]).join(rng.choices(pieces, k=rng.randrange(9))), "a") for i in range(300)]
    for docs in (corpus(rows + odd_rows), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted((tuple(r)[:6] for r in licenses.scan(docs).collect()), key=str)
        expected = sorted(((r["doc_id"], *base(r["text"])) for r in docs.collect()), key=str)
        assert got == expected
    assert licenses.scan(corpus([])).count() == 0


def test_templates_are_labelled_and_plain_text_is_not(corpus):
    rows = [(i, f"My project. {t.title()}. Thanks", "a") for i, t in enumerate(licenses.TEMPLATES.values())]
    words = licenses.TEMPLATES["mit"].split()
    changed = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))
    rows += [(50, changed, "a"), (51, "the software is provided to any person", "a"), (52, " ".join(words[:30]), "a")]
    got = {r["doc_id"]: r for r in licenses.scan(corpus(rows)).collect()}
    for i, name in enumerate(licenses.TEMPLATES):
        assert name in got[i]["labels"].split(",") and got[i]["score"] > 0.99
    assert got[50]["labels"] == "mit" and 0.6 < got[50]["score"] < 1
    assert got[51]["labels"] == got[52]["labels"] == ""
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_chain_takes_matches_in_order():
    scanner = licenses.Scanner({"t": "a b c d e f g h i j k l"}, {"zz yy": "z"})
    for text, share in (
        (b"a b c d e f g h i j k l", 1.0),
        (b"a b c d x i j k l", 8 / 12),
        (b"i j k l x a b c d e", 5 / 12),
        (b"a b c d a b c d", 4 / 12),
        (b"a b c", 0.0),
    ):
        assert scanner.scan(text)[-1] == share


def test_scraps_far_apart_make_no_span(corpus):
    """Six runs of four words of one notice, 2,000 words apart, are no licence; the same runs side by side are."""
    words = licenses.TEMPLATES["isc"].split()
    scraps = [" ".join(words[i : i + 4]) for i in range(0, 36, 6)]
    rows = [(1, (" filler" * 2000 + " ").join(scraps), "a"), (2, (" filler" * 20 + " ").join(scraps), "a")]
    rows += [(3, "filler " * 5000 + licenses.TEMPLATES["isc"] + " filler" * 5000 + " " + licenses.TEMPLATES["mit"], "a")]
    got = {r["doc_id"]: r for r in licenses.scan(corpus(rows)).collect()}
    assert got[1]["labels"] == "" and got[1]["score"] <= 8 / len(words)
    assert "isc" in got[2]["labels"].split(",")
    assert got[3]["labels"] == "isc,mit" and got[3]["score"] == 1


def test_spans_against_all_chains():
    """The best span found word by word equals the best over every sequence of matches that keeps order and gap."""
    rng = random.Random(3)
    template = "a b c d e f g h i j"
    scanner = licenses.Scanner({"t": template}, {"zz yy": "z"}, long=2, gap=3)
    parts = template.split()
    for _ in range(300):
        words = [rng.choice([*parts, "x"]) for _ in range(3)]
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(8)
            words += parts[i : i + rng.randrange(2, 5)] + ["x"] * rng.randrange(6)
        words = [w.encode() for w in words]
        spots = set()
        for n, _, end in scanner.matches(words)[0]:
            run = [w.decode() for w in words[end - n : end]]
            spots |= {(end - n, k, n) for k in range(len(parts) - n + 1) if parts[k : k + n] == run}

        def longest(spot, spots=spots):
            at, k, n = spot
            after = [s for s in spots if at + n <= s[0] <= at + n + 3 and s[1] >= k + n]
            return n + max(map(longest, after), default=0)

        expected = max(map(longest, spots), default=0) / len(parts)
        assert scanner.chains(words, scanner.matches(words)[0]) == [expected]
