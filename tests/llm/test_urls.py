from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import functions as F

from shelfwise.llm import urls

from .conftest import SF


def plain(url):
    """Host, path, rule and verdict of the rules by a loop."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("#")[0].split("?")[0]
    best = None
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return host, path, *(best or (None, None))


ODD = [
    None, "", "no scheme/en/", "http://", "http://COM/", "https://com", "http://xcom/", "http://www.example.com/en/1",
    "http://a.www.EXAMPLE.com/en/?x=1#y", "http://example.com/en", "http://example.com/en/", "http://b.net/es/1?u=http://x.com/",
    "ftp://net/fr/", "http://net?/es/", "http://é.net/es/é#", "a://b://net/es/", "http://example.net/de/" + "x" * 50_000,
]


def test_rules_against_a_loop(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-i, u, "x") for i, u in enumerate(ODD, 1)], "page_id long, url string, html string")
    both = pages.union(odd).union(odd)
    sources = {r["page_id"]: r["url"] for r in both.collect()}
    rows = urls.judge(both).collect()
    assert len(rows) == both.count()
    for r in rows:
        host, path, rule, verdict = plain(sources[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_learned_verdicts_follow_the_labels(spark):
    """Paths decide under one host; the trees judge hosts that no rule fits."""
    rows = [(i, f"http://h{i % 7}.org/{'a' if i % 2 else 'b'}/{'9' * 12 if i % 2 else 'word'}{i}", "") for i in range(400)]
    rows += [(1000 + i, f"http://h{i % 7}.edu/c/{'9' * 12 if i % 2 else 'word'}{i}", "") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = (("block", "org", "/a/"), ("allow", "org", "/b/"))
    got = {r["page_id"]: r for r in urls.judge(pages, rules, sample=300).collect()}
    learned = [got[1000 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(100)]
    assert sum(learned) >= 95 and got[1000]["rule"] is None


def test_copies_do_not_change_the_verdicts(spark):
    """One labelled url repeated more often than the sample is large."""
    rules = (("block", "org", "/a/"), ("allow", "org", "/b/"))
    plain = [f"http://h{i % 7}.org/{'a' if i % 2 else 'b'}/{'9' * 12 if i % 2 else 'word'}{i}" for i in range(400)]
    plain += [f"http://h{i % 7}.edu/c/{'9' * 12 if i % 2 else 'word'}{i}" for i in range(100)]

    def verdicts(found):
        pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
        return {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, sample=300).collect()}

    before = verdicts(plain)
    assert set(before.values()) == {"allow", "block"}
    labelled = spark.createDataFrame([(u,) for u in plain[:400]], "url string")
    copied = labelled.orderBy(F.xxhash64("url", F.lit(11))).first()["url"]
    after = verdicts(plain + [copied] * 400)
    assert {i: after[i] for i in before} == before


def test_a_rare_label_is_learned(spark):
    rules = (("block", "org", "/a/"), ("allow", "org", "/b/"))
    rows = [f"http://h{i % 7}.org/b/word{i}" for i in range(3000)] + [f"http://h.org/a/{'9' * 12}{i}" for i in range(6)]
    rows += [f"http://h.edu/c/{'9' * 12}{i}" for i in range(20)] + [f"http://h.edu/c/word{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, sample=120).collect()}
    assert sum(got[i] == "block" for i in range(3006, 3026)) >= 19
    assert sum(got[i] == "allow" for i in range(3026, 3046)) >= 19


def test_one_label_or_none(spark):
    pages = spark.createDataFrame([(1, "http://x.com/a"), (2, "http://x.org/b"), (None, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()} == {1: "allow", 2: "allow", None: "allow"}
    assert urls.judge(pages.limit(0)).count() == 0
    assert urlsplit("http://x.com/a").hostname == "x.com"
