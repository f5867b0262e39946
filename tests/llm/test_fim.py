from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import fim

from .conftest import SF

ALPHABET = "aZ<>PSM \né😀"


def expected(doc_id, text):
    """The contract by slicing lists of units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=40), st.integers(0, 10**6))
def test_cut_and_restored(text, doc_id):
    cut = fim.cut_document(text.encode(), doc_id)
    n, form, prefix, middle, output = expected(doc_id, text)
    assert (cut.units, cut.form, cut.prefix_chars, cut.middle_chars) == (n, form, prefix, middle)
    assert cut.table.content().decode() == output
    assert cut.table.digest() == sha(output)
    assert fim.restored(output.encode(), form).content().decode() == text


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_units_do_not_depend_on_windows(monkeypatch, window):
    text = "ab1é c😀😀Zz..end" * 3
    starts = [len(text[: m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    monkeypatch.setattr(fim, "WINDOW", window)
    units = fim.Units(text.encode())
    assert units.n == len(starts)
    assert [units.offset(i) for i in range(units.n + 1)] == [*starts, len(text.encode())]
    assert fim.code_points(text.encode(), 0, len(text.encode())) == len(text)


def test_orders_have_inverses():
    for order in fim.ORDERS.values():
        table = fim.PieceTable(b"abcdef")
        for i in range(5):
            table.cut(i, 1)
        table.arrange(order)
        assert table.content() != b"abcdef"
        table.arrange(fim.inverse(order))
        assert table.content() == b"abcdef"


def test_report_by_brute_force(spark, corpus, odd_rows):
    special = [(7, "a <P> b", "a"), (8, "x" * 3_000_000, "a"), (9, "<" * 50 + "P>", "a"), (10, "é" * 100, None)]
    many = [(i, f"word{i} <S and P> more, text {i}!", "b") for i in range(100, 400)]
    rows = odd_rows + special + many
    got = sorted(map(tuple, fim.fim_report(corpus(rows)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        n, form, prefix, middle, output = expected(doc_id, text)
        want.append((doc_id, n, form, prefix, middle, sha(output), sha(text)))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_whole_table_and_its_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = fim.fill_in_middle(docs)
    assert cut.columns == [*docs.columns, *fim.NEW]
    back = {r["doc_id"]: r["fim_text"] for r in fim.restore(cut).collect()}
    for r in cut.collect():
        assert (r["fim_units"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_text"]) == expected(
            r["doc_id"], r["text"]
        )
        assert back[r["doc_id"]] == (r["text"] or "")


def test_clashing_names_and_empty_tables(spark, corpus):
    docs = corpus([(1, "one two three", "a")]).withColumnRenamed("size", "fim_text").withColumnRenamed("shard", "FIM_FORM")
    names = fim.new_columns(docs)
    assert names["fim_text"] == "fim_text_" and names["fim_form"] == "fim_form_"
    cut = fim.fill_in_middle(docs)
    assert cut.columns == [*docs.columns, *names.values()]
    row = fim.restore(cut, names["fim_form"], names["fim_text"]).first()
    assert row["fim_text_"] == "one two three" and row["fim_text"] == "x"
    assert fim.fim_report(corpus([])).count() == 0
