from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import subwords, tokenfiles
from shelfwise.settings import scratch_path

from .conftest import SF

TOKENIZER = Tokenizer.from_file(subwords.located(tokenfiles.BYTE_BPE))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """(doc_id, start, n, crc) of distinct ids in order, nulls first."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def by_start(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_report_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    report = tokenfiles.token_report(docs)
    assert report.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert by_start(report) == expected(rows)


def test_odd_rows(corpus, odd_rows):
    special = [(30, "a <|endoftext|> b <|endoftext|>", "a"), (31, "x   y\r\n\r\n z", "a")]
    rows = [(d, t) for d, t, _ in odd_rows + special]
    got = by_start(tokenfiles.token_report(corpus(odd_rows + special)))
    # Both rows of document 1 are alike, so the order among them does not show.
    assert got == expected(rows)


def test_equal_ids_are_ordered_by_text_and_starts_have_no_gaps(corpus):
    rows = [(7, f"text number {i}", "a") for i in range(50)] + [(7, "same", "a")] * 50
    got = by_start(tokenfiles.token_report(corpus(rows)))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array(ids_of(t), "<u4").tobytes())
    assert sorted(r[3] for r in got) == sorted(crc(t) for _, t, _ in rows)


def test_files_hold_every_document_and_short_ones_are_read_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = str(tmp_path / "tokens")
    manifest = tokenfiles.write_tokens(docs, folder, file_bytes=20_000)
    listed = sorted(manifest.collect(), key=lambda r: r["part"])
    assert len(listed) > 8 and sum(r["docs"] for r in listed) == docs.count()
    assert [r["start"] for r in listed] == np.cumsum([0, *[r["ids"] for r in listed]])[:-1].tolist()
    ends = [x for r in listed for x in (r["first_id"], r["last_id"])]
    assert ends == sorted(ends)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {r["doc_id"]: r for r in tokenfiles.read_tokens(spark, folder).collect()}
    assert {d: r["ids"] for d, r in whole.items()} == {d: ids_of(t) for d, t in texts.items()}
    wanted = [listed[0]["first_id"], listed[3]["last_id"], 10**12]
    some = {r["doc_id"]: r for r in tokenfiles.read_documents(spark, folder, wanted).collect()}
    assert some == {d: whole[d] for d in wanted[:2]}
    dictionary = (tmp_path / "tokens" / "dictionary").read_bytes()
    assert dictionary
    # A document is one frame, far smaller than its file.
    reader = tokenfiles.Reader(folder, listed[0]["file"], dictionary)
    assert reader.index["bytes"].sum() + tokenfiles.HEAD + reader.index.nbytes + tokenfiles.TAIL == listed[0]["bytes"]
    plain = sum(2 * r["n_tokens"] for r in whole.values())
    assert sum(r["bytes"] for r in listed) < plain
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.Reader(folder, listed[0]["file"], dictionary + b"x")


def test_dictionary_is_reproducible_and_bounded(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = tokenfiles.train_dictionary(docs)
    assert 0 < len(one) <= tokenfiles.DICTIONARY
    assert one == tokenfiles.train_dictionary(docs.repartition(7))
    assert tokenfiles.train_dictionary(corpus([(1, "x" * 9_000, "a"), (2, "few", "a")])) == b""


def test_wide_ids(corpus, spark):
    folder = scratch_path(spark, "wide")
    tokenfiles.write_tokens(corpus([(1, "some words", "a")]), folder, end=70_000)
    assert tokenfiles.read_tokens(spark, folder).first()["ids"] == [*ids_of("some words")[:-1], 70_000]


def test_empty_table(corpus):
    assert tokenfiles.token_report(corpus([])).count() == 0
