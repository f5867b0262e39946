from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import alignment, subwords

from .conftest import SF

A = Tokenizer.from_file(subwords.located(alignment.BYTE_BPE))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=subwords.located(alignment.PIECES))
CHARS = st.sampled_from([*"ab, .\n\t\r'!1é<>|", "  ", "\n\n", " ", "▁", "\x1c", "　", "漢", "😀", "<|endoftext|>", "</s>", "<0x41>", "the ", "ing "])
TEXTS = st.lists(CHARS, max_size=25).map("".join)


ALPHABET = subwords.byte_alphabet()


@cache
def spelled_a(i):
    return bytes(ALPHABET[c] for c in A.id_to_token(i))


@cache
def spelled_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def brute_document(text):
    """(a ids, b ids, groups, links) of one text by walking over its bytes."""
    nothing = [], [], [], []
    if not text:
        return nothing
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(map(spelled_a, a)) != want or b"".join(map(spelled_b, b)) != want:
        return nothing
    a_of = [i for i, x in enumerate(a) for _ in spelled_a(x)]
    b_of = [i for i, x in enumerate(b) for _ in spelled_b(x)]
    links = sorted(set(zip(a_of, b_of)))
    groups, a_ids, b_ids = [], [], []
    for at in range(len(want)):
        last = at + 1 == len(want)
        a_end, b_end = last or a_of[at + 1] != a_of[at], last or b_of[at + 1] != b_of[at]
        a_ids += [a[a_of[at]]] * a_end
        b_ids += [b[b_of[at]]] * b_end
        if a_end and b_end:
            groups.append((a_ids, b_ids))
            a_ids, b_ids = [], []
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def brute(rows):
    found = [(d, *brute_document(t)) for d, t in rows]
    counts = Counter(x for *_, links in found for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for d, a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((d, len(a), len(b), len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.booleans())
def test_chunks_give_the_ids_of_whole_texts(texts, ranks):
    model = subwords.ByteLevel.__new__(subwords.ByteLevel)
    model.__dict__.update(subwords.byte_level(alignment.BYTE_BPE, False, ranks).__dict__, table=subwords.Table())
    assert (model.ranked is not None) == ranks
    got = [np.frombuffer(x, model.dtype).tolist() for x in model.ids([t.encode() for t in texts])]
    assert got == [A.encode(t, add_special_tokens=False).ids for t in texts]
    for t in texts:
        assert b"".join(map(subwords.literal, subwords.keys(t.encode()))) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.sampled_from([8, 1 << 20]))
def test_documents_by_walking_bytes(texts, block):
    aligner = alignment._aligner(alignment.BYTE_BPE, alignment.PIECES)
    parts = [aligner.keys(t.encode()) if t else [] for t in texts]
    aligner.learn(parts)
    for text, part in zip(texts, parts):
        a, b, groups, links = brute_document(text)
        chunks = [aligner.known[k] for k in part]
        if None in chunks or not text:
            assert not a
            continue
        document = alignment.Document()
        step = 1 if block == 8 else len(chunks)
        for i in range(0, len(chunks), step):
            alignment.gather(aligner, [(document, chunks[i : i + step])])
        assert (document.n_a, document.n_b, document.n_groups, document.n_links) == (len(a), len(b), len(groups), len(links))
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert document.digest.hexdigest() == hashlib.sha256(text.encode()).hexdigest()
        pairs, counts = document.counted()
        own = Counter(x * aligner.b.size + y for x, y in links)
        assert dict(zip(pairs.tolist(), counts.tolist())) == own


@pytest.mark.parametrize("common", [1, 50, 1 << 18])
def test_report_by_brute_force(spark, corpus, odd_rows, common):
    more = [(20, "a▁b", "a"), (21, "tie tie", "a"), (22, "<|endoftext|> and </s>", "a"), (23, "x   y", "a")]
    rows = odd_rows + more + [(i, f"the common words, line {i % 7}\nand  more of it", "b") for i in range(30, 90)]
    got = alignment.alignment_report(corpus(rows), common=common, block=500)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(d, t) for d, t, _ in rows])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.alignment_report(docs).collect()), key=repr) == brute(rows)


def test_empty_table(corpus):
    assert alignment.alignment_report(corpus([])).count() == 0
    assert alignment.alignment_report(corpus([(1, None, "a"), (2, "", "a")])).count() == 2
