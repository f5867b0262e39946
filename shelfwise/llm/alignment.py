"""Align the tokens of two tokenizers by the bytes they cover.

A is a byte-level vocabulary, B a piece model that puts a space before a text, so
both cover space + text.  Per batch and keyed by document, `pandas.merge_asof` finds
for each token start the token of the other side that covers it; the union of both
directions is every overlapping pair.  Where both sides start a token together a
group begins, that is, where both ended one.

Documents are encoded once: their groups' digest and their distinct id pairs with
counts are written.  Pair counts are added up within tasks, then in Spark.  The
pairs that hold over 1 / ``COMMON`` of all links, so fewer than ``COMMON`` of them,
go to every task; the rest, each of them rare, are joined.

Defined results: a null or empty text has no tokens, nor has one whose tokens do not
spell space + text on both sides (one with U+2581, say): its counts are 0 and its
digest is ''; a null id is kept; repeated rows are aligned and counted each on its
own; pairs that tie for an id's highest count are all best; very long texts are
aligned piece by piece, cut where both sides end a token; an empty table gives no
rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import subwords
from shelfwise.llm.tables import Batches, as_bytes
from shelfwise.settings import cut_lineage

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
COMMON = 1 << 18
BLOCK = 1 << 20  # bytes of text that are aligned together
ROWS = 2_000  # documents in one returned batch


class Names(NamedTuple):
    """Ids as decimal text with what follows them in a group: another id, or the end of a side."""

    next_a: np.ndarray
    last_a: np.ndarray
    next_b: np.ndarray
    last_b: np.ndarray


class Aligner:
    """Both tokenizers of a task, and the chunks encoded so far."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.a = subwords.byte_level(byte_bpe, special=False, ranks=True)
        self.b = subwords.piece_model(pieces)
        self.known = subwords.Kept()
        a, b = ([str(i).encode() for i in range(x.size)] for x in (self.a, self.b))
        self.names = Names(
            *(np.array([n + end for n in names], object) for names, end in ((a, b","), (a, b"|"), (b, b","), (b, b";")))
        )

    def keys(self, text: bytes) -> list[bytes]:
        """Chunks of space + text, cut only where both sides end a token."""
        spaced = b" " + text
        if not self.b.cuts or self.a.direct(spaced):
            return [b" " + spaced]
        return subwords.keys(spaced)

    def learn(self, parts: list[list[bytes]]) -> None:
        """Encode the chunks that are new; None for those that do not come back byte for byte."""
        new = self.known.missing(parts)
        chunks = [subwords.literal(k) for k in new]
        a, b = self.a.encoded(chunks), self.b.encoded(chunks)
        same = map(all, zip(*(subwords.spelling(chunks, *x) for x in ((a, self.a), (b, self.b))), strict=True))
        self.known.add(new, [(x, y) if s else None for x, y, s in zip(a, b, same, strict=True)])


class Block(NamedTuple):
    """Aligned segments of documents: token ids, links by position, where groups begin."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray  # document of each token
    b_of: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_first: np.ndarray  # whether a token begins a group
    b_first: np.ndarray


def align(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Block:
    """Links and groups of documents whose tokens cover the same bytes on both sides.

    Offsets run on from one document to the next, so both tables are in order of
    start, as the search needs them, and the document is the key.
    """

    def table(ids: list[np.ndarray], lengths: np.ndarray, name: str) -> tuple[np.ndarray, pd.DataFrame]:
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        size = lengths[flat]
        start = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        return flat, pd.DataFrame({"doc": doc, "start": start, name: np.arange(len(flat)), f"{name}_start": start})

    a_ids, left = table(a, a_lengths, "a")
    b_ids, right = table(b, b_lengths, "b")
    # Each start of A lies in a token of B, and the other way round.
    over_a = pd.merge_asof(left, right, on="start", by="doc")
    over_b = pd.merge_asof(right, left, on="start", by="doc")
    b_at, a_at = over_a["b"].to_numpy(np.int64), over_b["a"].to_numpy(np.int64)
    a_first = (over_a["b_start"] == over_a["a_start"]).to_numpy()
    b_first = (over_b["a_start"] == over_b["b_start"]).to_numpy()
    # Pairs that start together are found both ways; the union has them once.
    more = ~b_first
    link_a = np.concatenate([np.arange(len(a_ids)), a_at[more]])
    link_b = np.concatenate([b_at, np.flatnonzero(more)])
    return Block(
        a_ids, b_ids, left["doc"].to_numpy(), right["doc"].to_numpy(), link_a, link_b, a_first, b_first
    )


def spelled(block: Block, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the groups' text in order, and the document of each: ``a1,a2|b1;a3|b2,b3;``."""

    def ends(first: np.ndarray) -> np.ndarray:
        last = np.ones(len(first), bool)
        last[:-1] = first[1:]
        return last

    a_group, b_group = np.cumsum(block.a_first) - 1, np.cumsum(block.b_first) - 1
    a_starts, b_starts = np.flatnonzero(block.a_first), np.flatnonzero(block.b_first)
    a_upto = np.append(a_starts[1:], len(block.a))  # tokens of A up to the end of each group
    a_place = np.arange(len(block.a)) + b_starts[a_group]
    b_place = np.arange(len(block.b)) + a_upto[b_group]
    out = np.empty(len(block.a) + len(block.b), object)
    out[a_place] = np.where(ends(block.a_first), names.last_a[block.a], names.next_a[block.a])
    out[b_place] = np.where(ends(block.b_first), names.last_b[block.b], names.next_b[block.b])
    of = np.empty(len(out), np.int64)
    of[a_place], of[b_place] = block.a_of, block.b_of
    return out, of


def distinct(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and how often each occurs."""
    if counts is None:
        return np.unique(pairs, return_counts=True)
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


class Document:
    """What is gathered of one document, segment by segment."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, counts = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        return distinct(pairs, counts)


def gather(aligner: Aligner, segments: list[tuple[Document, list[tuple[bytes, bytes]]]]) -> None:
    """Align segments of documents together and add what is found to each."""
    sides = [
        [np.frombuffer(b"".join([c[side] for c in chunks]), model.dtype) for _, chunks in segments]
        for side, model in ((0, aligner.a), (1, aligner.b))
    ]
    block = align(*sides, aligner.a.lengths, aligner.b.lengths)
    n = len(segments)
    words, of = spelled(block, aligner.names)
    cuts = np.searchsorted(of, np.arange(n + 1))
    groups = np.bincount(block.a_of[block.a_first], minlength=n)
    # A document's number above its pairs: one sort finds the distinct pairs of all.
    base = aligner.a.size * aligner.b.size
    pair = block.a[block.link_a].astype(np.int64) * aligner.b.size + block.b[block.link_b]
    found, counts = distinct(block.a_of[block.link_a] * base + pair)
    pair_cuts = np.searchsorted(found, np.arange(n + 1) * base)
    links = np.bincount(block.a_of[block.link_a], minlength=n)
    for i, (document, _) in enumerate(segments):
        text = b"".join(words[cuts[i] : cuts[i + 1]].tolist())
        # Groups are parted, not ended, by a semicolon.
        document.digest.update(b";" + text[:-1] if document.n_groups else text[:-1])
        document.n_a += len(sides[0][i])
        document.n_b += len(sides[1][i])
        document.n_groups += int(groups[i])
        document.n_links += int(links[i])
        own = slice(pair_cuts[i], pair_cuts[i + 1])
        document.pairs.append((found[own] - i * base, counts[own]))


ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, counts array<long>"
)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _returned(first_row: int, ids: list, documents: list[Document]) -> pa.RecordBatch:
    counted = [d.counted() for d in documents]
    numbers = [[getattr(d, n) for d in documents] for n in ("n_a", "n_b", "n_groups", "n_links")]
    columns = [
        pa.array(range(first_row, first_row + len(ids)), pa.int64()),
        pa.array(ids, pa.int64()),
        *(pa.array(n, pa.int64()) for n in numbers),
        pa.array([d.digest.hexdigest() if d.n_a else "" for d in documents], pa.string()),
        _lists([c[0] for c in counted]),
        _lists([c[1] for c in counted]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ALIGNED.split(", ")])


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block: int = BLOCK) -> DataFrame:
    """One row per document: its numbers, its groups' digest, its distinct id pairs (a * size of B + b) and their counts.

    ``row`` tells rows apart once the table is written.
    """

    def kernel(batches: Batches) -> Batches:
        aligner = _aligner(byte_bpe, pieces)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            documents: list[Document] = []
            segments, size = [], 0
            at = 0
            while at < len(texts):
                # Rows whose new chunks are encoded together.
                end, taken = at, 0
                while end < len(texts) and taken < block:
                    taken += len(texts[end])
                    end += 1
                parts = [aligner.keys(t) if t else [] for t in texts[at:end]]
                aligner.learn(parts)
                for part in parts:
                    documents.append(Document())
                    chunks = [aligner.known[k] for k in part]
                    if None in chunks:
                        continue
                    own = []
                    for key, chunk in zip(part, chunks, strict=True):
                        own.append(chunk)
                        size += len(key) + 1
                        if size >= block:
                            segments.append((documents[-1], own))
                            gather(aligner, segments)
                            segments, size, own = [], 0, []
                    if own:
                        segments.append((documents[-1], own))
                if segments:
                    gather(aligner, segments)
                    segments, size = [], 0
                at = end
                if len(documents) >= ROWS or at == len(texts):
                    first = at - len(documents)
                    yield _returned(row + first, ids[first:at], documents)
                    documents = []
            row += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, ALIGNED)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_bpe: str, pieces: str) -> Aligner:
    """The process's tokenizers, with what they have encoded in earlier tasks."""
    if (byte_bpe, pieces) not in _aligners:
        _aligners[byte_bpe, pieces] = Aligner(byte_bpe, pieces)
    return _aligners[byte_bpe, pieces]


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair in all documents; ``best`` if no other pair of its B id has more."""

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            pairs, counts = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            own, n = distinct(pairs, counts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    sums = found.select("pairs", "counts").mapInArrow(kernel, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    totals = cut_lineage(sums.withColumn("b", F.col("pair") % size_b))
    # One row for each id of B, a vocabulary.
    highest = F.broadcast(totals.groupBy("b").agg(F.max("n").alias("highest")))
    return totals.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


SUMS = "row long, pair long, n long, count_sum long, n_best long"


def _weighed(found: DataFrame, totals: DataFrame, common: int) -> DataFrame:
    """(row, count_sum, n_best) of each document."""
    links = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Fewer than ``common`` pairs can hold over 1 / common of the links.
    often = totals.where(F.col("n") > F.lit(links // common)).toArrow()
    order = np.argsort(often.column("pair").to_numpy())
    sent = found.sparkSession.sparkContext.broadcast(
        tuple(often.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))
    )

    def kernel(batches: Batches) -> Batches:
        keys, n, best = sent.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            of = np.repeat(np.arange(len(rows)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            pairs = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            counts = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            weight = np.zeros(len(pairs), np.int64)
            weight[here] = counts[here] * n[at[here]]
            top = np.zeros(len(pairs), np.int64)
            top[here] = counts[here] * best[at[here]]
            count_sum, n_best = (np.zeros(len(rows), np.int64) for _ in range(2))
            np.add.at(count_sum, of, weight)
            np.add.at(n_best, of, top)
            rare = ~here
            n_rare = int(rare.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[of[rare]]])),
                    # A row's own sums meet no pair, each under a key of its own.
                    pa.array(np.concatenate([-1 - rows, pairs[rare]])),
                    pa.array(np.concatenate([np.zeros(len(rows), np.int64), counts[rare]])),
                    pa.array(np.concatenate([count_sum, np.zeros(n_rare, np.int64)])),
                    pa.array(np.concatenate([n_best, np.zeros(n_rare, np.int64)])),
                ],
                names=[f.split()[0] for f in SUMS.split(", ")],
            )

    asked = found.select("row", "pairs", "counts").mapInArrow(kernel, SUMS)
    rare = totals.where(F.col("n") <= F.lit(links // common)).select("pair", F.col("n").alias("total"), "best")
    met = asked.join(rare, "pair", "left")
    return met.groupBy("row").agg(
        F.sum(F.col("count_sum") + F.coalesce(F.col("n") * F.col("total"), F.lit(0))).alias("count_sum"),
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
    )


def alignment_report(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, common: int = COMMON, block: int = BLOCK
) -> DataFrame:
    """One row per document: tokens, groups and links, how many links are best, and the sum of their counts."""
    found = cut_lineage(aligned(docs, byte_bpe, pieces, block))
    totals = cut_lineage(pair_counts(found, subwords.piece_model(pieces).size))
    return found.join(_weighed(found, totals, common), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
