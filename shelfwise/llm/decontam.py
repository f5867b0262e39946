"""Benchmark decontamination by spaced seeds.

A window of 13 words of a document leaks a benchmark item if it stands in the
item but for at most two substituted words.  The 13 positions are cut into four
groups; each mask ignores two of them, so any two substitutions are ignored by
some mask, and the hash of the positions left is the same on both sides.  The
hashes of all masks at all places of the benchmark are joined with those of the
documents, and each hit is checked word by word.

The benchmark is the query set.  It is taken in blocks of about ``BLOCK`` words; each
is read on its own, sent to all tasks, meets every document and is dropped before the
next is made, so the driver holds one block whatever the benchmark, no document is
shuffled and no popular passage lands in one task.  A seed that many items share is
checked with all of them at once, ``PAIRS`` at a time.

Words are runs of letters and digits, lower-cased.  Items with fewer words than
the window must stand in the document whole, but for at most ``short`` substituted
words (none by default; the queries allow one), found by masks of their own; items
with fewer than ``least`` words are no evidence.  Defined results: null and empty texts hold
nothing, on either side; repeated items are reported once, repeated documents
once each; null ids are reported as null; empty tables leave everything clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import Batches, Hashes, fresh
from shelfwise.settings import cut_lineage, scratch_path

WORDS = re.compile(r"[^\W_]+")
BLOCK = 2_000_000
CHUNK = 1 << 16  # words of documents that are looked up together
PAIRS = 1 << 20  # hits of seeds that are checked together


def kept_groups(width: int, substitutions: int = 2) -> list[list[np.ndarray]]:
    """The groups of positions that each mask keeps."""
    groups = np.array_split(np.arange(width), substitutions + 2)
    ignored = combinations(range(len(groups)), substitutions)
    return [[g for i, g in enumerate(groups) if i not in away] for away in ignored]


def seeds(width: int, substitutions: int = 2) -> list[np.ndarray]:
    """Positions that each mask keeps; some mask ignores any ``substitutions`` positions."""
    return [np.concatenate(groups) for groups in kept_groups(width, substitutions)]


def _mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash of the values that stand at the same place of the columns."""
    out = np.full(len(columns[0]), salt + 1, np.uint64)
    for column in columns:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out += column
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class SeedIndex:
    """Sorted hashes of a block of the benchmark, with the item and place of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, substitutions: int, least: int, short: int = 0):
        self.ids = [i for i, _ in items]
        self.width, self.substitutions, self.short = width, substitutions, short
        hashes = Hashes()
        self.words = [hashes.of(words_of(t)) for _, t in items]
        longest = [min(len(w), width) for w in self.words]
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.base = np.cumsum([0, *map(len, self.words)])
        # One family of masks for whole windows, one for each shorter length.
        self.families = [(width, groups, s) for s, groups in enumerate(kept_groups(width, substitutions))]
        for n in sorted({x for x in longest if least <= x < width}):
            masks = kept_groups(n, short) if 0 < short <= n - 2 else [[np.arange(n)]]
            self.families += [(n, groups, 100 + n + 1000 * s) for s, groups in enumerate(masks)]
        own = {n: [i for i, x in enumerate(longest) if x == n] for n, _, _ in self.families}
        places = {n: [len(self.words[i]) - n + 1 for i in own[n]] for n in own}
        every = {n: [self._keys(self.words[i]) for i in own[n]] for n in own}
        self.tables = []
        for f, (n, _, _) in enumerate(self.families):
            keys = np.concatenate([np.zeros(0, np.uint64), *(k[f] for k in every[n])])
            order = np.argsort(keys, kind="stable")
            item = np.repeat(np.array(own[n], int), places[n])[order]
            at = np.concatenate([np.zeros(0, int), *map(np.arange, places[n])])[order]
            keys = keys[order]
            # A first look at 20 bits of the hash spares most of the binary searches.
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.tables.append((keys, item, at, bits))

    def _keys(self, words: np.ndarray) -> list[np.ndarray]:
        """For each family, the hash at each window; a group that masks share is hashed once."""
        known: dict[tuple, np.ndarray] = {}
        out = []
        for width, groups, salt in self.families:
            n = max(len(words) - width + 1, 0)
            parts = []
            for group in groups:
                name = (width, int(group[0]))
                if name not in known:
                    known[name] = _mixed([words[p : p + n] for p in group], 0)
                parts.append(known[name])
            out.append(_mixed(parts, salt))
        return out

    def leaks(self, words: np.ndarray, sizes: list[int]) -> list[dict[int, set[int]]]:
        """For each of the documents whose ``sizes`` words follow one another: item number ->
        first words of the document's windows that stand in it."""
        ends = np.cumsum(np.array(sizes, np.int64))
        starts = ends - sizes
        hits = []
        for (n, _, _), own, (keys, item, at, bits) in zip(self.families, self._keys(words), self.tables, strict=True):
            maybe = np.flatnonzero(bits[own >> np.uint64(44)])
            doc = np.searchsorted(ends, maybe, "right")
            inside = maybe + n <= ends[doc]
            maybe, doc = maybe[inside], doc[inside]
            low = np.searchsorted(keys, own[maybe], "left")
            many = np.searchsorted(keys, own[maybe], "right") - low
            allowed = self.substitutions if n == self.width else self.short
            upto = np.cumsum(many)
            for first in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(upto[-1])))
                of = np.searchsorted(upto, pair, "right")
                k = low[of] + pair - (upto[of] - many[of])
                p, q = maybe[of], self.base[item[k]] + at[k]
                differ = np.zeros(len(pair), np.int64)
                for o in range(n):
                    differ += words[p + o] != self.flat[q + o]
                near = differ <= allowed
                hits.append(np.stack([doc[of], item[k], p - starts[doc[of]]])[:, near])
                if sum(h.shape[1] for h in hits) > 4 * PAIRS:
                    hits = [np.unique(np.concatenate(hits, axis=1), axis=1)]
        found: list[dict[int, set[int]]] = [{} for _ in sizes]
        if hits:
            for d, i, q in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
                found[d].setdefault(i, set()).add(q)
        return found

    def leaks_of(self, texts: Iterable[str | None], hashes: Hashes) -> Iterator[dict[int, set[int]]]:
        """Leaks of each text in turn, looked up for about ``CHUNK`` words at a time."""
        words: list[str] = []
        sizes: list[int] = []
        for text in texts:
            own = words_of(text)
            words += own
            sizes.append(len(own))
            if len(words) >= CHUNK:
                yield from self.leaks(hashes.of(words), sizes)
                words, sizes = [], []
        if sizes:
            yield from self.leaks(hashes.of(words), sizes)

    def span(self, item: int) -> int:
        return min(len(self.words[item]), self.width)


def blocks(benchmark: DataFrame, block: int = BLOCK, **settings) -> Iterator[tuple[SeedIndex, bool]]:
    """The benchmark's indexes, each over about ``block`` words, one after the other; and whether it is the last."""
    settings = {"width": 13, "substitutions": 2, "least": 5} | settings
    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = words // block + 1
    if n > 1:
        # A folder for each block, so that a block reads no other.
        path = scratch_path(benchmark.sparkSession, "blocks")
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part")
        items.select("*", part).repartition("part").write.partitionBy("part").parquet(path)
        items = benchmark.sparkSession.read.schema("item_id long, text string, part long").parquet(path)
    for i in range(n):
        own = items.where(F.col("part") == i) if n > 1 else items
        yield SeedIndex([tuple(r) for r in own.select("item_id", "text").collect()], **settings), i == n - 1


def leak_report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, **settings) -> DataFrame:
    """(doc_id, item_id, windows, overlap_words, first_word) for each document and item it leaks."""
    out = None
    schema = "doc_id long, item_id long, windows long, overlap_words long, first_word long"
    spark = docs.sparkSession
    for index, last in blocks(benchmark, block, **settings):
        shared = spark.sparkContext.broadcast(index)
        del index

        def kernel(batches: Batches, shared=shared) -> Batches:
            index, hashes = shared.value, Hashes()
            for batch in batches:
                rows = []
                found = index.leaks_of(batch.column(1).to_pylist(), hashes)
                for doc, leaks in zip(batch.column(0).to_pylist(), found, strict=True):
                    for i, places in leaks.items():
                        span = index.span(i)
                        covered = {p + j for p in places for j in range(span)}
                        rows.append((doc, index.ids[i], len(places), len(covered), min(places)))
                columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema)
        if not last:
            part = cut_lineage(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in shared.value.leaks_of(texts, Hashes())], dtype=bool)

    return leaks


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, **settings) -> DataFrame:
    """``docs`` without the rows that leak any item; nothing is shuffled."""
    name = fresh(docs, "leaks")
    for index, last in blocks(benchmark, block, **settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index
        docs = docs.withColumn(name, _leaks(shared)("text")).where(~F.col(name)).drop(name)
        if not last:
            docs = cut_lineage(docs)
            shared.destroy()
    return docs
