"""Substring dedup: remove passages that also start in a document with a smaller id.

A window is ``width`` consecutive words.  The corpus cannot be broadcast as one
automaton, nor can each document meet an automaton of every other, so the
reference is cut into shards by content, and a document's passages go only to the
shards that can hold them:

1.  In each window the run of ``SEED`` words with the least hash is its anchor;
    equal windows have equal anchors.  Anchors that stand in two or more
    documents are marked in a bit table of fixed size (``BITS``), which every task
    gets.  Where it is full it lets more through; nothing is lost.
2.  Marked anchors go, with the words of the windows they own, to the shard of
    their hash.  There the passages of one anchor arrive in order of document:
    each is streamed through the suffix automaton of those before it, windows
    where the matching statistics reach ``width`` are covered, and a passage that
    brings something new is added.  A passage that the sending task has already
    seen whole in a smaller document is covered on the spot; the rows of a batch are
    taken in order of id, so a passage in a third of all documents reaches its shard
    a few times per batch at most, however the rows lie.  A repeated row asks once
    per task, and its copies share the answer.  An anchor that
    stands at more than ``CROWD`` places, say of a phrase shorter than a window with
    other words around each time, is split by the hash of the whole window: its
    windows go one by one, so such a shard holds one window however many come.
3.  Covered windows come back by document and the words they cover go.

Windows are judged on the input.  Defined results: a null or empty text has no
words; texts shorter than a window lose nothing; rows that share an id do not
remove each other's words, but both lose what a smaller id has; a null id counts
as larger than every id; an empty table gives no rows.  Only doc_id and text are
read; `drop_passages` passes other columns through.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.licenses import Automaton
from shelfwise.llm.tables import Batches, Hashes, as_bytes, fresh, rolled, row_key

WIDTH = 13
SEED = 5
BITS = 28
SEEN = 200_000  # passages, and rows, that one task remembers at a time
BYTES = 8  # of one word in a passage
LAST = 2**63 - 1  # order of a null id
STATES = 100_000  # states of one automaton of a shard
CROWD = 4_000  # places of an anchor whose passages meet in one shard
CHUNK = 1 << 16  # words whose anchors are found together


def anchors(hashes: np.ndarray, sizes: list[int], width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, first window, windows, document) of each run of windows with one anchor.

    The documents' ``sizes`` words follow one another in ``hashes``; windows are
    numbered along all of them, and none reaches into the next document.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    # Least key of 1, 2, 4, ... places, the first of equal ones; two of them make up a window.
    least = rolled(hashes, seed)
    place = np.arange(len(least), dtype=np.int32 if len(least) < 2**31 else np.int64)
    steps, have = width - seed + 1, 1
    while have < steps:
        by = min(have, steps - have)
        lower = least[by:] < least[:-by]
        least = np.where(lower, least[by:], least[:-by])
        place = np.where(lower, place[by:], place[:-by])
        have += by
    count = np.array(sizes, np.int64)
    inside = np.maximum(count - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), inside)
    # Windows of a document start at its first word and follow one another.
    window = np.arange(len(doc)) + np.repeat(np.cumsum(count) - count - (np.cumsum(inside) - inside), inside)
    least, place = least[window], place[window]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
    return least[first], window[first], np.diff(np.concatenate([first, [len(place)]])), doc[first]


def _chunks(texts: list[bytes], known: Hashes):
    """(number of the first text, word hashes, sizes) for about ``CHUNK`` words of whole texts at a time."""
    words: list[bytes] = []
    sizes: list[int] = []
    row = 0
    for text in texts:
        own = text.split()
        words += own
        sizes.append(len(own))
        if len(words) >= CHUNK:
            yield row, known.of(words), sizes
            row += len(sizes)
            words, sizes = [], []
    if words:
        yield row, known.of(words), sizes


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sum of each of ``counts``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in counts)


COUNTS = "h long, docs long, places long"


def _marks(docs: DataFrame, width: int, seed: int, bits: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit table of anchors that stand in two documents: 2**bits bits, whatever the corpus; and
    the sorted bits of those at more than ``crowd`` places."""

    def kernel(batches: Batches) -> Batches:
        known = Hashes()
        for batch in batches:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))]
            for _, hashes, sizes in _chunks(as_bytes(batch.column(0)), known):
                keys, _, _, doc = anchors(hashes, sizes, width, seed)
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                # Once for each document.
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                once = np.flatnonzero(new)
                parts.append((keys[once], np.ones(len(once), int), np.diff(np.append(once, len(keys)))))
            keys, n, places = _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(n), pa.array(places)], names=["h", "docs", "places"]
            )

    found = docs.select("text").mapInArrow(kernel, COUNTS).groupBy("h")
    twice = found.agg(F.sum("docs").alias("docs"), F.sum("places").alias("places")).where("docs > 1")
    mask = (1 << (bits - 6)) - 1
    words = twice.select(
        F.expr(f"shiftrightunsigned(h, 6) & {mask}L").alias("w"),
        F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"),
        (F.col("places") > crowd).alias("crowded"),
    )
    crowded = F.coalesce(F.bit_or(F.when(F.col("crowded"), F.col("b"))), F.lit(0))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b"), crowded.alias("c")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    full = rows.filter(pc.not_equal(rows.column("c"), 0))
    there, many = full.column("w").to_numpy().astype(np.uint64), full.column("c").to_numpy().view(np.uint64)
    hot = [(there << np.uint64(6) | np.uint64(i))[(many >> np.uint64(i)) & np.uint64(1) == 1] for i in range(64)]
    return table.view(np.uint64), np.sort(np.concatenate(hot))


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = (keys >> np.uint64(6)) & np.uint64(len(table) - 1)
    return (table[word] >> (keys & np.uint64(63))) & np.uint64(1) == 1


def _parted(keys: np.ndarray, first: np.ndarray, windows: np.ndarray, of: np.ndarray, many: np.ndarray, whole):
    """The runs, those of ``many`` taken apart: each of their windows under its own hash of ``whole()``."""
    if not many.any():
        return keys, first, windows, of
    times = np.where(many, windows, 1)
    run = np.repeat(np.arange(len(keys)), times)
    first = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    many = many[run]
    keys = keys[run]
    keys[many] = whole()[first[many]]
    return keys, first, np.where(many, 1, windows[run]), of[run]


ASK = "h long, doc long, k1 long, k2 long, starts binary, n int, words binary"


def _asked(docs: DataFrame, marks, width: int, seed: int, seen_limit: int) -> DataFrame:
    """Passages around marked anchors (``n`` windows from each start); those covered already have no words and n = 0."""
    k1, k2 = row_key()

    def kernel(batches: Batches) -> Batches:
        known, (table, hot) = Hashes(), marks.value
        low = np.uint64(64 * len(table) - 1)
        seen: dict[bytes, int] = {}
        rows_seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            ids = [LAST if d is None else d for d in batch.column(0).to_pylist()]
            k1, k2 = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            order = []
            for row in sorted(range(len(ids)), key=ids.__getitem__):
                if (k1[row], k2[row]) not in rows_seen:
                    if len(rows_seen) >= seen_limit:
                        rows_seen.clear()
                    rows_seen.add((k1[row], k2[row]))
                    order.append(row)
            ids, k1, k2 = ([c[row] for row in order] for c in (ids, k1, k2))
            for top, hashes, sizes in _chunks(as_bytes(batch.column(3).take(pa.array(order, pa.int64()))), known):
                keys, first, windows, of = anchors(hashes, sizes, width, seed)
                at = np.flatnonzero(_marked(table, keys))
                keys, first, windows, of = (c[at] for c in (keys, first, windows, of))
                # Which anchors are crowded is the same in every task; equal windows have equal anchors.
                many = np.isin(keys & low, hot)
                keys, first, windows, of = _parted(keys, first, windows, of, many, lambda: rolled(hashes, width))  # noqa: B023
                packed = hashes.tobytes()
                start = (np.cumsum(sizes) - sizes).tolist()
                marked = zip(*(c.tolist() for c in (of, keys.view(np.int64), first, windows)), strict=True)
                for number, runs in groupby(marked, key=itemgetter(0)):
                    row, zero = top + number, start[number]
                    doc, own, done, done_n = ids[row], {}, [], []
                    for _, h, a, w in runs:
                        passage = packed[BYTES * a : BYTES * (a + w + width - 1)]
                        name = xxhash.xxh3_128_digest(passage)
                        before = seen.get(name)
                        if before is not None and before < doc:
                            done.append(a - zero)
                            done_n.append(w)
                            continue
                        if passage in own:
                            own[passage][2].append(a - zero)
                        else:
                            own[passage] = (h, w, [a - zero])
                            if len(seen) >= seen_limit:
                                seen.clear()
                            seen[name] = doc
                    for passage, (h, w, starts) in own.items():
                        out.append((h, doc, k1[row], k2[row], np.array(starts, np.int32).tobytes(), w, passage))
                    if done:
                        out.append((k2[row], doc, k1[row], k2[row], np.array([done, done_n], np.int32).tobytes(), 0, b""))
            yield _batch(out, ASK)

    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    return rows.select(F.col("doc_id").cast("long"), "k1", "k2", "text").mapInArrow(kernel, ASK)


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


class Passages:
    """The passages of one anchor seen so far, as suffix automata of bounded size."""

    def __init__(self, width: int):
        self.width = width
        self.shards: list[Automaton] = []
        self.whole: set[bytes] = set()
        self.waiting: list[bytes] = []

    def covered(self, passage: bytes) -> np.ndarray:
        """For each window of ``passage``, whether it stands in an earlier one.

        A passage seen before needs no automaton, so passages wait to be added
        until one comes that was not.
        """
        n = len(passage) // BYTES - self.width + 1
        if passage in self.whole:
            return np.ones(n, bool)
        for earlier in self.waiting:
            if not self.shards or len(self.shards[-1].length) > STATES:
                self.shards.append(Automaton())
            self.shards[-1].add(np.frombuffer(earlier, np.uint64).tolist())
        self.waiting.clear()
        words = np.frombuffer(passage, np.uint64).tolist()
        found = np.zeros(n, bool)
        for automaton in self.shards:
            state = matched = 0
            for i, word in enumerate(words):
                state, matched = automaton.step(state, matched, word)
                if matched >= self.width:
                    found[i - self.width + 1] = True
        return found

    def add(self, passage: bytes) -> None:
        self.waiting.append(passage)
        self.whole.add(passage)


DONE = "k1 long, k2 long, windows binary"


def _answers(asked: DataFrame, width: int) -> DataFrame:
    """(k1, k2, windows): covered (start, count) pairs, from the shards and from the tasks that asked."""

    def rows_of(batches: Batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def kernel(batches: Batches) -> Batches:
        out = []
        for _, group in groupby(rows_of(batches), key=lambda r: r[0]):
            known = None
            for _, same in groupby(group, key=lambda r: r[1]):
                # Rows of one id are judged before any of them is added.
                fresh_ones = []
                for _, _, k1, k2, starts, n, passage in same:
                    if not n:
                        out.append((k1, k2, starts))
                        continue
                    if known is None:
                        fresh_ones.append(passage)
                        continue
                    hit = known.covered(passage)
                    if hit.all():
                        known.whole.add(passage)
                    else:
                        fresh_ones.append(passage)
                    if hit.any():
                        at = (np.frombuffer(starts, np.int32)[:, None] + np.flatnonzero(hit)).ravel().astype(np.int32)
                        out.append((k1, k2, np.array([at, np.ones_like(at)]).tobytes()))
                known = known or (Passages(width) if fresh_ones else None)
                for passage in fresh_ones:
                    if passage not in known.whole:
                        known.add(passage)
            if len(out) > 5000:
                yield _batch(out, DONE)
                out = []
        yield _batch(out, DONE)

    shards = asked.repartition("h").sortWithinPartitions("h", "doc")
    return shards.mapInArrow(kernel, DONE)


def covered_windows(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, bits: int = BITS, seen: int = SEEN, crowd: int = CROWD
) -> DataFrame:
    """(k1, k2, windows): for each row that loses words, lists of (starts, counts) of covered windows."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(docs, width, seed, bits, crowd))
    found = _answers(_asked(docs, marks, width, seed, seen), width)
    # Copies of a row get the same answers: each is kept once.
    return found.groupBy("k1", "k2").agg(F.collect_set("windows").alias("windows"))


def kept_words(text: bytes, windows: list[bytes] | None, width: int) -> tuple[int, list[bytes]]:
    """Words of a text, and those that no covered window covers."""
    words = text.split()
    if not windows:
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int64)
    for packed in windows:
        starts, counts = np.frombuffer(packed, np.int32).reshape(2, -1)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + counts + width - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _with_windows(docs: DataFrame, width: int, **settings) -> tuple[DataFrame, str]:
    a, b, c = (fresh(docs, n) for n in ("passage_a", "passage_b", "passage_windows"))
    found = covered_windows(docs, width, **settings).toDF(a, b, c)
    k1, k2 = row_key()
    return docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left"), c


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def passage_report(docs: DataFrame, width: int = WIDTH, **settings) -> DataFrame:
    """One row per document: words, words removed, and the digest of what is kept."""
    joined, column = _with_windows(docs.select(F.col("doc_id").cast("long"), "text"), width, **settings)

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for doc, text, windows in zip(
                batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True
            ):
                n, kept = kept_words(text, windows, width)
                out.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield _batch(out, REPORT)

    return joined.select("doc_id", "text", column).mapInArrow(kernel, REPORT)


def drop_passages(docs: DataFrame, width: int = WIDTH, **settings) -> DataFrame:
    """``docs`` with covered words removed; a text that loses words has the rest joined by spaces."""
    joined, column = _with_windows(docs, width, **settings)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, windows: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, windows, strict=True):
            changed = found is not None and len(found)
            out.append(b" ".join(kept_words(text.encode(), list(found), width)[1]).decode() if changed else text)
        return pd.Series(out, dtype=object)

    return joined.withColumn("text", rest("text", column)).select(*docs.columns)
