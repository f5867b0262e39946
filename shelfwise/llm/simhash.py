"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of 64 bits is cut into four blocks of 16.  Two fingerprints with at
most two differing bits agree in at least two blocks, so both lie in the bucket
of one pair of blocks; inside a bucket the Hamming distance is checked.  Equal
fingerprints are one before that, so copies cost nothing.  A bucket with more
than ``BUCKET`` different fingerprints is cut again the same way: its 32 free bits
make four blocks of 8, two of which must agree too.  Then 48 bits are fixed, and
2**16 different fingerprints are the most that a bucket can ever hold.  Buckets
give spanning links, not all their pairs.

Defined results: a null or empty text has fingerprint 0 and links like any other;
fewer words than a shingle make one shingle of all of them; repeated rows share
fingerprint and component; a null id is never a component's smallest id (a
component of null ids only has a null component_id); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.tables import Batches, as_bytes, fresh, row_key
from shelfwise.settings import cut_lineage

BUCKET = 1024
FLUSH = 1 << 16
# Byte i of entry b is bit i of b: adding entries counts eight bits at once.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose ``sizes`` shingle hashes follow one another."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Runs of at most 255 hashes of one document, so that a byte can count them.
    runs = (sizes + 254) // 255
    of = np.repeat(np.arange(len(sizes)), runs)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = first[of] + nth * 255
    out = np.zeros(len(sizes), np.uint64)
    for byte in range(8):
        counted = np.add.reduceat(SPREAD[(hashes >> np.uint64(8 * byte)) & np.uint64(255)], at)
        eight = np.ascontiguousarray(counted).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(eight, np.cumsum(runs) - runs, axis=0)
        bits = (sums * 2 > sizes[:, None]) << np.arange(8)
        out |= bits.sum(axis=1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def _shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, k1, k2, fingerprint long) for each row; k1, k2 are the row's key."""
    k1, k2 = row_key()
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            hashes: list[int] = []
            sizes: list[int] = []
            rows_of: list[int] = []
            for i, text in enumerate(as_bytes(batch.column(3))):
                own = _shingle_hashes(text, shingle)
                if own:
                    hashes += own
                    sizes.append(len(own))
                    rows_of.append(i)
                if len(hashes) >= FLUSH:
                    found[rows_of] = _majority(np.array(hashes, np.uint64), np.array(sizes))
                    hashes, sizes, rows_of = [], [], []
            if hashes:
                found[rows_of] = _majority(np.array(hashes, np.uint64), np.array(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(found.view(np.int64))],
                names=["doc_id", "k1", "k2", "fingerprint"],
            )

    return rows.mapInArrow(kernel, "doc_id long, k1 long, k2 long, fingerprint long")


def _masks(free: list[int], fixed: int) -> list[int]:
    """``free`` is four lists of bits as masks; each result adds two of them to ``fixed``."""
    return [fixed | a | b for a, b in combinations(free, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[tuple[int, list[int]]]:
    """For each pair of 16-bit blocks: its mask, and the masks of its finer buckets."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    out = []
    for a, b in combinations(range(4), 2):
        fixed = blocks[a] | blocks[b]
        rest = [16 * i for i in range(4) if i not in (a, b)]
        bytes_ = [0xFF << s for start in rest for s in (start, start + 8)]
        out.append((fixed, _masks(bytes_, fixed)))
    return out


def _spanning(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket: each value to the smallest one it reaches inside the bucket."""
    n = len(values)
    left, right = [], []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        near = np.bitwise_count(values[a : a + step, None] ^ values[None, a:]) <= distance
        i, j = np.nonzero(near)
        keep = i < j
        left.append(i[keep] + a)
        right.append(j[keep] + a)
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.nonzero(label != np.arange(n))[0]
    return values[moved], values[label[moved]]


def close_links(distinct: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that join all fingerprints within ``distance`` bits (up to 2)."""
    if not 0 <= distance <= 2:
        raise ValueError("four blocks find distances up to 2")
    pairs = block_masks()
    value = F.col("fingerprint")
    coarse = F.array(
        *[F.struct(F.lit(i).alias("m"), value.bitwiseAND(F.lit(_signed(f))).alias("b")) for i, (f, _) in enumerate(pairs)]
    )
    keyed = distinct.select("fingerprint", F.explode(coarse).alias("key")).select("fingerprint", "key.m", "key.b")
    sizes = keyed.groupBy("m", "b").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["m", "b"]))
    fine = F.array(
        *[
            F.array(
                *[
                    F.struct(F.lit(6 + 6 * i + j).alias("m"), value.bitwiseAND(F.lit(_signed(f))).alias("b"))
                    for j, f in enumerate(finer)
                ]
            )
            for i, (_, finer) in enumerate(pairs)
        ]
    )
    crowded = shared.where(F.col("n") > bucket).select(
        "fingerprint", F.explode(F.element_at(fine, F.col("m") + 1)).alias("key")
    )
    rows = shared.where(F.col("n") <= bucket).select("fingerprint", "m", "b")
    rows = rows.union(crowded.select("fingerprint", "key.m", "key.b"))
    buckets = rows.groupBy("m", "b").agg(F.collect_list("fingerprint").alias("values")).where(F.size("values") > 1)

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            u, v = [], []
            for values in batch.column(0):
                a, b = _spanning(np.sort(np.array(values.values).view(np.uint64)), distance)
                u.append(a)
                v.append(b)
            if u:
                arrays = [pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (u, v)]
                yield pa.RecordBatch.from_arrays(arrays, names=["u", "v"])

    return buckets.select("values").mapInArrow(kernel, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, k1, k2, fingerprint, component_id): one row per document."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(close_links(distinct, distance, bucket))
    placed = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id", "root")
    return prints.join(named, "fingerprint")


def simhash_report(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return near_groups(docs, shingle, distance).select("doc_id", text.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest text hash.

    Of rows alike in id and text one stays.
    """
    groups = near_groups(docs, shingle, distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "k1", "k2")).alias("first")
    kept = groups.groupBy("root").agg(first).select("first.k1", "first.k2")
    a, b = fresh(docs, "near_a"), fresh(docs, "near_b")
    k1, k2 = row_key()
    keyed = docs.withColumns({a: k1, b: k2}).join(kept.toDF(a, b), [a, b], "left_semi")
    return keyed.dropDuplicates([a, b]).select(*docs.columns)
