"""Near duplicates of embeddings by product quantisation.

Vectors are scaled to length 1 and equal ones of a label become one, with a count.
Coarse centres cut each label into inverted lists; what is left of a vector after
its centre is cut into subspaces, each coded by its nearest codeword.  A query
probes lists, sums table look-ups of squared distances to the codes, and checks
what passes by exact cosine in double precision.

Nothing near is missed.  Let r be the distance that the cosine allows, u a vector
whose centre is a, and v one whose centre is b.  Across the plane midway between a
and b, u lies on one side and v on the other; if they are within r, one of them is
within r / 2 of the plane.  So a vector probes the centres whose plane is at most
r / 2 away: of 256 centres some ten on the given table, where comparing distances to
the centres would let 200 through.  The distance from a query to a code differs from
the distance to the vector by at most the coding error, which is stored, so the
look-ups pass whatever lies within r plus that error.  Centres and codewords, fitted on a bounded sample
(``SAMPLE`` vectors), only decide how much work this is; there are as many centres as
the root of the number of vectors, at most ``CENTRES``.

A pair is found where its smaller name probes, and where only the larger one does,
there.  So links are added up where they are found, and what leaves a task is a count
per vector and a tree per group of linked vectors, not the pairs.

Defined results: null, empty and zero vectors and those that hold null or
non-finite components link with nothing, like vectors with a null label; vectors
of other lengths link only among their own length; repeated rows link with each
other; a null id never names a component (one of null ids only has none); an empty
table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.tables import Batches
from shelfwise.settings import cut_lineage

SAMPLE = 8192
CENTRES = 1024
SUBSPACES = 8
CODEWORDS = 64
ROWS = 1024  # vectors of one packed block


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)[0]
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, centres)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


@dataclass
class Quantiser:
    """Coarse centres, and the codewords of each subspace of what they leave."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, centres: int, subspaces: int, codewords: int, seed: int) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = _kmeans(x, centres, rng)
        rest = x - coarse[_nearest(x, coarse)[0]]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return cls(coarse, [_kmeans(rest[:, c], codewords, rng) for c in cuts], cuts)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List of each vector, its codes, and the distance from it to what they stand for."""
        home = _nearest(x, self.centres)[0]
        rest = x - self.centres[home]
        found = [_nearest(rest[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)]
        error = np.sqrt(sum(d for _, d in found))
        return home, np.stack([b for b, _ in found], axis=1).astype(np.uint8), error

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector must visit: those it is within half the reach of."""
        d = _distances(x, self.centres)
        home = d.argmin(axis=1)
        apart = np.sqrt(_distances(self.centres, self.centres))[home]
        return d - d[np.arange(len(x)), home][:, None] <= reach * apart + 1e-6

    def passing(self, query: np.ndarray, home: int, codes: np.ndarray, error: np.ndarray, reach: float) -> np.ndarray:
        """Pairs (query, coded vector) whose table-lookup distance lets them be within reach."""
        rest = query - self.centres[home]
        total = np.zeros((len(query), len(codes)), np.float32)
        for i, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            total += _distances(rest[:, c], w).astype(np.float32)[:, codes[:, i]]
        return total <= ((reach + error + 1e-3) ** 2).astype(np.float32)[None]


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): usable vectors, scaled to length 1 in double precision."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", x.alias("x")).where(
        F.col("label").isNotNull() & (F.size("x") > 0) & finite
    )
    # The largest component first, so that squares neither overflow nor vanish.
    rows = rows.withColumn("top", F.array_max(F.transform("x", F.abs))).where("top > 0")
    rows = rows.withColumn("x", F.transform("x", lambda v: v / F.col("top")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.select("vec_id", "label", F.transform("x", lambda v: v / norm).alias("unit"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def fit(units: DataFrame, size: int, sample: int, centres: int, subspaces: int, codewords: int, seed: int) -> Quantiser:
    """Quantiser from at most ``sample`` vectors of one length, by hash order."""
    taken = units.where(F.size("unit") == size).orderBy(F.xxhash64("label", "unit", F.lit(seed)), "rep").limit(sample)
    x = np.array([r["unit"] for r in taken.select("unit").collect()])
    return Quantiser.fit(x, centres, subspaces, codewords, seed)


def _joined(i: np.ndarray, j: np.ndarray, left: int, right: int) -> np.ndarray:
    """Least node that each of ``left`` + ``right`` nodes reaches by the edges (i, left + j)."""
    least = np.arange(left + right)
    while True:
        low = np.minimum(least[i], least[left + j])
        now = least.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, left + j, low)
        now = now[now]
        if (now == least).all():
            return least
        least = now


FOUND = "rep long, other long, links long"


def _links(units: DataFrame, quantiser: Quantiser, cosine: float, rows: int) -> DataFrame:
    """Links between vectors of equal label at ``cosine`` or more, as ``FOUND``.

    Rows without ``other`` add up to the links of ``rep``, copies counted; the others
    say that the two reach each other.
    """
    spark = units.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)
    reach = math.sqrt(max(2 - 2 * cosine, 0.0))

    def place(batches: Batches) -> Batches:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            home, codes, error = q.code(x)
            visits = [pa.array(np.flatnonzero(v).astype(np.int32)) for v in q.probes(x, reach)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                    pa.array(visits, pa.list_(pa.int32())),
                ],
                names=["rep", "label", "unit", "n", "home", "codes", "error", "visits"],
            )

    schema = "rep long, label string, unit array<double>, n long, home int, codes binary, error double, visits array<int>"
    placed = cut_lineage(units.select("rep", F.col("label").cast("string"), "unit", "n").mapInArrow(place, schema))
    # Lists in blocks of about ``rows``: a list with many vectors is many blocks.
    sizes = placed.groupBy("label", "home").agg((F.floor(F.count("*") / rows) + 1).cast("int").alias("blocks"))
    lists = (
        placed.join(sizes, ["label", "home"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .groupBy("label", "home", "block")
        .agg(F.collect_list(F.struct("rep", "unit", "n", "codes", "error", "visits")).alias("list"))
    )
    visitors = placed.select("label", "rep", "unit", "n", F.col("home").alias("own"), F.explode("visits").alias("home"))
    asks = visitors.join(sizes.withColumnRenamed("blocks", "parts"), ["label", "home"])
    asked = visitors.groupBy("label", "home").agg((F.floor(F.count("*") / rows) + 1).cast("int").alias("chunks"))
    asks = (
        asks.join(asked, ["label", "home"])
        .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int"))
        .groupBy("label", "home", "chunk")
        .agg(F.collect_list(F.struct("rep", "unit", "n", "own")).alias("asks"))
    )
    pairs = asks.join(lists, ["label", "home"]).select("home", "asks", "list")

    def search(batches: Batches) -> Batches:
        q = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                home = batch.column(0)[row].as_py()
                asks, known = batch.column(1)[row].values, batch.column(2)[row].values
                x, y = _matrix(asks.field("unit")), _matrix(known.field("unit"))
                u, v = np.array(asks.field("rep")), np.array(known.field("rep"))
                codes = np.frombuffer(b"".join(known.field("codes").to_pylist()), np.uint8).reshape(len(y), -1)
                i, j = np.nonzero(q.passing(x, home, codes, np.array(known.field("error")), reach))
                # Of two vectors that visit each other's lists the one with the smaller name counts.
                visits = known.field("visits")
                back = np.zeros((len(y), len(q.centres)), bool)
                back[np.repeat(np.arange(len(y)), np.array(visits.value_lengths())), np.array(visits.flatten())] = True
                mine = (u[i] != v[j]) & ((u[i] < v[j]) | ~back[j, np.array(asks.field("own"))[i]])
                i, j = i[mine], j[mine]
                near = [
                    np.einsum("ij,ij->i", x[i[a : a + (1 << 16)]], y[j[a : a + (1 << 16)]]) >= cosine
                    for a in range(0, len(i), 1 << 16)
                ]
                if not near:
                    continue
                near = np.concatenate(near)
                i, j = i[near], j[near]
                links = np.zeros(len(u) + len(v), np.int64)
                np.add.at(links, i, np.array(known.field("n"))[j])
                np.add.at(links, len(u) + j, np.array(asks.field("n"))[i])
                names, least = np.concatenate([u, v]), _joined(i, j, len(u), len(v))
                some, tree = np.flatnonzero(links), np.flatnonzero(least != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([names[some], names[tree]])),
                        pa.array(np.concatenate([names[some], names[least[tree]]]), mask=np.arange(len(some) + len(tree)) < len(some)),
                        pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)])),
                    ],
                    names=["rep", "other", "links"],
                )

    return pairs.mapInArrow(search, FOUND)


def link_report(
    vectors: DataFrame,
    cosine: float = 0.93,
    sample: int = SAMPLE,
    centres: int = CENTRES,
    subspaces: int = SUBSPACES,
    codewords: int = CODEWORDS,
    rows: int = ROWS,
    seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    usable = cut_lineage(clean(vectors))
    # One representative for equal vectors of a label, named when its row is written.
    units = usable.groupBy("label", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    units = cut_lineage(units.withColumn("rep", F.monotonically_increasing_id()))
    found = None
    for size, n in sorted(map(tuple, units.groupBy(F.size("unit")).count().collect())):
        own = units.where(F.size("unit") == size)
        quantiser = fit(units, size, sample, min(centres, math.isqrt(n) + 1), subspaces, codewords, seed)
        part = _links(own, quantiser, cosine, rows)
        found = part if found is None else found.union(part)
    ids = vectors.select(F.col("vec_id").cast("long"))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found)
    linked = found.where("other is null").groupBy(F.col("rep").alias("u")).agg(F.sum("links").alias("others"))
    roots = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    named = (
        units.join(linked, F.col("rep") == F.col("u"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "unit",
            "least",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("root"),
        )
    )
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root")
    found = usable.join(named.select("label", "unit", "n_links", "component"), ["label", "unit"])
    # Vectors that cannot link are components of their own.
    usable_ids = found.select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = _unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = usable_ids.union(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _unusable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("label").isNotNull() & (F.size(x) > 0) & finite & (F.array_max(F.transform(x, F.abs)) > 0)
    return vectors.where(~F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"))
