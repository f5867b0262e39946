"""Mix sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's
target over its size.  Documents lie in order of size on a line of expected
copies, one random offset is added, and a document is emitted once per integer
boundary its stretch crosses.  Ordering by size makes the words taken follow the
target, not only the documents.

Defined results: a null text has size 0; a null source is a source of its own and
ranks last; rows that share source and doc_id are one unit of sampling and get
the same copies; a source whose size is 0 has target 0 and nothing is taken from
it; an empty table gives no rows.  Other columns pass through `mix` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.tables import fresh, word_count
from shelfwise.settings import cut_lineage

ONE = 2**32  # a copy, in fixed point


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Weights go round the sources in order.  Targets share all sizes by weight; a
    target stops at ``most`` times its source, and the excess goes to the others
    by weight.  Sources in order of cap over weight reach their caps first, so
    the common level is the largest of (rest of the total) / (rest of the weights)
    along that order.  One row per source is sorted: sources are configuration,
    each with a weight, not data.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    steps = F.array(*[F.lit(float(x)) for x in weights])
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = sums.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(steps, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    capped = weighed.withColumn("cap", F.col("source_size").cast("double") * float(most))
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    target = F.least("cap", F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _copies(units: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, copies): the prefix sum over ranges of the line.

    Units are dealt by range and written; sums per range give each range its
    start, and only a range is summed row by row in one task.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wide = units.join(targets, units.source.eqNullSafe(targets.source)).select(
        units.source, "doc_id", "size", F.floor(share * float(ONE)).cast("long").alias("step")
    )
    line = ["source", "size", "tie", "doc_id"]
    tied = wide.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    ranged = cut_lineage(tied.repartitionByRange(*line).withColumn("part", F.spark_partition_id()))
    offset = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")
    offset = F.conv(F.substring(F.md5(offset), 1, 8), 16, 10).cast("long")
    sums = ranged.groupBy("source", "part").agg((F.sum("step") % ONE).alias("step"))
    upto = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"),
        F.col("part").alias("p"),
        ((F.coalesce(F.sum("step").over(upto), F.lit(0)) + offset) % ONE).alias("start"),
    )
    placed = ranged.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    inside = W.partitionBy("part", "source").orderBy("size", "tie", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("step").over(inside) + F.col("start")
    return placed.withColumn("end", end).select(
        "source",
        "doc_id",
        (F.floor(F.col("end") / F.lit(ONE)) - F.floor((F.col("end") - F.col("step")) / F.lit(ONE))).alias("copies"),
    )


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes (doc_id, source, size) by row, targets by source, copies by (source, doc_id)."""
    sizes = cut_lineage(docs.select("doc_id", "source", word_count().alias("size")))
    units = sizes.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    targets = cut_lineage(source_targets(sizes, weights, most))
    return sizes, targets, _copies(units, targets, seed)


def _looked_up(rows: DataFrame, found: DataFrame, columns: list) -> DataFrame:
    found = found.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), "copies")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return rows.join(found, same).select(*columns)


def mix_report(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3, seed: int = 42) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    sizes, targets, copies = plan_mix(docs, weights, most, seed)
    taken = _looked_up(sizes, copies, ["doc_id", "source", "size", (F.col("copies") * F.col("size")).alias("taken")])
    targets = targets.withColumnRenamed("source", "s")
    return taken.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with its own columns."""
    _, _, copies = plan_mix(docs, weights, most, seed)
    names = {n: fresh(docs, n) for n in ("mix_s", "mix_d", "mix_copies")}
    found = copies.where("copies > 0").toDF(*names.values())
    s, d, n = (F.col(x) for x in names.values())
    same = docs["source"].eqNullSafe(s) & docs["doc_id"].eqNullSafe(d)
    rows = docs.join(found, same).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias(names["mix_s"]))
    return rows.select(*docs.columns)
