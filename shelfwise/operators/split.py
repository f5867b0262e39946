"""Reproducible train/test split, stratified by user."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise import settings
from shelfwise.functions.columns import HASH_RANGE, digest, digest_number
from shelfwise.operators.indexing import cutoff
from shelfwise.operators.skew import hot_counts, with_parts
from shelfwise.schemas import ITEM, USER
from shelfwise.settings import cut_lineage


def stratified_split(
    pairs: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    hot_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: per user, the ``round(n * test_size)`` lowest digests are test.

    A user's rows are ranked by md5(user|item|seed).  The rows of a user beyond
    ``hot_rows`` are cut into digest ranges that separate tasks rank; the sizes of
    the lower ranges, at most rows / hot_rows numbers per user, give the offset.
    ``counts``, if written before, holds the rows (personId, n) of the users to keep.
    """
    ranked = _ranked(pairs, seed, hot_rows, counts)
    return _assigned(ranked, pairs.columns, F.floor(F.col("_size") * F.lit(test_size) + F.lit(0.5)))


def exact_split(pairs: DataFrame, test_size: float = 0.2, seed: int = 42, hot_rows: int | None = None) -> DataFrame:
    """Add ``split`` as `stratified_split` does, with ceil(n * test_size) test rows over all users together."""
    tests = sizes_of_test(pairs, test_size, seed).withColumnRenamed("n_test", "_tests")
    ranked = _ranked(pairs, seed, hot_rows).join(tests, USER)
    return _assigned(ranked, pairs.columns, F.col("_tests"))


def sizes_of_test(pairs: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """(personId, n_test): ceil(n * test_size) test rows shared among users by largest remainder.

    A user's share is rows * total / n.  All get its whole part; the places left go to
    the largest remainders, among equal ones to the lowest md5(user|seed).  Remainders
    are whole numbers, so the last one that gets a place is found by counting.
    """
    counts = cut_lineage(pairs.groupBy(USER).agg(F.count("*").alias("n")))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = math.ceil(round(n * test_size, 9))
    # Decimals: rows of a user times all test rows may pass a bigint.
    share = f"cast(n as decimal(19,0)) * cast({total} as decimal(19,0))"
    by = f"cast({max(n, 1)} as decimal(19,0))"
    shares = cut_lineage(
        counts.select(
            USER,
            F.expr(f"cast(({share}) div {by} as bigint)").alias("whole"),
            # Smallest first: what is missing to the next whole row.
            F.expr(f"cast({by} - 1 - ({share}) % {by} as bigint)").alias("missing"),
            digest_number(digest(USER, F.lit(str(seed)))).alias("place"),
        )
    )
    left = total - (shares.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0])
    more = F.lit(False)
    if left:
        limit, ties = cutoff(shares, "missing", left, max(n, 1))
        tied = shares.where(F.col("missing") == limit)
        last, same = cutoff(tied, "place", ties, HASH_RANGE)
        # Users with one digest: as good as never more than one.
        final = [r[USER] for r in tied.where(F.col("place") == last).orderBy(USER).limit(same).collect()]
        more = (F.col("missing") < limit) | (
            (F.col("missing") == limit) & ((F.col("place") < last) | F.col(USER).isin(final))
        )
    return shares.select(USER, (F.col("whole") + more.cast("bigint")).alias("n_test"))


def _ranked(pairs: DataFrame, seed: int, hot_rows: int | None, counts: DataFrame | None = None) -> DataFrame:
    """``pairs`` with each row's ``_rank`` among its user's, and their number ``_size``.

    Users are dealt to as many tasks as their rows need; only hot ones are cut.
    """
    own = counts is None
    if own:
        counts = cut_lineage(pairs.groupBy(USER).agg(F.count("*").alias("n")))
    none = F.lit(0).cast("bigint")
    rows, most = counts.agg(F.coalesce(F.sum("n"), none), F.coalesce(F.max("n"), none)).first()
    spread = digest(USER, ITEM, F.lit(str(seed)))
    if most <= (hot_rows or settings.HOT_KEY_ROWS):
        tasks = settings.tasks_for(pairs.sparkSession, rows)
        dealt, group = pairs.repartition(tasks, USER), W.partitionBy(USER)
        if not own:
            sizes = counts.select(USER, F.col("n").alias("_size")).repartition(tasks, USER)
            dealt = dealt.join(sizes.hint("shuffle_hash"), USER)
        ranked = dealt.withColumn("_digest", spread).withColumn(
            "_rank", F.row_number().over(group.orderBy("_digest", ITEM))
        )
        return ranked.withColumn("_size", F.count("*").over(group)) if own else ranked
    hot = hot_counts(counts, hot_rows)
    if not own:
        pairs = pairs.join(counts.select(USER).hint("shuffle_hash"), USER, "left_semi")
    hashed = pairs.withColumn("_digest", spread)
    position = digest_number(F.col("_digest")) / F.lit(float(HASH_RANGE))
    ranged = with_parts(hashed, USER, hot).withColumn(
        "_range", F.least(F.floor(position * F.col("parts")), F.col("parts") - 1).cast("int")
    )
    before = W.partitionBy(USER).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.where(F.col("parts") > 1)
        .groupBy(USER, "_range")
        .count()
        .select(USER, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    group = W.partitionBy(USER, "_range")
    return (
        ranged.withColumn("_place", F.row_number().over(group.orderBy("_digest", ITEM)))
        .withColumn("_size", F.coalesce(F.col("n"), F.count("*").over(group)))
        .join(offsets, [USER, "_range"], "left")
        .withColumn("_rank", F.col("_place") + F.coalesce("_offset", F.lit(0)))
    )


def _assigned(ranked: DataFrame, columns: list[str], tests: Column) -> DataFrame:
    return ranked.select(*columns, F.when(F.col("_rank") <= tests, "test").otherwise("train").alias("split"))


def part(assigned: DataFrame, which: str) -> DataFrame:
    """The train or the test rows of a split table."""
    return assigned.where(F.col("split") == which).drop("split")
