"""Global numbering without a single-task sort, and the n smallest values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise import settings
from shelfwise.functions.columns import digest
from shelfwise.settings import cut_lineage

_CUTOFF_BUCKETS = 1 << 16


def global_rank(
    df: DataFrame,
    keys: list[Column],
    name: str = "rank",
    bucket_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Number all rows 1..n in ascending order of ``keys`` (unique together).

    Up to ``bucket_rows`` rows are numbered by one window.  Beyond that the rows
    are dealt to key ranges and written, each range is numbered by its own task
    and shifted by the sizes of the ranges before it.  The bounds come from Spark's
    sample, which moves work between tasks but never changes a rank.
    """
    bucket_rows = bucket_rows or settings.RANK_BUCKET_ROWS
    rows = df.count() if rows is None else rows
    if rows <= bucket_rows:
        return df.withColumn(name, F.row_number().over(W.orderBy(*keys)).cast("bigint"))

    ranges = df.repartitionByRange(math.ceil(rows / bucket_rows), *keys)
    ranged = cut_lineage(ranges.withColumn("_bucket", F.spark_partition_id()))
    # One row per range.
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_bucket")
        .count()
        .select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*keys))
    return (
        ranged.withColumn("_place", place)
        .join(starts, "_bucket")
        .withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_place", "_start")
    )


def hash_index(ids: DataFrame, column: str, name: str, rows: int) -> DataFrame:
    """Number distinct ids 0..n-1 in the order of their md5 digests."""
    ranked = global_rank(ids, [digest(column), F.col(column)], name, rows=rows)
    return ranked.withColumn(name, F.col(name) - 1)


def cutoff(values: DataFrame, column: str, n: int, top: int) -> tuple[int, int]:
    """``(limit, ties)``: all rows below ``limit`` plus ``ties`` rows equal to it are n rows.

    ``values[column]`` holds whole numbers in [0, top) and at least n rows.  Each
    pass counts rows in equal ranges and goes on inside the range that holds the
    n-th value, so nothing is sorted and only counts reach the driver.
    """
    low, left = 0, n
    while True:
        width = max(1, math.ceil((top - low) / _CUTOFF_BUCKETS))
        within = values.where((F.col(column) >= low) & (F.col(column) < top))
        slot = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width == 1 else F.expr(
            f"(`{column}` - {low}) div {width}"
        )
        counts = within.groupBy(slot.cast("bigint").alias("slot")).count().collect()
        for slot_no, count in sorted((row["slot"], row["count"]) for row in counts):
            if count >= left:
                low, top = low + slot_no * width, min(top, low + (slot_no + 1) * width)
                break
            left -= count
        else:
            raise ValueError(f"fewer than {n} rows to choose from")
        if width == 1:
            return low, left
