"""Hot keys: finding them and spreading them over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import settings


def hot_keys(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys with more than ``limit`` rows: (key, n, parts).

    ``parts`` is the number of pieces that brings each below the limit.  The table
    is written, so the planner knows its size and broadcasts it only while small.
    """
    return hot_counts(df.groupBy(key).agg(F.count("*").alias("n")), limit)


def hot_counts(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """`hot_keys` of a table whose rows are already counted as (key, n)."""
    limit = limit or settings.HOT_KEY_ROWS
    hot = counts.where(F.col("n") > limit)
    return settings.cut_lineage(hot.withColumn("parts", F.ceil(F.col("n") / limit).cast("int")))


def with_parts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``parts`` (1 unless the key is hot) and ``n`` (null unless hot)."""
    return df.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def salted_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join on ``key`` where ``many`` may hold very many rows of a hot key.

    Rows of ``many`` go to one of the key's parts by ``spread``; rows of ``few``
    are repeated once per part.  ``hot`` is a (key, parts) table.
    """
    spark = many.sparkSession
    parts = hot.select(key, "parts")
    left = with_parts(many, key, parts).withColumn("_salt", F.pmod(spread, F.col("parts")).cast("int"))
    right = with_parts(few, key, parts).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    # Every row of ``few`` meets many rows, so the tasks are kept apart.
    sides = [side.drop("parts").repartition(settings.wide(spark), key, "_salt") for side in (left, right)]
    return sides[0].join(sides[1], [key, "_salt"]).drop("_salt")


def unpacked(rows: DataFrame, key: str, id: str, tasks: int) -> DataFrame:
    """Rows with lists ``cells`` of structs dealt to ``tasks`` by ``key``, then one row per list entry.

    A key is cut into ``key_parts`` by the hash of the entries' ``id``; ``_slot`` is the
    part.  What is grouped by ``key``, ``_slot`` and ``id`` next needs no other shuffle.
    The lists travel as one array per field, which take less than structs do.
    """
    fields = rows.schema["cells"].dataType.elementType.names
    others = [c for c in rows.columns if c not in ("cells", "key_parts")]
    whole = rows.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("key_parts") - 1)))
    own = F.filter("cells", lambda c: F.pmod(F.xxhash64(c[id]), F.col("key_parts")) == F.col("_slot"))
    cut = whole.withColumn("cells", F.when(F.col("key_parts") > 1, own).otherwise(F.col("cells")))
    dealt = (
        cut.where(F.size("cells") > 0)
        .select(*others, "_slot", *(F.col(f"cells.{name}").alias(f"_{name}s") for name in fields))
        .repartition(tasks, key, "_slot")
    )
    listed = F.arrays_zip(*(F.col(f"_{name}s").alias(name) for name in fields))
    return dealt.select(*others, "_slot", F.inline(listed).alias(*fields))
