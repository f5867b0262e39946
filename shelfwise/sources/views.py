"""The six input files as views over the order tables (see ``FIXTURES.md``).

A side file lacks the items or users whose own values put them outside it, so the
outer joins meet keys that only some files know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import settings


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _triplet(df: DataFrame, row, col, data) -> DataFrame:
    return df.select(
        row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), data.cast("double").alias("data")
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    # The numbers of rows are in the files' footers.
    tasks = settings.tasks_for(spark, max(orders.count(), lines.count()))
    if tasks > spark.sparkContext.defaultParallelism:
        orders, lines = orders.repartition(tasks, "o_orderkey"), lines.repartition(tasks, "l_orderkey")
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return _triplet(bought, F.col("o_custkey"), F.col("l_partkey"), F.col("l_quantity"))


def item_asset(spark: SparkSession, folder: str) -> DataFrame:
    part = _table(spark, folder, "part").where(F.col("p_size") > 5)
    return _triplet(part, F.col("p_partkey"), F.lit(0), F.col("p_size"))


def item_price(spark: SparkSession, folder: str) -> DataFrame:
    part = _table(spark, folder, "part").where(F.col("p_retailprice") >= 950)
    return _triplet(part, F.col("p_partkey"), F.lit(0), F.col("p_retailprice") / 1000)


def item_subclass(spark: SparkSession, folder: str) -> DataFrame:
    part = _table(spark, folder, "part")
    first = _triplet(part.where(F.col("p_size") < 46), F.col("p_partkey"), F.col("p_size"), F.lit(1))
    second = _triplet(
        part.where(F.col("p_size") > 40), F.col("p_partkey"), F.col("p_size") + 100, F.lit(1)
    )
    return first.unionByName(second)


def user_age(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer").where(F.col("c_acctbal") > 0)
    return _triplet(customer, F.col("c_custkey"), F.lit(0), F.col("c_acctbal") / 10000)


def user_region(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer").where(F.col("c_nationkey") != 7)
    return _triplet(customer, F.col("c_custkey"), F.col("c_nationkey"), F.lit(1))


def user_region_multi(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer").where(F.col("c_acctbal") > 9000)
    second = _triplet(customer, F.col("c_custkey"), F.col("c_nationkey") + 25, F.lit(1))
    return user_region(spark, folder).unionByName(second)
