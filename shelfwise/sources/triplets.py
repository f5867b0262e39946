"""Readers for the triplet files (``row``, ``col``, ``data``) and the table sink.

Every reader also accepts a DataFrame with the triplet columns, so Parquet or a
table works wherever a CSV path does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schemas import ITEM, RECS, TRIPLET, TRIPLET_COLUMNS, USER, VALUE, validate_columns
from shelfwise.settings import cut_lineage

Source = str | DataFrame


def read_triplets(spark: SparkSession, source: Source, sep: str = ";") -> DataFrame:
    """Triplets with string ids and a double value; NaN values become null.

    For a path, the header line is checked before the scan: a missing column or
    a wrong separator raises ``ValueError``.  The scan fails on a file whose header
    has another order, and on a value that is no number.
    """
    if isinstance(source, DataFrame):
        validate_columns(source.columns, TRIPLET_COLUMNS, "the table")
        raw = source
    else:
        header = spark.read.option("header", True).option("sep", sep).csv(source).columns
        validate_columns(header, TRIPLET_COLUMNS, source)
        raw = (
            spark.read.schema(TRIPLET if tuple(header) == TRIPLET_COLUMNS else _by_header(header))
            .option("header", True)
            .option("sep", sep)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .csv(source)
        )
    value = F.col("data").cast("double")
    return raw.select(
        F.col("row").cast("string").alias("row"),
        F.col("col").cast("string").alias("col"),
        F.when(~F.isnan(value), value).alias("data"),
    )


def _by_header(header: list[str]):
    kinds = {"data": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header])


def scan_triplets(
    spark: SparkSession, path: str, sep: str = ";", whole_numbers: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """The good rows of a file as triplets, and its bad ones as (file, line, reason).

    Nothing ends the scan but a header without the three columns.  ``reason`` is
    ``fields`` (more or fewer than in the header), ``value`` (``data`` is no number),
    ``id`` (``row`` or ``col`` is empty) or ``number`` (a column of ``whole_numbers``
    holds something else); the first that applies.  An empty or NaN ``data`` is a null
    value, not an error.  The file is parsed once: both tables are read from what that
    left in the shared folder, so they agree even if the file changes.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    validate_columns(header, TRIPLET_COLUMNS, path)
    names = {name.lower() for name in header}
    corrupt = "bad_line"
    while corrupt in names:
        corrupt += "_"
    schema = T.StructType([*_by_header(header).fields, T.StructField(corrupt, T.StringType())])
    parsed = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .csv(path)
    )
    # All columns are written: a scan of some columns would not look at the others.
    parsed = cut_lineage(parsed.select("*", F.col("_metadata.file_path").alias("file")))
    bare = F.regexp_replace(F.col(corrupt), '"[^"]*"', "")
    fields = F.size(F.split(bare, "\\Q" + sep + "\\E", -1))
    missing = F.col("row").isNull() | F.col("col").isNull()
    reason = (
        F.when(F.col(corrupt).isNotNull() & (fields != len(header)), "fields")
        .when(F.col(corrupt).isNotNull(), "value")
        .when(missing, "id")
    )
    for name in whole_numbers:
        reason = reason.when(F.col(name).isNotNull() & F.col(name).try_cast("bigint").isNull(), "number")
    judged = parsed.withColumn("reason", reason)
    line = F.coalesce(corrupt, F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header)))
    rejects = judged.where("reason is not null").select("file", line.alias("line"), "reason")
    return read_triplets(spark, judged.where("reason is null").select(*TRIPLET_COLUMNS)), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(reason, n) of the rows that ``scan_triplets`` left out."""
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def read_interactions(spark: SparkSession, source: Source, sep: str = ";") -> DataFrame:
    """Interactions; rows without a user or item id are left out (see ``null_ids``)."""
    named = read_triplets(spark, source, sep).select(
        F.col("row").alias(USER), F.col("col").alias(ITEM), F.col("data").alias(VALUE)
    )
    return named.where(F.col(USER).isNotNull() & F.col(ITEM).isNotNull())


def null_ids(spark: SparkSession, source: Source, sep: str = ";") -> DataFrame:
    """How many rows ``read_interactions`` leaves out: one row, ``dropped``."""
    lacking = F.col("row").isNull() | F.col("col").isNull()
    return read_triplets(spark, source, sep).agg(F.count_if(lacking).alias("dropped"))


def _keyed(triplets: DataFrame, key: str, **columns: str) -> DataFrame:
    picked = [F.col(old).alias(new) for new, old in columns.items()]
    return triplets.where(F.col("row").isNotNull()).select(F.col("row").alias(key), *picked)


def item_info(
    spark: SparkSession, asset: Source, price: Source, subclass: Source, sep: str = ";"
) -> DataFrame:
    """All items known to any of the three files; one row per item and category."""
    assets = _keyed(read_triplets(spark, asset, sep), ITEM, asset="data")
    prices = _keyed(read_triplets(spark, price, sep), ITEM, price="data")
    categories = _keyed(
        read_triplets(spark, subclass, sep).withColumn("col", F.col("col").cast("bigint")),
        ITEM,
        category_no="col",
        category_flag="data",
    )
    return assets.join(prices, ITEM, "full_outer").join(categories, ITEM, "full_outer")


def user_info(spark: SparkSession, age: Source, region: Source, sep: str = ";") -> DataFrame:
    """All users known to either file; one row per user and region."""
    ages = _keyed(read_triplets(spark, age, sep), USER, age="data")
    regions = _keyed(
        read_triplets(spark, region, sep).withColumn("col", F.col("col").cast("bigint")),
        USER,
        region_no="col",
        region_flag="data",
    )
    return regions.join(ages, USER, "full_outer").select(USER, "region_no", "region_flag", "age")


def interactions_users(
    spark: SparkSession, interactions: Source, age: Source, region: Source, sep: str = ";"
) -> DataFrame:
    """Interactions with the user columns; a user with m regions repeats m times."""
    users = user_info(spark, age, region, sep)
    return read_interactions(spark, interactions, sep).join(users, USER, "left")


def write_triplets(triplets: DataFrame, path: str, sep: str = ";") -> str:
    """Write triplets as delimited files with a header, as the readers expect."""
    triplets.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)
    return path


def write_recs(recs: DataFrame, path: str) -> str:
    """Write recommendation lists, one folder per model."""
    recs.write.mode("overwrite").partitionBy("model").parquet(path)
    return path


def replace_recs(recs: DataFrame, path: str) -> str:
    """Write the lists of the models in ``recs`` again; the folders of other models stay as they are."""
    recs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
    return path


def read_recs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECS).parquet(path)
