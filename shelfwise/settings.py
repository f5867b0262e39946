"""Size limits that decide between strategies, and the shared scratch folder.

Every limit bounds what one task or one broadcast may hold.  The callers accept
an override for each, so the tests reach the large-data branches on small data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of one key (a user, an item) that a single task may sort or hold.
HOT_KEY_ROWS = 1_000_000
# Rows of a large table that one task should join or sort.
TASK_ROWS = 500_000
# Rows that one unpartitioned window may number.
RANK_BUCKET_ROWS = 1_000_000
# Bytes of a numeric block that is sent to every executor.
BROADCAST_BYTES = 256 * 1024 * 1024
# Raters of one item that meet under one key of the similarity join.
ITEM_ROWS = 2_000
# Pairs of ratings that one task of the similarity join should make.
TASK_PAIRS = 20_000_000
# Pairs or ratings that one task of the neighbour model should group.
GROUP_ROWS = 2_000_000
# Items up to which the item-item Gram matrix is decomposed directly.
GRAM_ITEMS = 4_096
# Parameters of the factorization machine that the library's learner, which keeps about ten copies, may have on the driver.
FM_DRIVER_BYTES = 8 * 1024 * 1024
# Leading ranks of a shared item list that are sent to every task.
HEAD_RANKS = 100_000
# Items in one packed list, in the display view and in the neighbour join.
LIST_ITEMS = 10_000
# Links that meet one packed list in one task.
LINK_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint directory.

    Only a local session without one gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="shelfwise-")
    context.setCheckpointDir(folder)
    return folder


def wide(spark: SparkSession) -> int:
    """Partitions for a stage whose work is far larger than its input.

    Such a stage names its partition number, or small input would be merged into
    few tasks.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of at most about ``TASK_ROWS`` of ``rows`` each, and no fewer than cores.

    What a task holds then stays the same however large the table and whatever the
    number of shuffle partitions.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, spread: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    A lost executor then costs a read, not a recomputation, and the planner knows
    the size of the table.  ``spread`` is for tables whose rows fan out later: one
    that came out in fewer files than there are cores is dealt out evenly.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and len(table.inputFiles()) < cores:
        return table.repartition(cores)
    return table
