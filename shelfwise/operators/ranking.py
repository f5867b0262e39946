"""Top-k lists: exclusion of seen items, ranking, shared lists, factor scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise import settings
from shelfwise.functions import kernels
from shelfwise.functions.columns import rank_order
from shelfwise.operators.indexing import global_rank
from shelfwise.schemas import ITEM, USER, check_k
from shelfwise.settings import cut_lineage

# What an id takes in a task's memory besides its characters.
ID_BYTES = 64


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates without the (user, item) pairs in ``seen``."""
    return candidates.join(seen.select(USER, ITEM), [USER, ITEM], "left_anti")


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows per user as (personId, rank, contentId, score).

    Each task keeps its own k best rows of a user before the shuffle, so a user
    with very many candidates sends few rows.
    """
    check_k(k)
    rank = F.row_number().over(W.partitionBy(USER).orderBy(*rank_order()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(USER, "rank", ITEM, "score")


def as_recs(ranked: DataFrame, model: str) -> DataFrame:
    """Ranked rows in the common list schema."""
    return ranked.select(F.lit(model).alias("model"), USER, "rank", ITEM, F.col("score").cast("double").alias("score"))


def rank_items(scores: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """Items in list order: (contentId, score, pop_rank), ranks 1..n."""
    best_first = [-F.round(F.col("score"), 9), F.col(ITEM)]
    return global_rank(scores.select(ITEM, "score"), best_first, "pop_rank", bucket_rows)


def top_items(scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best items of the whole catalogue."""
    return scores.orderBy(*rank_order()).limit(check_k(n))


def shared_candidates(ranked: DataFrame, users: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """Unseen ranks of a list that is the same for all users: (personId, pop_rank).

    A user with c seen items among the first ranks needs at most k + c ranks, so
    the rows made are k per user plus the seen rows that matter, never the grid.
    ``seen`` may bring the ``pop_rank`` of its items; else it is looked up.
    """
    check_k(k)
    reach = seen.groupBy(USER).agg((F.count("*") + k).alias("reach"))
    if "pop_rank" not in seen.columns:
        seen = seen.select(USER, ITEM).join(ranked.select(ITEM, "pop_rank"), ITEM)
    placed = seen.select(USER, "pop_rank").join(reach, USER)
    # Few rows of a large table, needed twice: written once.
    passed = cut_lineage(placed.where(F.col("pop_rank") <= F.col("reach")).select(USER, "pop_rank"))
    counts = passed.groupBy(USER).agg(F.count("*").alias("c"))
    last = F.lit(k) + F.coalesce("c", F.lit(0))
    slots = users.join(counts, USER, "left").select(
        USER, F.explode(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"))).alias("pop_rank")
    )
    return slots.join(passed, [USER, "pop_rank"], "left_anti")


def rank_shared_items(
    ranked: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    k: int = 10,
    head_ranks: int | None = None,
) -> DataFrame:
    """The first k unseen items of a shared list for every user.

    The first ``head_ranks`` ranks, which nearly all users' lists come from, form
    a table of known size that every task gets; later ranks, reached only by users
    who have seen that many items, are looked up by an ordinary join.
    """
    head_ranks = head_ranks or settings.HEAD_RANKS
    rank = F.row_number().over(W.partitionBy(USER).orderBy("pop_rank"))
    # Read by both joins below: written once, k rows per user.
    chosen = cut_lineage(
        shared_candidates(ranked, users, seen, k).withColumn("rank", rank).where(F.col("rank") <= k)
    )
    in_head = F.col("pop_rank") <= head_ranks
    head = chosen.where(in_head).join(F.broadcast(ranked.where(in_head)), "pop_rank")
    tail = chosen.where(~in_head).join(ranked.where(~in_head), "pop_rank")
    return head.unionByName(tail).select(USER, "rank", ITEM, "score")


def factor_topk(
    users: DataFrame,
    items: DataFrame,
    k: int = 10,
    seen: DataFrame | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """Exact top-k items per user by the dot product of their ``factors`` arrays.

    Item ids and factors of at most ``block_bytes`` go to every task as one block.
    Larger ones are cut into item groups that meet user groups in a shuffle, each
    meeting of bounded size.  Either way a user gets k plus its number of seen
    items per block, enough to rank exactly after the seen pairs are taken out.
    """
    check_k(k)
    block_bytes = block_bytes or settings.BROADCAST_BYTES
    items = items.select(ITEM, "factors")
    size = items.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size("factors")), F.lit(1)).alias("width"),
        F.sum(F.octet_length(ITEM) + ID_BYTES).alias("ids"),
    ).first()
    schema = f"{USER} string, {ITEM} string, score double"
    if not size["n"]:
        return top_k(users.sparkSession.createDataFrame([], schema), k)
    if 8 * size["n"] * size["width"] + size["ids"] <= block_bytes:
        wanted = users.select(USER, "factors", F.lit(0).cast("bigint").alias("n_seen"))
        if seen is not None:
            counts = seen.groupBy(USER).agg(F.count("*").alias("n_seen"))
            wanted = users.select(USER, "factors").join(counts, USER, "left").fillna(0, ["n_seen"])
        sent = users.sparkSession.sparkContext.broadcast(kernels.item_block(items.toArrow()))
        scored = wanted.mapInArrow(kernels.block_scorer(sent, k), schema)
    else:
        rows = max(1, block_bytes // (32 * size["width"]))
        scored = _score_tiles(users.select(USER, "factors"), items, seen, k, size["n"], rows, schema)
    if seen is not None:
        scored = exclude_seen(scored, seen)
    return top_k(scored, k)


def _score_tiles(
    users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, n_items: int, rows: int, schema: str
) -> DataFrame:
    """Scores of user groups against item groups of about ``rows`` rows each.

    A group gives a user k items and as many as the user has seen of that group.
    """
    user_groups = max(1, -(-users.count() // rows))
    item_groups = max(1, -(-n_items // rows))

    def group(key: str, groups: int):
        return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")

    def every(groups: int):
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    n_seen = F.lit(0).cast("bigint")
    if seen is not None:
        counts = seen.groupBy(USER, group(ITEM, item_groups).alias("ig")).agg(F.count("*").alias("n"))
        counts = counts.groupBy(USER).agg(F.map_from_entries(F.collect_list(F.struct("ig", "n"))).alias("seen_of"))
        users = users.join(counts, USER, "left")
        n_seen = F.coalesce(F.try_element_at("seen_of", F.col("ig")), n_seen)
    left = users.select("*", group(USER, user_groups).alias("ug"), every(item_groups).alias("ig"))
    left = left.select(USER, "factors", n_seen.alias("n_seen"), "ug", "ig")
    right = items.select("*", group(ITEM, item_groups).alias("ig"), every(user_groups).alias("ug"))
    met = left.groupBy("ug", "ig").cogroup(right.groupBy("ug", "ig"))
    return met.applyInArrow(kernels.tile_scorer(k), schema)
