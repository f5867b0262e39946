"""Activity filter, collapsing and the sparse rating table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import known
from shelfwise.schemas import ITEM, USER, VALUE
from shelfwise.settings import cut_lineage


def pair_sums(interactions: DataFrame) -> DataFrame:
    """One row per (user, item) with the summed value; all-null sums are 0."""
    return interactions.groupBy(USER, ITEM).agg(known(F.sum(VALUE)).alias(VALUE))


def active_users(interactions: DataFrame, min_items: int = 10) -> DataFrame:
    """Users with at least ``min_items`` distinct items: (personId, n_items).

    Distinct pairs first, then a count per user.  Both steps combine on the map
    side, so a user with very many rows is spread over tasks.
    """
    pairs = interactions.select(USER, ITEM).distinct()
    return pairs.groupBy(USER).agg(F.count("*").alias("n_items")).where(F.col("n_items") >= min_items)


def active_interactions(interactions: DataFrame, min_items: int = 10) -> DataFrame:
    """All interactions of active users, unchanged."""
    return interactions.join(active_users(interactions, min_items).select(USER), USER, "left_semi")


def active_counts(pairs: DataFrame, min_items: int = 10) -> DataFrame:
    """(personId, n) of the users with at least ``min_items`` rows in a table of distinct pairs."""
    return pairs.groupBy(USER).agg(F.count("*").alias("n")).where(F.col("n") >= min_items)


def keep_active(pairs: DataFrame, min_items: int = 10) -> DataFrame:
    """Rows of users with at least ``min_items`` rows in a table of distinct pairs.

    A task holds its users, one row each, and passes the pairs by them unsorted.
    """
    return pairs.join(active_counts(pairs, min_items).select(USER).hint("shuffle_hash"), USER, "left_semi")


def collapse(interactions: DataFrame, min_items: int = 10) -> DataFrame:
    """Active users' interactions, one row per (user, item) with summed values.

    The sums come first: the pair table is the distinct table the activity count
    needs, so users are counted on pairs instead of raw rows.  It is written, so that
    no task both adds up pairs and counts or joins them.
    """
    return keep_active(cut_lineage(pair_sums(interactions)), min_items)


def collapse_joined(interactions_users: DataFrame, min_items: int = 10) -> DataFrame:
    """Collapse of the already joined table: values repeat once per region row."""
    return collapse(interactions_users.select(USER, ITEM, VALUE), min_items)


def collapse_repeated(interactions: DataFrame, users: DataFrame, min_items: int = 10) -> DataFrame:
    """`collapse_joined` of the interactions left-joined to ``users``, without the joined rows.

    A pair's values repeat once per row of its user, so its sum is taken that often.
    """
    repeats = users.groupBy(USER).agg(F.count("*").alias("_repeats")).hint("shuffle_hash")
    repeated = F.col(VALUE) * F.coalesce("_repeats", F.lit(1))
    return collapse(interactions, min_items).join(repeats, USER, "left").select(USER, ITEM, repeated.alias(VALUE))


def rating_cells(train: DataFrame) -> DataFrame:
    """The ratings matrix in long form: mean value per cell, a missing row means 0."""
    cells = train.groupBy(USER, ITEM).agg(F.avg(VALUE).alias(VALUE))
    return cells.where(F.col(VALUE).isNotNull())


def catalogue(train: DataFrame) -> DataFrame:
    """The distinct items of the train rows."""
    return train.select(ITEM).distinct()


def users(train: DataFrame) -> DataFrame:
    """The distinct users of the train rows."""
    return train.select(USER).distinct()


def user_item_grid(train: DataFrame) -> DataFrame:
    """Size of every user's share of the user x item grid, without building the grid."""
    size = catalogue(train).agg(F.count("*")).scalar()
    return users(train).select(USER, size.alias("n_candidates"))
