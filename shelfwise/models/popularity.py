"""Popularity: the most used items that the user has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import known
from shelfwise.operators.interactions import users as distinct_users
from shelfwise.operators.ranking import as_recs, rank_items, rank_shared_items
from shelfwise.schemas import ITEM, VALUE, check_k
from shelfwise.settings import cut_lineage

NAME = "popularity"


def item_popularity(train: DataFrame) -> DataFrame:
    """(contentId, score): summed value per item, combined on the map side."""
    return train.groupBy(ITEM).agg(known(F.sum(VALUE)).alias("score"))


def fit_popularity(train: DataFrame) -> DataFrame:
    """The item list with its ranks, one row per train item, written once."""
    return cut_lineage(rank_items(cut_lineage(item_popularity(train))))


def recommend_popular(ranked: DataFrame, train: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
    """The first k items of the list per user, without the user's train items."""
    check_k(k)
    seen = train if exclude_seen else train.limit(0)
    return as_recs(rank_shared_items(ranked, distinct_users(train), seen, k), NAME)
