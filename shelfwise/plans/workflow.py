"""End to end: load, prepare, fit five recommenders, recommend, compare."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from shelfwise.models import content, fm, neighbours, popularity, svd
from shelfwise.operators.evaluation import compare, hit_rate_at_k
from shelfwise.operators.interactions import active_counts, pair_sums
from shelfwise.operators.split import part, stratified_split
from shelfwise.schemas import check_k
from shelfwise.settings import cut_lineage
from shelfwise.sources.triplets import Source, item_info, read_interactions

# The order of the printed comparison.
MODELS = (popularity.NAME, neighbours.NAME, svd.NAME, content.NAME, fm.NAME)


@dataclass
class Sources:
    """Paths or triplet tables of the files the models use."""

    interactions: Source
    item_asset: Source
    item_price: Source
    item_subclass: Source
    sep: str = ";"


@dataclass
class Config:
    """Settings of a run."""

    k: int = 10
    min_items: int = 10
    test_size: float = 0.2
    seed: int = 42
    alpha: float = 0.0
    svd_rank: int = 100
    negatives_per_row: int = 4
    fm_negatives: int = 100_000
    fm_factors: int = 10
    fm_iterations: int = 30
    models: tuple[str, ...] = field(default=MODELS)


@dataclass
class Outcome:
    """Train and test rows, all lists in one table, and the score per model."""

    train: DataFrame
    test: DataFrame
    recs: DataFrame
    scores: DataFrame


def assign(interactions: DataFrame, min_items: int, test_size: float, seed: int) -> DataFrame:
    """Collapsed rows of active users with their ``split``.

    The pair sums are written first, since counting and filtering users reads them
    again and the raw rows should be shuffled once.  So are the counts of the active
    users, which keep their rows, size the tasks and find hot users.
    """
    pairs = cut_lineage(pair_sums(interactions))
    counts = cut_lineage(active_counts(pairs, min_items))
    return stratified_split(pairs, test_size, seed, counts=counts)


def prepare(interactions: DataFrame, min_items: int, test_size: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The train and the test rows; both read one written table."""
    assigned = cut_lineage(assign(interactions, min_items, test_size, seed))
    return part(assigned, "train"), part(assigned, "test")


def recommend_with(model: str, train: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Fit one model on the (collapsed) train rows and list k items per user."""
    k = config.k
    if model == popularity.NAME:
        return popularity.recommend_popular(popularity.fit_popularity(train), train, k)
    if model == neighbours.NAME:
        edges = neighbours.fit_neighbours(train, collapsed=True)
        return neighbours.cf_topk(edges, train, k, config.alpha, collapsed=True)
    if model == svd.NAME:
        fitted = svd.fit_svd(train, config.svd_rank, collapsed=True, seed=config.seed)
        return svd.recommend_svd(fitted, train, k, collapsed=True)
    if model == content.NAME:
        negatives = content.sample_negative_counts(train, config.negatives_per_row, config.seed)
        fitted = content.fit_content(train, negatives, items, seed=config.seed)
        return content.recommend_content(fitted, items, train, k)
    if model == fm.NAME:
        rows = fm.fm_train(train, config.fm_negatives, config.seed)
        fitted = fm.fit_fm(rows, config.fm_factors, config.fm_iterations, config.seed)
        return fm.recommend_fm(fitted, train, k)
    raise ValueError(f"unknown model {model}")


def run_comparison(spark: SparkSession, sources: Sources, config: Config | None = None) -> Outcome:
    """The whole comparison.  Each model's lists are materialised once, then scored."""
    config = config or Config()
    check_k(config.k)
    interactions = read_interactions(spark, sources.interactions, sources.sep)
    train, test = prepare(interactions, config.min_items, config.test_size, config.seed)
    items = item_info(spark, sources.item_asset, sources.item_price, sources.item_subclass, sources.sep)
    lists = [cut_lineage(recommend_with(model, train, items, config)) for model in config.models]
    recs = reduce(DataFrame.unionByName, lists)
    return Outcome(train, test, recs, compare(recs, train, test, config.k))


def print_scores(outcome: Outcome, k: int = 10) -> None:
    """Print the unrounded score of every model, one line each."""
    for row in hit_rate_at_k(outcome.recs, outcome.train, outcome.test, k).orderBy("model").collect():
        print(f"{row['model']} score: {row['score']}")
