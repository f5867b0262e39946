"""The registered queries: every operator over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.models import content, fm, neighbours, popularity, svd
from shelfwise.operators import evaluation, interactions, ranking
from shelfwise.operators.split import exact_split
from shelfwise.operators.vectors import inner_products, weighted_sums
from shelfwise.plans.workflow import Config, Sources, assign, prepare, run_comparison
from shelfwise.schemas import ITEM, RECS, USER, VALUE
from shelfwise.settings import cut_lineage, scratch_path
from shelfwise.sources import triplets, views

MIN_ITEMS = 30
SEED = 42
K = 10
ALPHA_BELOW = -0.5

# Tables that several queries read, made once per session and folder.
_made: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Drop the shared tables, so that the next query makes its own."""
    _made.clear()


def _csv(spark: SparkSession, folder: str, name: str) -> str:
    """The named view written as delimited files in the shared folder."""

    def write() -> str:
        return triplets.write_triplets(getattr(views, name)(spark, folder), scratch_path(spark, name))

    return _once(spark, folder, f"csv:{name}", write)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return triplets.read_interactions(spark, views.interactions(spark, folder))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return triplets.item_info(
        spark, views.item_asset(spark, folder), views.item_price(spark, folder), views.item_subclass(spark, folder)
    )


def shared_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The train and test rows that the model queries share."""
    return _once(spark, folder, "parts", lambda: prepare(_read(spark, folder), MIN_ITEMS, 0.2, SEED))


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return shared_parts(spark, folder)[0]


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.fit_neighbours(_train(spark, folder), collapsed=True)


def _plain(rows: DataFrame) -> DataFrame:
    """Numbers that may be missing as doubles, which every engine returns alike."""
    return rows.withColumns({n: F.col(n).cast("double") for n in ("category_no", "region_no") if n in rows.columns})


# --- sources -----------------------------------------------------------------------


def scan_interactions(spark, folder):
    return triplets.read_interactions(spark, _csv(spark, folder, "interactions"))


def item_info(spark, folder):
    names = ("item_asset", "item_price", "item_subclass")
    return _plain(triplets.item_info(spark, *(_csv(spark, folder, n) for n in names)))


def user_info(spark, folder):
    return _plain(triplets.user_info(spark, *(_csv(spark, folder, n) for n in ("user_age", "user_region"))))


def interactions_users(spark, folder):
    names = ("interactions", "user_age", "user_region")
    return _plain(triplets.interactions_users(spark, *(_csv(spark, folder, n) for n in names)))


def item_info_fanout(spark, folder):
    rows = _items(spark, folder).groupBy(ITEM).agg(F.count("*").alias("feature_rows"))
    return interactions.catalogue(_train(spark, folder)).join(rows, ITEM).select(ITEM, "feature_rows")


# --- preparation ---------------------------------------------------------------------


def active_users(spark, folder):
    return interactions.active_users(_read(spark, folder), MIN_ITEMS)


def active_interactions(spark, folder):
    return interactions.active_interactions(_read(spark, folder), MIN_ITEMS)


def collapsed_interactions(spark, folder):
    return interactions.collapse(_read(spark, folder), MIN_ITEMS)


def collapsed_with_fanout(spark, folder):
    users = triplets.user_info(spark, views.user_age(spark, folder), views.user_region_multi(spark, folder))
    return interactions.collapse_repeated(_read(spark, folder), users, MIN_ITEMS)


def split_assignment(spark, folder):
    return assign(_read(spark, folder), MIN_ITEMS, 0.2, SEED)


def split_exact_total(spark, folder):
    pairs = interactions.collapse(_read(spark, folder), MIN_ITEMS)
    return exact_split(pairs, 0.2, SEED)


def ground_truth(spark, folder):
    train, test = shared_parts(spark, folder)
    lists = evaluation.truth_lists(train, test)
    counts = evaluation.truth_counts(train, test)
    return lists.join(counts, USER).select(
        USER,
        "n_train",
        "n_test",
        F.concat_ws(",", "true_train").alias("true_train"),
        F.concat_ws(",", "true_test").alias("true_test"),
    )


def rating_cells(spark, folder):
    return interactions.rating_cells(_train(spark, folder))


def catalogue(spark, folder):
    return interactions.catalogue(_train(spark, folder))


def user_item_grid(spark, folder):
    return interactions.user_item_grid(_train(spark, folder))


# --- popularity and evaluation --------------------------------------------------------


def item_popularity(spark, folder):
    return popularity.item_popularity(_train(spark, folder))


def top_items(spark, folder):
    return ranking.top_items(item_popularity(spark, folder), K)


def candidates_unseen(spark, folder):
    train = _train(spark, folder)
    return ranking.shared_candidates(popularity.fit_popularity(train), interactions.users(train), train, K)


def popularity_topk(spark, folder):
    train = _train(spark, folder)
    return popularity.recommend_popular(popularity.fit_popularity(train), train, K)


def recs_round_trip(spark, folder):
    """Lists written by the sink and read back."""
    path = scratch_path(spark, "recs")
    triplets.write_recs(popularity_topk(spark, folder), path)
    return spark.read.schema(RECS).parquet(path)


def _flawed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The interactions as a file in which every fifth row or so is spoilt in one of four ways, scanned."""

    def write() -> str:
        kind = F.pmod(F.col("row") * 31 + F.col("col") * 7, F.lit(20))
        data = F.col("data").cast("string")
        spoilt = views.interactions(spark, folder).select(
            F.when(kind != 2, F.col("row").cast("string")).alias("row"),
            F.when(kind == 3, F.concat(F.lit("x"), F.col("col"))).otherwise(F.col("col").cast("string")).alias("col"),
            F.when(kind == 0, "n/a").when(kind == 1, F.concat(data, F.lit(";1"))).otherwise(data).alias("data"),
        )
        path = scratch_path(spark, "flawed")
        spoilt.write.option("header", True).option("sep", ";").option("quote", "\u0000").csv(path)
        return path

    return triplets.scan_triplets(spark, _once(spark, folder, "csv:flawed", write), whole_numbers=("col",))


def load_rejects(spark, folder):
    """Rows that the scan puts aside, by reason."""
    return triplets.reject_counts(_flawed(spark, folder)[1])


def load_kept(spark, folder):
    """What the scan of the same file keeps."""
    return triplets.read_interactions(spark, _flawed(spark, folder)[0])


def dropped_rows(spark, folder):
    """How many interactions ingest leaves out if only parts with an asset have an id."""
    named = views.item_asset(spark, folder).select(F.col("row").alias("known"))
    bought = views.interactions(spark, folder).join(named, F.col("col") == F.col("known"), "left")
    return triplets.null_ids(spark, bought.select("row", F.col("known").alias("col"), "data"))


def recs_wide(spark, folder):
    wide = evaluation.recs_wide(popularity_topk(spark, folder))
    return wide.select("model", USER, F.concat_ws(",", "items").alias("items"))


def recs_by_model(spark, folder):
    """A column per model, after one model's lists were written again on their own."""
    path = scratch_path(spark, "recs")
    recs = popularity_topk(spark, folder)
    top = recs.where(F.col("rank") <= 3).withColumn("model", F.lit("top3"))
    triplets.write_recs(recs.unionByName(recs.where(F.col("rank") == 1).withColumn("model", F.lit("top3"))), path)
    triplets.replace_recs(top, path)
    wide = evaluation.recs_by_model(triplets.read_recs(spark, path), [popularity.NAME, "top3", "none"])
    return wide.select(USER, *(F.concat_ws(",", c).alias(c) for c in (popularity.NAME, "top3", "none")))


def hits_per_user(spark, folder):
    train, test = shared_parts(spark, folder)
    found = evaluation.hits_per_user(popularity_topk(spark, folder), train, test, K, [popularity.NAME])
    return found.withColumn("score", F.round("score", 9))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("model", F.round("score", 9).alias("score"))


def hit_rate_popularity(spark, folder):
    train, test = shared_parts(spark, folder)
    return _rounded(evaluation.hit_rate_at_k(popularity_topk(spark, folder), train, test, K))


def hit_rate_empty_test(spark, folder):
    """Only test rows above the mean test value count, which leaves some users without any."""
    train, test = shared_parts(spark, folder)
    liked = test.where(F.col(VALUE) > test.agg(F.avg(VALUE)).scalar())
    return _rounded(evaluation.hit_rate_at_k(popularity_topk(spark, folder), train, liked, K))


def map_at_k(spark, folder):
    train, test = shared_parts(spark, folder)
    return _rounded(evaluation.map_at_k(popularity_topk(spark, folder), train, test, K))


# --- neighbours ---------------------------------------------------------------------------


def user_similarity(spark, folder):
    return neighbours.user_similarity(_train(spark, folder), collapsed=True)


def cf_neighbours(spark, folder):
    return neighbours.cf_neighbours(user_similarity(spark, folder))


def cf_scores(spark, folder):
    return neighbours.cf_scores(_edges(spark, folder), _train(spark, folder), collapsed=True)


def cf_topk(spark, folder):
    return neighbours.cf_topk(_edges(spark, folder), _train(spark, folder), K, collapsed=True)


def cf_topk_with_seen(spark, folder):
    return neighbours.cf_topk(_edges(spark, folder), _train(spark, folder), K, exclude_seen=False, collapsed=True)


def cf_topk_alpha_negative(spark, folder):
    return neighbours.cf_topk(_edges(spark, folder), _train(spark, folder), K, alpha=ALPHA_BELOW, collapsed=True)


def cf_topk_fill_popular(spark, folder):
    """Few neighbours at a high threshold, so that many lists need filling."""
    return neighbours.cf_topk(
        _edges(spark, folder), _train(spark, folder), K, alpha=0.9999, fill="popular", collapsed=True
    )


def hit_rate_cf(spark, folder):
    train, test = shared_parts(spark, folder)
    return _rounded(evaluation.hit_rate_at_k(cut_lineage(cf_topk(spark, folder)), train, test, K))


# --- factors, content, factorization machine -----------------------------------------------


def factor_topk(spark, folder):
    """Nearest vectors by dot product: all vectors against all others."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("factors")
    )
    users = vectors.select(F.col("id").alias(USER), "factors")
    items = vectors.select(F.col("id").alias(ITEM), "factors")
    itself = vectors.select(F.col("id").alias(USER), F.col("id").alias(ITEM))
    best = ranking.factor_topk(users, items, K, itself)
    return best.withColumn("score", F.round("score", 6))


def negative_pairs(spark, folder):
    return content.sample_negatives(_train(spark, folder), 4, SEED)


def negative_pairs_excluding_positives(spark, folder):
    return content.sample_negatives(_train(spark, folder), 4, SEED, exclude_positives=True)


def content_train(spark, folder):
    return _plain(content.content_train(_train(spark, folder), negative_pairs(spark, folder), _items(spark, folder)))


def content_candidates(spark, folder):
    return _plain(content.content_candidates(_train(spark, folder), _items(spark, folder)))


def _negative_counts(spark, folder) -> DataFrame:
    """The pairs of ``negative_pairs`` by item, which is all that the learner reads of them."""
    return content.sample_negative_counts(_train(spark, folder), 4, SEED)


def content_topk(spark, folder):
    train, items = _train(spark, folder), _items(spark, folder)
    fitted = content.fit_content(train, _negative_counts(spark, folder), items, seed=SEED)
    return content.recommend_content(fitted, items, train, K)


def content_class_topk(spark, folder):
    """Values in three bands against pairs without interaction; ranked by the chance of the lowest band."""
    train, items = _train(spark, folder), _items(spark, folder)
    fitted = content.fit_content(
        content.banded(train, [17.0, 34.0]), _negative_counts(spark, folder), items, target="class", seed=SEED
    )
    return content.recommend_content(fitted, items, train, K)


def fm_train(spark, folder):
    return fm.fm_train(_train(spark, folder), 100_000, SEED)


def fm_topk(spark, folder):
    return fm.recommend_fm(fm.fit_fm(fm_train(spark, folder), seed=SEED), _train(spark, folder), K)


def _svd(spark, folder) -> svd.SvdModel:
    return svd.fit_svd(_train(spark, folder), 100, collapsed=True, seed=SEED)


def svd_factors(spark, folder):
    return _svd(spark, folder).factors


def svd_gram_check(spark, folder):
    """Factors by what defines them: V'V is the identity, and V'R'RV is the squared singular values.

    ``residual`` is what V'R'RV has beside them, over the largest.
    """
    model = _svd(spark, folder)
    squares = np.square(model.singular_values)
    dots = inner_products(model.factors)
    rebuilt = inner_products(cut_lineage(weighted_sums(_train(spark, folder), model.factors, ITEM, USER)))
    residuals = (rebuilt - np.diag(squares)) / squares[0]
    # Adding zero turns a rounded -0.0 into 0.0.
    rows = [
        (i, j, round(float(dots[i, j]), 6) + 0.0, round(float(residuals[i, j]), 6) + 0.0)
        for i in range(len(dots))
        for j in range(len(dots))
    ]
    return spark.createDataFrame(rows, "i long, j long, dot double, residual double")


def svd_topk(spark, folder):
    return svd.recommend_svd(_svd(spark, folder), _train(spark, folder), K, collapsed=True)


def _learned(spark, folder) -> DataFrame:
    """Lists of the three learned models, made once."""

    def make() -> DataFrame:
        recs = cut_lineage(svd_topk(spark, folder))
        for one in (content_topk, fm_topk):
            recs = recs.unionByName(cut_lineage(one(spark, folder)))
        return recs

    return _once(spark, folder, "learned", make)


def learned_list_check(spark, folder):
    """What must hold of any list: its length, ranks 1..n, falling scores, nothing seen."""
    recs = _learned(spark, folder)
    seen = _train(spark, folder).select(USER, ITEM, F.lit(1).alias("seen"))
    by_rank = W.partitionBy("model", USER).orderBy("rank")
    marked = recs.join(seen, [USER, ITEM], "left").withColumn("before", F.lag(F.round("score", 9)).over(by_rank))
    return marked.groupBy("model", USER).agg(
        F.count_distinct(ITEM).alias("n"),
        (F.sort_array(F.collect_list("rank")) == F.sequence(F.lit(1), F.count("*").cast("int"))).alias("ranks_whole"),
        F.bool_and(F.coalesce(F.round("score", 9) <= F.col("before"), F.lit(True))).alias("scores_fall"),
        F.count("seen").alias("n_seen"),
    )


def five_model_comparison(spark, folder):
    """The whole comparison from the input files to one score per model."""
    names = ("interactions", "item_asset", "item_price", "item_subclass")
    sources = Sources(*(_csv(spark, folder, n) for n in names))
    return run_comparison(spark, sources, Config(k=K, min_items=MIN_ITEMS, seed=SEED)).scores


def hit_rate_learned(spark, folder):
    train, test = shared_parts(spark, folder)
    recs = _learned(spark, folder)
    return _rounded(evaluation.hit_rate_at_k(recs, train, test, K))


def model_comparison(spark, folder):
    train, test = shared_parts(spark, folder)
    recs = popularity_topk(spark, folder).unionByName(cf_topk(spark, folder))
    return evaluation.compare(cut_lineage(recs), train, test, K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    make.__name__: make
    for make in (
        scan_interactions,
        item_info,
        user_info,
        interactions_users,
        item_info_fanout,
        active_users,
        active_interactions,
        collapsed_interactions,
        collapsed_with_fanout,
        split_assignment,
        split_exact_total,
        ground_truth,
        rating_cells,
        catalogue,
        user_item_grid,
        item_popularity,
        top_items,
        candidates_unseen,
        popularity_topk,
        recs_round_trip,
        dropped_rows,
        load_rejects,
        load_kept,
        recs_wide,
        recs_by_model,
        hits_per_user,
        hit_rate_popularity,
        hit_rate_empty_test,
        map_at_k,
        user_similarity,
        cf_neighbours,
        cf_scores,
        cf_topk,
        cf_topk_with_seen,
        cf_topk_alpha_negative,
        cf_topk_fill_popular,
        hit_rate_cf,
        factor_topk,
        negative_pairs,
        negative_pairs_excluding_positives,
        content_train,
        content_candidates,
        content_topk,
        content_class_topk,
        fm_train,
        fm_topk,
        svd_factors,
        svd_gram_check,
        svd_topk,
        hit_rate_learned,
        learned_list_check,
        five_model_comparison,
        model_comparison,
    )
}
