from __future__ import annotations

import pytest
from helpers import lists, random_ratings, rows

import __spark_entry__ as spark_entry
from shelfwise.plans.queries import QUERIES
from shelfwise import settings
from shelfwise.models import popularity
from shelfwise.models.neighbours import cf_topk, fit_neighbours
from shelfwise.operators.split import stratified_split
from shelfwise.plans.workflow import MODELS, Config, Sources, print_scores, recommend_with, run_comparison


def sources(spark, data, sep=";"):
    def table(rows_):
        return spark.createDataFrame(rows_, "row string, col string, data double")

    items = sorted({i for _, i, _ in data})
    return Sources(
        table([(u, i, v) for u, i, v in data]),
        table([(i, "0", float(n % 4)) for n, i in enumerate(items)]),
        table([(i, "0", n / 10) for n, i in enumerate(items)]),
        table([(i, str(n % 3), 1.0) for n, i in enumerate(items)]),
    )


def test_all_models_end_to_end(spark, capsys):
    data = random_ratings(8, 30, 25, 0.5)
    config = Config(k=3, min_items=5, svd_rank=5, fm_negatives=100, fm_iterations=5)
    outcome = run_comparison(spark, sources(spark, data), config)
    scores = dict(rows(outcome.scores))
    assert set(scores) == set(MODELS) and all(0 <= s <= 1 for s in scores.values())
    seen = {(r["personId"], r["contentId"]) for r in outcome.train.collect()}
    for model in MODELS:
        found = lists(outcome.recs.where(outcome.recs.model == model))
        assert found and all(len(picked) <= 3 for picked in found.values())
        assert not any((u, i) in seen for u, picked in found.items() for i in picked)
    print_scores(outcome, 3)
    assert len(capsys.readouterr().out.splitlines()) == 5


def test_unknown_model(spark, ratings):
    with pytest.raises(ValueError):
        recommend_with("other", ratings([]), None, Config())


def test_partition_count_does_not_matter(spark, ratings):
    data = random_ratings(13, 25, 20, 0.4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            table = ratings(data).repartition(partitions)
            edges = fit_neighbours(table)
            found.append(
                (
                    rows(stratified_split(table)),
                    rows(cf_topk(edges, table, 4)),
                    rows(popularity.recommend_popular(popularity.fit_popularity(table), table, 4)),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_entry_points(spark):
    names = set(spark_entry.queries())
    assert names >= set(spark_entry.oracle_sql())
    without_sql = {n for n in names - set(spark_entry.oracle_sql()) if n in QUERIES}
    learned = {"content_topk", "content_class_topk", "fm_topk", "svd_factors", "svd_topk", "hit_rate_learned", "five_model_comparison"}
    assert without_sql == learned
    assert spark_entry.entry(spark).count() == 1040


def test_tables_are_written_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert settings.shared_folder(spark) == folder
    table = settings.cut_lineage(spark.range(3))
    assert rows(table) == [(0,), (1,), (2,)]
    assert all(folder in path for path in table.inputFiles())
    assert settings.cut_lineage(spark.range(3).coalesce(1), spread=True).rdd.getNumPartitions() > 1
