"""What a task, a document or a pass holds must not grow with the tables."""

import datetime as dt
import glob
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gameline.operators import boosting
from gameline.operators import joins as J
from gameline.operators import reshape as R
from gameline.operators import windows as W
from gameline.plans import catalog, feed_queries, stored_runs
from gameline.sources import feeds
from gameline.sources import tables as T
from tests.conftest import SF

HAVE = os.path.isdir(SF)
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_more_games_make_more_documents(spark):
    games = spark.range(100 * feed_queries.ODDS_GAMES).toDF("game_id")
    docs = feed_queries._docs(games, F.count(F.lit(1)).alias("n")).toPandas()
    assert len(docs) == 100 and docs.n.max() == feed_queries.ODDS_GAMES


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_schedule_documents_are_cut_by_games(spark, monkeypatch):
    whole = feed_queries._schedule(spark, SF).count()
    monkeypatch.setattr(feed_queries, "SCHEDULE_GAMES", 500)
    assert feed_queries._schedule(spark, SF).count() > 2 * whole


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_lineups_are_grouped_once_without_sorts(spark):
    plan = plan_of(catalog.queries()["s8_lineups"](spark, SF))
    assert plan.count("HashAggregate") == 2 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_rows_of_lineups_carry_no_players(spark):
    docs = spark.createDataFrame([(1, dt.date(2024, 4, 1), "{}")], "game_id long, game_date date, doc string")
    expanded = [x.rsplit("), [", 2)[-1] for x in plan_of(feeds.lineups(docs)).splitlines() if "Generate" in x]
    assert expanded and not [x for x in expanded if re.search(r"players|\b[st]#", x)]


# --- shuffles ------------------------------------------------------------------------------------------------------------
def test_shuffles_begin_with_a_partition_for_a_few_megabytes(spark, tmp_path):
    path = str(tmp_path / "large")
    spark.range(1 << 20).select(F.rand(1).alias("x"), (F.col("id") % 1000).alias("k")).write.parquet(path)
    try:
        n = T.spread(spark, [path, str(tmp_path / "absent")], 1)
        assert n >= 8 and "hashpartitioning(k#" in plan_of(spark.read.parquet(path).groupBy("k").count())
        assert f", {n})" in plan_of(spark.read.parquet(path).groupBy("k").count())
        assert spark.read.parquet(path).groupBy("k").count().count() == 1000
    finally:
        assert T.spread(spark, [path], 1000) is None and spark.conf.get(INITIAL, None) is None


def test_every_query_is_sized(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "spread", lambda spark, paths: seen.append(paths) or 1 / 0)
    for f in catalog.queries().values():
        with pytest.raises(ZeroDivisionError):
            f(spark, "/nowhere")
    assert len(seen) == len(catalog.queries()) and all("/nowhere/lineitem.parquet" in p for p in seen)


# --- features and models -------------------------------------------------------------------------------------------------
def test_form_takes_one_step_a_row(spark):
    g = [(i, dt.date(2024, 1, 1) + dt.timedelta(i), 1, 2, i % 7, i % 5) for i in range(130)]
    games = spark.createDataFrame(g, "game_id long, game_date date, home_team_id int, away_team_id int, home_runs int, away_runs int")
    form = W.team_form(R.team_games(games))
    assert "RowFrame, -30" not in plan_of(form) and "RowFrame, -60" not in plan_of(form)
    for r in form.where("team_id = 1").collect():
        last = [x[4] for x in g[: r.game_id]]
        assert r.games_in_window_60 == len(last[-60:]) and r.runs_for_30 == (np.mean(last[-30:]) if last else None)
        assert r.avg_runs_scored_60 == (np.mean(last[-60:]) if last else None)


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_fits_read_stored_features(spark):
    rows, _ = catalog._trainable(spark, SF)
    assert "Window" not in plan_of(rows) and "gameline-trainable" in plan_of(rows)


def test_leaves_of_whole_columns_are_those_of_rows():
    r = np.random.default_rng(3)
    x = r.integers(0, 9, (200, 3)).astype(np.uint8)
    tree = boosting.Tree(r.integers(-1, 3, 15), r.integers(0, 9, 15), r.random(16), np.zeros(15))
    for depth in range(5):
        for row, leaf in zip(x, tree.leaves(np.ascontiguousarray(x.T), depth), strict=True):
            at = 0
            for _ in range(depth):
                f = tree.feature[at]
                at = 2 * at + 1 + bool(f >= 0 and row[f] > tree.bin[at])
            assert at - (2**depth - 1) == leaf


# --- as-of lookups -------------------------------------------------------------------------------------------------------
def test_as_of_sorts_days_not_lookups(spark):
    day = dt.date(2024, 5, 2)
    lookups = spark.range(1000).select("id", F.lit(1).alias("e"), F.lit(day).alias("game_date"), F.col("id").cast("string").alias("payload"))
    rollups = spark.createDataFrame([(1, dt.date(2024, 5, 1), 365, 0.5)], "e int, as_of_date date, window_days int, v double")
    out = J.as_of(lookups, rollups, "e")
    assert not [x for x in plan_of(out).splitlines() if "payload" in x and ("Window" in x or "Sort" in x)]
    assert [(r.n, r.v) for r in out.groupBy("v").agg(F.countDistinct("payload").alias("n")).collect()] == [(1000, 0.5)]


# --- stored inputs -------------------------------------------------------------------------------------------------------
@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_polls_are_landed_once(spark):
    assert "Exchange" not in plan_of(stored_runs.polled(spark, SF))


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_pitches_are_made_distinct_once(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/gameline-rows-*"))
    stored_runs.first_wins(spark, SF)
    assert len(set(glob.glob(f"{folder}/gameline-rows-*")) - before) == 1
