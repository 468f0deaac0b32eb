"""Traps of single functions on small literal tables."""

import pytest
from pyspark.sql import functions as F

from gameline.functions import baseball as B
from gameline.functions import odds as O
from gameline.functions import prob as P
from gameline.operators import aggregates as A
from gameline.operators import filters, joins, reshape, sinks, windows
from gameline.sources import feeds, tables
from tests.conftest import rows


def test_innings(spark):
    d = spark.createDataFrame([("5.2",), ("6",), ("5.",), ("5.20",), ("5.7",), (" 0.1 ",), ("x",), ("",), (None,)], "ip string")
    assert [r[0] for r in d.select(B.innings_to_outs(F.col("ip"))).collect()] == [17, 18, None, 15, 15, 1, None, None, None]


def test_odds_round_half_to_even_and_invert(spark):
    d = spark.createDataFrame([(0.5,), (0.6,), (0.4,), (0.0,), (1.0,), (None,)], "p double")
    assert [r[0] for r in d.select(O.prob_to_american(F.col("p"))).collect()] == [-100, -150, 150, 99999900, -99999900, None]
    o = spark.createDataFrame([(x,) for x in (-250, -101, 101, 180)], "o int")
    assert all(r[0] == r[1] for r in o.select("o", O.prob_to_american(O.american_to_implied(F.col("o")))).collect())
    z = spark.createDataFrame([(0,), (None,)], "o int")
    assert all(r == (None, None, False) for r in z.select(O.american_to_implied(F.col("o")), O.profit_if_win(F.col("o")), O.valid_odds(F.col("o"))).collect())


def test_poisson_sums(spark):
    d = spark.createDataFrame([(4.5, 4.2), (3.0, None)], "h double, a double")
    r = d.select(P.win_with_half_tie(F.col("h"), F.col("a")).alias("x"), P.win_with_half_tie(F.col("a"), F.col("h")).alias("y")).collect()
    assert r[0].x.p + r[0].y.p == pytest.approx(1, abs=1e-9) and r[0].x.tie == pytest.approx(0.13667487060143407) and r[1].x.p is None


def test_leverage_is_null_with_either_null(spark):
    d = spark.createDataFrame([(7, 2), (6, 0), (9, None), (None, 5), (8, -3)], "i int, d int")
    assert [r[0] for r in d.select(B.high_leverage(F.col("i"), F.col("d"))).collect()] == [True, False, None, None, False]


def test_latest_before_and_after_validity(spark):
    d = spark.createDataFrame([(1, "b", 1, -110, 100), (1, "b", 2, 50, 100)], "game_id int, sportsbook string, pulled_at int, home_price int, away_price int")
    latest = windows.latest(d, ["game_id", "sportsbook"], ["pulled_at"], ["home_price", "away_price"])
    assert A.market_consensus(latest).count() == 0
    ok = d.where(O.valid_odds(F.col("home_price"), None))
    assert rows(windows.latest(ok, ["game_id"], ["pulled_at"], ["home_price"])) == [(1, -110)]


def test_as_of_keeps_the_latest_row_with_nulls(spark):
    look = spark.createDataFrame([(1, "2024-05-02"), (1, "2024-05-04"), (None, "2024-05-04")], "e int, game_date string").withColumn("game_date", F.col("game_date").cast("date"))
    roll = spark.createDataFrame([(1, "2024-05-01", 365, 0.5), (1, "2024-05-03", 365, None), (1, "2024-05-04", 365, 0.9), (1, "2024-05-01", 30, 0.1)], "e int, as_of_date string, window_days int, s double").withColumn("as_of_date", F.col("as_of_date").cast("date"))
    assert [(r.e, r.s) for r in joins.as_of(look, roll, "e").orderBy("e", "game_date").collect()] == [(None, None), (1, 0.5), (1, None)]


def test_no_market_and_no_bet(spark):
    s = "p_home_model double, p_away_model double, p_home_market_median double, p_away_market_median double, home_price_consensus int, away_price_consensus int"
    d = spark.createDataFrame([(0.5, 0.5, None, None, None, None), (0.5, 0.5, 0.499, 0.501, 100, -100), (0.6, 0.4, 0.5, 0.5, 100, 100)], s)
    assert [(r.best_side, r.best_edge and round(r.best_edge, 3), r.best_p_model) for r in A.edges(d).collect()] == [("AWAY", None, 0.5), ("NO_BET", None, None), ("HOME", 0.1, 0.6)]


def test_upsert_overwrites_with_null_and_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, 5, 7), (2, 6, 8)], "id int, a int, b int")
    u = spark.createDataFrame([(1, None), (3, 9)], "id int, a int")
    once = sinks.upsert(t, u, ["id"])
    assert rows(once) == [(1, None, 7), (2, 6, 8), (3, 9, None)] and rows(sinks.upsert(once, u, ["id"])) == rows(once)
    assert rows(sinks.update(t, u, ["id"])) == [(1, None, 7), (2, 6, 8)]


def test_form_does_not_see_the_game_itself(spark):
    s = "game_id long, game_date date, home_team_id int, away_team_id int, home_runs int, away_runs int"
    import datetime as dt

    g = [(i, dt.date(2024, 4, 1 + i), 1, 2, i, 3) for i in range(6)]
    one = windows.team_form(reshape.team_games(spark.createDataFrame(g, s)))
    g[3] = (*g[3][:4], 40, 3)
    two = windows.team_form(reshape.team_games(spark.createDataFrame(g, s)))
    pick = lambda df: rows(df.where("game_id <= 3").select("game_id", "team_id", *joins.FORM))
    assert pick(one) == pick(two)


def test_names_and_filters(spark):
    assert filters.drop_leaky(["home_sp_id", "win_pct", "Price_x", "lineup_skill", "runs"]) == ["win_pct", "runs"]
    assert filters.pick_first(["a", "b"], ["x", "b"]) == "b"
    with pytest.raises(KeyError):
        filters.require(spark.range(1), ["x"])
    assert tables.month_ranges(2024, season_end="2024-04-15") == [("2024-03-01", "2024-03-31"), ("2024-04-01", "2024-04-15")]
    assert tables.days(spark, "2024-02-28", "2024-03-01").count() == 3
    assert sinks.read_features('{"features": ["a"]}') == ["a"] and sinks.read_features("a\n\nb") == ["a", "b"]


def test_player_ids_are_those_that_a_cast_takes(spark):
    x = ["ID7", "7", " 7 ", "ID 8\t", "ID+5", "ID-5", "ID12x", "x12", "7.0", "1e3", "IDx", "ID", "", "IDID3", "id7", "ID99999999999", "\u0667", "7\n", "ID7\nx", "- 7", None]
    d = spark.createDataFrame([(i,) for i in x], "x string")
    got = d.select("x", feeds._player_id(F.col("x")).alias("a"), F.regexp_replace("x", "^ID", "").try_cast("int").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a for r in got[:6]] == [7, 7, 7, 8, 5, -5]


def test_lineups_of_odd_documents(spark):
    side = '{"team":{"id":%d},"battingOrder":["ID5","IDx",null,"9","ID5"],"players":{"ID5":{"person":{"batSide":{"code":""}},"batSide":{"code":"R"},"position":{"name":" Designated Hitter"}}}}'
    docs = [f'{{"teams":{{"home":{side % 3},"away":{side % 0}}}}}', f'{{"teams":{{"away":{side % 4}}}}}', '{"teams":{"home":{"team":{"id":1},"players":{}}}}', "{", "", None]
    d = spark.createDataFrame([(i, None, x) for i, x in enumerate(docs)], "game_id long, game_date date, doc string")
    rows = sorted(tuple(r)[:1] + tuple(r)[2:] for r in feeds.lineups(d).collect())
    one = lambda g, t, h: [(g, t, h, 1, 5, "R", "Designated"), (g, t, h, 2, 9, None, None), (g, t, h, 3, 5, "R", "Designated")]
    assert rows == one(0, 3, True) + one(1, 4, False)


def test_broken_feeds_give_no_rows(spark):
    d = spark.createDataFrame([("{",), (None,), ('{"dates": [{"date": "x", "games": [{"gamePk": 1}]}]}',)], "doc string")
    assert [tuple(r)[:3] for r in feeds.schedule_games(d).collect()] == [(1, None, None)]
    assert feeds.odds(d.limit(2)).count() == 0


def test_sweep_without_bets(spark):
    d = spark.createDataFrame([(0.02, 1, 0.9, 0.9, 4)], "best_ev double, won int, profit_if_win double, profit double, n_books_ml int")
    assert [(r.ev_threshold, r.n_bets, r.roi) for r in A.ev_sweep(d).collect()][-1] == (0.05, 0, None)
