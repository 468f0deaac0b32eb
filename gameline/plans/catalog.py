"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.functions import baseball as B
from gameline.functions import odds as O
from gameline.functions import prob as P
from gameline.operators import aggregates as A
from gameline.operators import filters as P_
from gameline.operators import joins as J
from gameline.operators import models as M
from gameline.operators import reshape as R
from gameline.operators import sinks as K
from gameline.operators import windows as W
from gameline.plans import feed_queries
from gameline.plans.views import BASE, view, with_views
from gameline.sources import feeds as S
from gameline.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PITCHES = W.PITCHES


def register(name: str, f: Query, sql: str | None = None) -> None:
    """Adds a query, whose shuffles are dealt out by the size of the tables that it reads."""

    @functools.wraps(f)
    def sized(spark: SparkSession, d: str) -> DataFrame:
        T.spread(spark, [f"{d}/{t}.parquet" for t in BASE])
        return f(spark, d)

    QUERIES[name] = sized
    if sql:
        SQL[name] = with_views(sql)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        register(name, f, sql)
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def v(spark, d, *names):
    out = [view(spark, d, n) for n in names]
    return out[0] if len(out) == 1 else out


# --- team form -------------------------------------------------------------------------------------------------------
TEAM_GAMES = """team_games AS (SELECT game_id, game_date, home_team_id AS team_id, true AS is_home, home_runs AS runs_for, away_runs AS runs_against FROM {v_games} WHERE home_runs IS NOT NULL AND away_runs IS NOT NULL
 UNION ALL SELECT game_id, game_date, away_team_id, false, away_runs, home_runs FROM {v_games} WHERE home_runs IS NOT NULL AND away_runs IS NOT NULL),
form AS (SELECT *, CASE WHEN runs_for > runs_against THEN 1 ELSE 0 END AS win FROM team_games),
rolled AS (SELECT *, avg(win) OVER a AS win_pct_30, avg(runs_for) OVER a AS runs_for_30, avg(runs_against) OVER a AS runs_against_30, avg(runs_for) OVER b AS avg_runs_scored_60, avg(runs_against) OVER b AS avg_runs_allowed_60, count(game_id) OVER b AS games_in_window_60 FROM form
 WINDOW a AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""
_FORM = ", ".join(f"round({t}.{c}, 6) AS {s}_{c}" for t, s in (("h", "home"), ("a", "away")) for c in J.FORM[:-1])


@query("u1_team_games", f"WITH {TEAM_GAMES} SELECT game_id, game_date, team_id, is_home, runs_for, runs_against, win FROM form")
def _(spark, d):
    return R.team_games(v(spark, d, "v_games"))


@query("w1_w4_team_form", f"WITH {TEAM_GAMES} SELECT game_id, team_id, "
    f"{', '.join(f'round({c}, 6) AS {c}' for c in J.FORM[:-1])}, games_in_window_60 FROM rolled")
def _(spark, d):
    return rounded(W.team_form(R.team_games(v(spark, d, "v_games"))).select("game_id", "team_id", *J.FORM))


@query("team_form_features", f"WITH {TEAM_GAMES} SELECT g.game_id, g.game_date, g.season, g.home_team_id, g.away_team_id, "
    f"g.home_win, {_FORM}, h.games_in_window_60 AS home_games_in_window_60, a.games_in_window_60 AS away_games_in_window_60 "
    f"FROM {{v_games}} g LEFT JOIN rolled h ON g.game_id = h.game_id AND g.home_team_id = h.team_id LEFT JOIN rolled a ON "
    f"g.game_id = a.game_id AND g.away_team_id = a.team_id WHERE g.home_runs IS NOT NULL AND g.away_runs IS NOT NULL")
def team_form_features(spark, d):
    g = P_.completed(v(spark, d, "v_games"))
    out = J.both_sides(g, W.team_form(R.team_games(g)))
    return rounded(out.select("game_id", "game_date", "season", "home_team_id", "away_team_id",
        "home_win", *[f"{s}_{c}" for s in ("home", "away") for c in J.FORM]))


@query("w5_starter_form", """SELECT game_id, pitcher_id, round(CASE WHEN o > 0 THEN 27.0 * r / o END, 6) AS sp_ra9_last5, round(CASE WHEN n > 0 THEN o / 3.0 / n END, 6) AS sp_ip_per_start_last5 FROM (
 SELECT game_id, pitcher_id, sum(outs_pitched) OVER w AS o, sum(runs_allowed) OVER w AS r, count(game_id) OVER w AS n FROM {v_starts} WHERE outs_pitched IS NOT NULL AND runs_allowed IS NOT NULL WINDOW w AS (PARTITION BY pitcher_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""")
def _(spark, d):
    return rounded(W.starter_form(v(spark, d, "v_starts")))


@query("w6_bullpen_load", """WITH relief AS (SELECT team_id, game_date, sum(outs_pitched) AS outs, sum(CASE WHEN is_high_leverage THEN outs_pitched END) AS hlev FROM {v_appearances} WHERE NOT is_starter GROUP BY ALL), days AS (SELECT DISTINCT team_id, game_date FROM {v_appearances})
 SELECT d.team_id, d.game_date, """ + ", ".join(f"CAST(coalesce(sum(CASE WHEN r.game_date >= d.game_date - {n} THEN {c} END), "
     f"0) AS BIGINT) AS bp_{p}outs_{n}d" for c, p in (("outs", ""), ("hlev", "hlev_")) for n in (1,
     3, 5)) + " FROM days d LEFT JOIN relief r ON r.team_id = d.team_id AND r.game_date BETWEEN d.game_date - 5 AND d.game_date "
     "- 1 GROUP BY ALL")
def _(spark, d):
    a = v(spark, d, "v_appearances")
    return W.bullpen_load(a, a.select("team_id", "game_date"))


# --- odds ------------------------------------------------------------------------------------------------------------
_IMPLIED = "CASE WHEN {0} < 0 THEN -{0} / (-{0} + 100.0) WHEN {0} > 0 THEN 100.0 / ({0} + 100.0) END"
_PROFIT = "CASE WHEN {0} > 0 THEN {0} / 100.0 WHEN {0} < 0 THEN 100.0 / abs({0}) END"
_AMERICAN = ("CAST(round_even(CASE WHEN {0} IS NULL THEN NULL WHEN least(greatest({0}, 1e-6), 1 - 1e-6) >= 0.5 THEN -100.0 * "
    "least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)) ELSE 100.0 * (1 - least(greatest({0}, "
    "1e-6), 1 - 1e-6)) / least(greatest({0}, 1e-6), 1 - 1e-6) END, 0) AS INTEGER)")
_VALID = "(({0} <= -100 OR {0} >= 100) AND abs({0}) <= 2000)"
H, Aw = (_IMPLIED.format(f"CAST({c} AS DOUBLE)") for c in ("home_price", "away_price"))
LATEST = ("latest AS (SELECT game_id, sportsbook, home_price, away_price FROM (SELECT *, row_number() OVER (PARTITION BY "
    "game_id, sportsbook ORDER BY pulled_at DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC) AS rn FROM {v_odds} WHERE market = 'h2h' "
    "AND home_price IS NOT NULL AND away_price IS NOT NULL) WHERE rn = 1)")
CONSENSUS = LATEST + f""", fair AS (SELECT game_id, ({H}) / (({H}) + ({Aw})) AS p FROM latest WHERE {_VALID.format('home_price')} AND {_VALID.format('away_price')}),
market AS (SELECT game_id, median(p) AS p_home_median, count(*) AS n_books_ml FROM fair GROUP BY game_id)"""
CLOSING = ("closing AS (SELECT game_id, home_price, away_price FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY "
    "pulled_at DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC) AS rn FROM {v_odds} WHERE market = 'h2h' AND sportsbook = 'DraftKings' "
    "AND (home_price <= -100 OR home_price >= 100) AND (away_price <= -100 OR away_price >= 100)) WHERE rn = 1)")
TIES = ["pulled_at", "t1", "t2", "t3", "t4"]
VALUES = ["home_price", "away_price"]


def latest_odds(spark, d):
    return W.latest(v(spark, d, "v_odds").where("market = 'h2h' and home_price is not null and away_price is not null"),
        ["game_id", "sportsbook"], TIES, VALUES)


def consensus(spark, d):
    return A.market_consensus(latest_odds(spark, d))


def closing(spark, d):
    o = v(spark, d, "v_odds").where("market = 'h2h' and sportsbook = 'DraftKings'")
    return W.latest(o.where(O.valid_odds(F.col("home_price"), None) & O.valid_odds(F.col("away_price"), None)), ["game_id"], TIES, VALUES)


@query("f1_f5_odds_functions", f"SELECT game_id, t1, t2, t3, t4, round({H}, 6) AS implied, {_AMERICAN.format('(' + H + ')')} AS "
    f"back, round({_PROFIT.format('home_price')}, 6) AS profit, round(0.55 * ({_PROFIT.format('home_price')}) - 0.45, 6) AS ev, "
    f"round(({H}) / (({H}) + ({Aw})), 6) AS fair, coalesce({_VALID.format('home_price')}, false) AS valid FROM {{v_odds}}")
def _(spark, d):
    o, a = F.col("home_price"), F.col("away_price")
    return rounded(v(spark, d, "v_odds").select("game_id", "t1", "t2", "t3", "t4", O.american_to_implied(o).alias("implied"),
        O.prob_to_american(O.american_to_implied(o)).alias("back"), O.profit_if_win(o).alias("profit"),
        (0.55 * O.profit_if_win(o) - 0.45).alias("ev"), O.vig_free(o, a).alias("fair"), O.valid_odds(o).alias("valid"))).withColumn("t4",
        F.col("t4"))


@query("w7a_latest_odds", f"WITH {LATEST} SELECT * FROM latest")
def _(spark, d):
    return latest_odds(spark, d)


@query("w7b_closing_odds", f"WITH {CLOSING} SELECT * FROM closing")
def _(spark, d):
    return closing(spark, d)


@query("a1_market_consensus", f"WITH {CONSENSUS} SELECT game_id, round(p_home_median, 6) AS p_home_median, n_books_ml, "
    f"{_AMERICAN.format('p_home_median')} AS home_price_close_consensus, {_AMERICAN.format('(1 - p_home_median)')} AS "
    f"away_price_close_consensus FROM market")
def _(spark, d):
    return rounded(consensus(spark, d))


@query("p6_book_filter", "SELECT game_id, sportsbook, count(*) AS n FROM {v_odds} WHERE lower(sportsbook) IN ('draftkings', 'book_3') GROUP BY ALL")
def _(spark, d):
    return P_.books(v(spark, d, "v_odds"), ["DRAFTKINGS", "Book_3"]).groupBy("game_id", "sportsbook").agg(F.count(F.lit(1)).alias("n"))


@query("j13_odds_game_id", "WITH g AS (SELECT game_date, home_team_name, away_team_name, min(game_id) AS game_id FROM {v_games} "
    "GROUP BY ALL), o AS (SELECT v.game_date, v.home_team_name, v.away_team_name, v.game_id AS asked FROM {v_games} v UNION ALL "
    "SELECT game_date, 'nobody', away_team_name, game_id FROM {v_games} WHERE game_id % 10 = 0) SELECT o.asked, g.game_id FROM "
    "o LEFT JOIN g USING (game_date, home_team_name, away_team_name)")
def _(spark, d):
    g = v(spark, d, "v_games")
    o = g.select("game_date", F.col("home_team_name").alias("home_team"), F.col("away_team_name").alias("away_team"), F.col("game_id").alias("asked"))
    o = o.unionByName(g.where("game_id % 10 = 0").select("game_date", F.lit("nobody").alias("home_team"),
        F.col("away_team_name").alias("away_team"), F.col("game_id").alias("asked")))
    return J.odds_game_id(o.withColumn("game_id", F.lit(None).cast("long")), g).select("asked", "game_id")


# --- probabilities ---------------------------------------------------------------------------------------------------
SKELLAM = """rates AS (SELECT DISTINCT home_runs_pred AS h, away_runs_pred AS a FROM {v_run_preds} WHERE home_runs_pred IS NOT NULL),
mass AS (SELECT h, a, k, exp(-h + k * ln(h) - lgamma(k + 1)) AS ph, exp(-a + k * ln(a) - lgamma(k + 1)) AS pa FROM rates, (SELECT CAST(unnest(range(0, 151)) AS DOUBLE) AS k)),
cum AS (SELECT *, coalesce(sum(pa) OVER (PARTITION BY h, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(ph) OVER (PARTITION BY h, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_h FROM mass),
skellam AS (SELECT h, a, sum(ph * below) AS win, sum(pa * below_h) AS lose, sum(ph * pa) AS tie FROM cum GROUP BY h, a)"""


@query("f6_f7_f20_win_probability", f"WITH {SKELLAM} SELECT r.game_id, round(s.win + s.tie / 2, 6) AS p_home_win_poisson, "
    f"round(s.tie, 6) AS p_tie_poisson, round(s.win, 6) AS strict, round(s.lose, 6) AS swapped FROM {{v_run_preds}} r LEFT JOIN "
    f"skellam s ON r.home_runs_pred = s.h AND r.away_runs_pred = s.a")
def _(spark, d):
    h, a = F.col("home_runs_pred"), F.col("away_runs_pred")
    s = v(spark, d, "v_run_preds").select("game_id", P.win_with_half_tie(h, a).alias("s"), P.win_strict(h,
        a).alias("strict"), P.inference_win(h, a).alias("swapped"))
    return rounded(s.select("game_id", F.col("s.p").alias("p_home_win_poisson"), F.col("s.tie").alias("p_tie_poisson"), "strict", "swapped"))


@query("f8_normal_win", "WITH x AS (SELECT game_id, (0.5 - (home_runs_pred - away_runs_pred)) / sqrt(home_runs_pred + "
    "away_runs_pred) AS z FROM {v_run_preds}), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM x), n AS (SELECT *, "
    "exp(-z * z / 2) / sqrt(2 * pi()) * (t * 0.319381530 - 0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3) - 1.821255978 * "
    "pow(t, 4) + 1.330274429 * pow(t, 5)) AS tail FROM t) SELECT game_id, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, "
    "6) AS p FROM n")
def _(spark, d):
    return rounded(v(spark, d, "v_run_preds").select("game_id", P.win_normal(F.col("home_runs_pred"), F.col("away_runs_pred")).alias("p")))


def judged(spark, d):
    """Completed games with a model and a market probability, the label and a split by date."""
    h, a = F.col("home_runs_pred"), F.col("away_runs_pred")
    p = v(spark, d, "v_run_preds").select("game_id", P.win_with_half_tie(h, a)["p"].alias("p_model"))
    g = P_.completed(v(spark, d, "v_games")).withColumn("y", P.home_win_label(F.col("home_runs"), F.col("away_runs")))
    m = consensus(spark, d).select("game_id", "p_home_median", "n_books_ml")
    j = P_.with_both(g.join(p, "game_id").join(m, "game_id", "left"), "p_model", "p_home_median")
    return P_.split_by_date(j, "1996-12-31", "1997-12-31", "1998-12-31")


JUDGED = (f"{SKELLAM}, {CONSENSUS}, judged AS (SELECT g.game_id, s.win + s.tie / 2 AS p_model, m.p_home_median, m.n_books_ml, "
    f"CASE WHEN g.home_runs > g.away_runs THEN 1 ELSE 0 END AS y, CASE WHEN g.game_date <= DATE '1996-12-31' THEN 'train' WHEN "
    f"g.game_date <= DATE '1997-12-31' THEN 'val' ELSE 'test' END AS split FROM {{v_games}} g JOIN {{v_run_preds}} r USING "
    f"(game_id) JOIN skellam s ON r.home_runs_pred = s.h AND r.away_runs_pred = s.a JOIN market m USING (game_id) WHERE "
    f"g.home_runs IS NOT NULL AND g.away_runs IS NOT NULL AND g.game_date <= DATE '1998-12-31')")
_CLIP = "least(greatest({0}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
_LOSS = f"-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))"


@query("a5_blend_losses", f"WITH {JUDGED} SELECT w, round(avg({_LOSS.format('(w * p_model + (1 - w) * p_home_median)')}), 6) AS "
    f"loss FROM judged, (SELECT unnest(range(0, 101)) / 100.0 AS w) WHERE split = 'val' GROUP BY w".replace("/ 100.0 AS w",
    "/ CAST(100 AS DOUBLE) AS w"))
def _(spark, d):
    return rounded(A.blend_losses(judged(spark, d).where("split = 'val'"), "p_model", "p_home_median", "y"))


@query("a5_t4_best_weight", f"WITH {JUDGED}, l AS (SELECT w, "
    f"round(avg({_LOSS.format('(w * p_model + (1 - w) * p_home_median)')}), 12) AS loss FROM judged, (SELECT unnest(range(0, "
    f"101)) / CAST(100 AS DOUBLE) AS w) WHERE split = 'val' GROUP BY w) SELECT w FROM l ORDER BY loss, w LIMIT 1")
def _(spark, d):
    return A.best_weight(A.blend_losses(judged(spark, d).where("split = 'val'"), "p_model", "p_home_median", "y"))


@query("f21_blend", f"WITH {JUDGED} SELECT game_id, round(0.35 * p_model + 0.65 * p_home_median, 6) AS p_home_blend FROM judged WHERE split = 'test'")
def _(spark, d):
    j = judged(spark, d).where("split = 'test'")
    return rounded(j.select("game_id", P.blend(0.35, F.col("p_model"), F.col("p_home_median")).alias("p_home_blend")))


_AUC = ("(SELECT split, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM "
    "(SELECT split, y, rank() OVER (PARTITION BY split ORDER BY round(p_model, 9)) + (count(*) OVER (PARTITION BY split, "
    "round(p_model, 9)) - 1) / 2.0 AS r FROM judged) GROUP BY split)")


@query("a7_w9b_binary_report", f"WITH {JUDGED}, au AS {_AUC} SELECT j.split, count(*) AS n, "
    f"round(avg({_LOSS.format('p_model')}), 6) AS log_loss, round(avg((p_model - y) * (p_model - y)), 6) AS brier, "
    f"round(avg(p_model), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(any_value(au.auc), 6) AS auc FROM judged j JOIN au ON "
    f"j.split = au.split GROUP BY j.split")
def _(spark, d):
    return rounded(A.binary_report(judged(spark, d).withColumn("p_model", F.round("p_model", 9)), "p_model", "y"))


REGRESSION_SQL = ("WITH x AS (SELECT CASE WHEN g.game_date <= DATE '1996-12-31' THEN 'train' WHEN g.game_date <= DATE "
    "'1997-12-31' THEN 'val' ELSE 'test' END AS split, g.home_runs AS y, r.home_runs_pred AS p FROM {v_games} g JOIN "
    "{v_run_preds} r USING (game_id) WHERE g.home_runs IS NOT NULL AND r.home_runs_pred IS NOT NULL AND g.game_date <= DATE "
    "'1998-12-31') SELECT split, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, "
    "round(avg(y), 6) AS mean_true, round(avg(p), 6) AS mean_pred FROM x GROUP BY split")


@query("a4_regression_report", REGRESSION_SQL)
def _(spark, d):
    g = P_.with_target(v(spark, d, "v_games").join(v(spark, d, "v_run_preds"), "game_id").dropna(subset=["home_runs_pred"]), "home_runs")
    return rounded(A.regression_report(P_.split_by_date(g, "1996-12-31", "1997-12-31", "1998-12-31"), "home_runs", "home_runs_pred"))


@query("a8_coverage", "SELECT count(*) AS n, " + ", ".join(f"{'' if f == 'count' else 'round('}{f}({c}){'' if f == 'count' else ', 6)'} "
    f"AS {c}_{f}" for c in ("home_runs_pred", "away_runs_pred") for f in ("count", "avg", "min",
    "max")) + " FROM {v_run_preds}")
def _(spark, d):
    return rounded(A.coverage(v(spark, d, "v_run_preds"), ["home_runs_pred", "away_runs_pred"]))


# --- backtest --------------------------------------------------------------------------------------------------------
BETS = (f"{SKELLAM}, {CONSENSUS}, {CLOSING}, b AS (SELECT g.game_id, s.win + s.tie / 2 AS p_home, c.home_price, c.away_price, "
    f"m.n_books_ml, CASE WHEN g.home_runs > g.away_runs THEN 1 ELSE 0 END AS home_win FROM {{v_games}} g JOIN {{v_run_preds}} r "
    f"USING (game_id) JOIN skellam s ON r.home_runs_pred = s.h AND r.away_runs_pred = s.a JOIN closing c USING (game_id) JOIN "
    f"market m USING (game_id) WHERE g.home_runs IS NOT NULL AND g.away_runs IS NOT NULL AND m.n_books_ml >= 3), e AS (SELECT "
    f"*, p_home * ({_PROFIT.format('home_price')}) - (1 - p_home) AS ev_home, (1 - p_home) * ({_PROFIT.format('away_price')}) - "
    f"p_home AS ev_away FROM b), g1 AS (SELECT *, CASE WHEN ev_home >= ev_away THEN 'HOME' ELSE 'AWAY' END AS best_side, "
    f"greatest(ev_home, ev_away) AS best_ev, CASE WHEN ev_home >= ev_away THEN home_price ELSE away_price END AS best_odds FROM "
    f"e), bets AS (SELECT *, CAST(CASE WHEN best_side = 'HOME' THEN home_win = 1 ELSE home_win = 0 END AS INTEGER) AS won, "
    f"{_PROFIT.format('best_odds')} AS profit_if_win FROM g1), graded AS (SELECT *, CASE WHEN won = 1 THEN profit_if_win ELSE "
    f"-1.0 END AS profit FROM bets)")


def bets(spark, d):
    h, a = F.col("home_runs_pred"), F.col("away_runs_pred")
    known = v(spark, d, "v_run_preds").where(h.isNotNull() & a.isNotNull())  # asked of the rates, so that the sums run once
    p = known.select("game_id", P.win_with_half_tie(h, a)["p"].alias("p_home"))
    features = p.join(consensus(spark, d).select("game_id", "n_books_ml"),
        "game_id").where(P_.enough_books(F.col("n_books_ml"), 3, strict=True))
    j = J.with_closing(features, P_.completed(v(spark, d, "v_games")), closing(spark, d))
    return A.graded_bets(j.withColumn("home_win", P.home_win_label(F.col("home_runs"), F.col("away_runs"))))


@query("j4_f23_graded_bets", f"WITH {BETS} SELECT game_id, round(ev_home, 6) AS ev_home, round(ev_away, 6) AS ev_away, "
    f"best_side, best_odds, won, round(profit, 6) AS profit FROM graded")
def _(spark, d):
    return rounded(bets(spark, d).select("game_id", "ev_home", "ev_away", "best_side", "best_odds", "won", "profit"))


@query("a6_ev_sweep", f"WITH {BETS} SELECT t AS ev_threshold, count(game_id) AS n_bets, round(avg(profit), 6) AS roi, "
    f"round(avg(won), 6) AS win_rate, round(avg(best_ev), 6) AS avg_ev, round(avg(profit_if_win), 6) AS avg_profit_if_win, "
    f"round(avg(n_books_ml), 6) AS avg_books FROM (VALUES (CAST(0 AS DOUBLE)), (0.005), (0.01), (0.02), (0.03), (0.05), (90)) "
    f"AS x(t) LEFT JOIN graded ON round(best_ev, 9) >= t GROUP BY t")
def _(spark, d):
    b = bets(spark, d).withColumn("best_ev", F.round("best_ev", 9))  # as other engines differ in the last digit
    return rounded(A.ev_sweep(b, (*A.EV_THRESHOLDS, 90.0)))


# --- rollups and lineups ---------------------------------------------------------------------------------------------
MIX = "mixd AS (SELECT pitcher, game_date, " + ", ".join(f"sum(CASE WHEN upper(pitch_type) = '{c}' THEN 1 ELSE 0 END) AS {c}" for c in PITCHES) + (", count(*) AS n FROM {v_pitches} WHERE "
    "pitch_type IS NOT NULL GROUP BY ALL), mix AS (SELECT pitcher AS pitcher_id, game_date AS as_of_date, 365 AS window_days, ") + ", ".join(f"sum({c}) OVER w / CAST(sum(n) OVER w "
    f"AS DOUBLE) AS pct_{c.lower()}" for c in PITCHES) + (" FROM mixd WINDOW w AS (PARTITION BY pitcher ORDER BY game_date RANGE "
    "BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW))")
SKILL = "skilld AS (SELECT batter, game_date, " + ", ".join(f"sum(CASE WHEN upper(pitch_type) = '{c}' THEN woba_value END) AS "
    f"{c}_v, sum(CASE WHEN upper(pitch_type) = '{c}' THEN woba_denom END) AS {c}_d" for c in PITCHES) + (" FROM {v_pitches} WHERE pitch_type IS "
    "NOT NULL GROUP BY ALL), skill AS (SELECT batter AS batter_id, game_date AS as_of_date, 365 AS window_days, ") + ", ".join(f"CASE WHEN sum({c}_d) OVER w <> 0 THEN "
    f"sum({c}_v) OVER w / sum({c}_d) OVER w END AS skill_{c.lower()}" for c in PITCHES) + (" FROM skilld WINDOW w AS (PARTITION BY "
    "batter ORDER BY game_date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW))")


@query("w10_pitch_mix", f"WITH {MIX} SELECT pitcher_id, as_of_date, window_days, {', '.join(f'round({c}, 6) AS {c}' for c in A.MIXES)} FROM mix")
def _(spark, d):
    return rounded(W.pitch_mix(v(spark, d, "v_pitches")))


@query("w11_batter_skill", f"WITH {SKILL} SELECT batter_id, as_of_date, window_days, "
    f"{', '.join(f'round({c}, 9) AS {c}' for c in A.SKILLS)} FROM skill")
def _(spark, d):
    return rounded(W.batter_skill(v(spark, d, "v_pitches")), 9)


def game_range(spark, d) -> tuple[str, str]:
    """The first and the last date of the games: the range of a run over all of them."""
    r = v(spark, d, "v_games").agg(F.min("game_date").alias("a"), F.max("game_date").alias("b")).first()
    return (str(r["a"]), str(r["b"])) if r["a"] else ("1900-01-01", "1900-01-01")


def lines(spark, d):
    return P_.top_of_order(v(spark, d, "v_lineups"), 5).select("game_id", "game_date", "is_home",
        "batting_order", F.col("player_id").cast("long").alias("batter_id"))


def batters(spark, d):
    return J.as_of(T.stored(lines(spark, d), "lines"), T.stored(W.batter_skill(v(spark, d, "v_pitches")), "skill"), "batter_id", 365, *game_range(spark, d))


BATTERS = (f"{SKILL}, batters AS (SELECT l.game_id, l.is_home, l.batting_order, {', '.join('s.' + c for c in A.SKILLS)} FROM "
    f"(SELECT *, CAST(player_id AS BIGINT) AS batter_id, game_date - 1 AS asof FROM {{v_lineups}} WHERE batting_order BETWEEN 1 "
    f"AND 5) l ASOF LEFT JOIN skill s ON l.batter_id = s.batter_id AND l.asof >= s.as_of_date)")
VECTORS = BATTERS + (f", vec AS (SELECT game_id, is_home, {', '.join(f'avg({c}) AS {c}' for c in A.SKILLS)} FROM batters WHERE "
    f"{' AND '.join(f'{c} IS NOT NULL' for c in A.SKILLS)} GROUP BY ALL)")


@query("j11_as_of_batters", f"WITH {BATTERS} SELECT game_id, is_home, batting_order, "
    f"{', '.join(f'round({c}, 9) AS {c}' for c in A.SKILLS)} FROM batters")
def _(spark, d):
    return rounded(batters(spark, d).select("game_id", "is_home", "batting_order", *A.SKILLS), 9)


@query("a3_lineup_vectors", f"WITH {VECTORS} SELECT k.game_id, k.is_home, "
    f"{', '.join(f'round({c}, 9) AS {c}' for c in A.SKILLS)}, round(({' + '.join(A.SKILLS)}) / 8, 9) AS lineup_skill FROM "
    f"(SELECT DISTINCT game_id, is_home FROM batters) k LEFT JOIN vec USING (game_id, is_home)")
def _(spark, d):
    return rounded(A.lineup_vectors(batters(spark, d)), 9)


def home_starters(spark, d):
    g = J.with_starters(v(spark, d, "v_games"), v(spark, d, "v_starters")).select("game_id",
        "game_date", F.col("home_sp_id").cast("long").alias("pitcher_id"))
    return g.withColumn("pitcher_id", F.col("pitcher_id") % 100)


def starter_mix(spark, d):
    return J.as_of(T.stored(home_starters(spark, d), "starters"), T.stored(W.pitch_mix(v(spark, d, "v_pitches")), "mix"), "pitcher_id", 365, *game_range(spark, d))


STARTER_MIX = (f"{MIX}, sm AS (SELECT l.game_id, {', '.join('m.' + c for c in A.MIXES)} FROM (SELECT g.game_id, g.game_date - 1 "
    f"AS asof, CAST(s.home_sp_id % 100 AS BIGINT) AS pitcher_id FROM {{v_games}} g LEFT JOIN {{v_starters}} s USING (game_id)) "
    f"l ASOF LEFT JOIN mix m ON l.pitcher_id = m.pitcher_id AND l.asof >= m.as_of_date)")


@query("j11_as_of_starters", f"WITH {STARTER_MIX} SELECT game_id, {', '.join(f'round({c}, 6) AS {c}' for c in A.MIXES)} FROM sm")
def _(spark, d):
    return rounded(starter_mix(spark, d).select("game_id", *A.MIXES))


@query("f17_f24_matchup", f"WITH {VECTORS}, {STARTER_MIX} SELECT sm.game_id, "
    f"round({' + '.join(f'{m} * a.{s}' for m, s in zip(A.MIXES, A.SKILLS))}, 8) AS away_vs_home_sp_matchup, "
    f"round(({' + '.join('h.' + s for s in A.SKILLS)}) / 8 - ({' + '.join('a.' + s for s in A.SKILLS)}) / 8, 8) AS "
    f"lineup_skill_diff FROM sm LEFT JOIN vec h ON sm.game_id = h.game_id AND h.is_home LEFT JOIN vec a ON sm.game_id = "
    f"a.game_id AND NOT a.is_home")
def _(spark, d):
    vec = A.lineup_vectors(batters(spark, d))
    side = lambda flag, c, name: F.max(F.when(F.col("is_home") == flag, F.col(c))).alias(name)
    both = vec.groupBy("game_id").agg(side(True, "lineup_skill", "h_skill"), side(False, "lineup_skill", "a_skill"), *[side(False, c, f"a_{c}") for c in A.SKILLS])
    j = starter_mix(spark, d).join(both, "game_id", "left")
    dot = B.dot_or_null([F.col(c) for c in A.MIXES], [F.col(f"a_{c}") for c in A.SKILLS])
    out = rounded(j.select("game_id", dot.alias("away_vs_home_sp_matchup"), (F.col("h_skill") - F.col("a_skill")).alias("lineup_skill_diff")), 8)
    return out.withColumn("lineup_skill_diff", F.col("lineup_skill_diff") + 0.0)  # no negative zero


# --- joins that pick games ---------------------------------------------------------------------------------------------
@query("j3_starters", "SELECT g.game_id, s.home_sp_id, s.away_sp_id FROM {v_games} g LEFT JOIN {v_starters} s USING (game_id)")
def _(spark, d):
    return J.with_starters(v(spark, d, "v_games"), v(spark, d, "v_starters")).select("game_id", "home_sp_id", "away_sp_id")


@query("j7_without_starters", "SELECT game_id FROM {v_games} WHERE game_id NOT IN (SELECT game_id FROM {v_starters})")
def _(spark, d):
    return J.without_starters(v(spark, d, "v_games"), v(spark, d, "v_starters")).select("game_id")


@query("j8_without_appearances", "SELECT g.game_id FROM {v_games} g JOIN {v_starters} s USING (game_id) WHERE home_runs IS NOT "
    "NULL AND NOT EXISTS (SELECT 1 FROM {v_appearances} a WHERE a.game_id = g.game_id AND a.outs_pitched > 4)")
def _(spark, d):
    return J.without_appearances(v(spark, d, "v_games"), v(spark, d, "v_starters"), v(spark, d,
        "v_appearances").where("outs_pitched > 4")).select("game_id")


@query("j9_lacking_starts", "SELECT g.game_id FROM {v_games} g JOIN {v_starters} s USING (game_id) WHERE g.home_runs IS NOT "
    "NULL AND (NOT EXISTS (SELECT 1 FROM {v_starts} t WHERE t.game_id = g.game_id AND t.pitcher_id = s.home_sp_id) OR NOT "
    "EXISTS (SELECT 1 FROM {v_starts} t WHERE t.game_id = g.game_id AND t.pitcher_id = s.away_sp_id))")
def _(spark, d):
    return J.lacking_starts(v(spark, d, "v_games"), v(spark, d, "v_starters"), v(spark, d, "v_starts")).select("game_id")


@query("j10_lacking_context", "SELECT DISTINCT g.game_id FROM {v_games} g JOIN {v_appearances} a USING (game_id) WHERE "
    "g.game_type = 'R' AND NOT a.is_starter AND (a.inning_entered IS NULL OR a.outs_on_entry IS NULL OR a.score_diff_on_entry "
    "IS NULL OR a.is_high_leverage IS NULL)")
def _(spark, d):
    return J.lacking_context(v(spark, d, "v_games"), v(spark, d, "v_appearances")).select("game_id")


@query("p1_p2_p4_games", "SELECT game_id, game_date, game_type FROM {v_games} WHERE home_runs IS NOT NULL AND away_runs IS NOT "
    "NULL AND game_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND game_type IN ('R', 'P')")
def _(spark, d):
    g = T.read_range(P_.of_types(P_.completed(v(spark, d, "v_games")), "R", "P"), "1995-01-01", "1996-06-30", ["game_type"])
    return g


@query("p11_f22_split", "SELECT game_id, CASE WHEN home_runs > away_runs THEN 1 ELSE 0 END AS y, CASE WHEN game_date <= DATE "
    "'1996-12-31' THEN 'train' WHEN game_date <= DATE '1997-12-31' THEN 'val' ELSE 'test' END AS split FROM {v_games} WHERE "
    "game_date <= DATE '1998-06-30'")
def _(spark, d):
    g = v(spark, d, "v_games").withColumn("y", P.home_win_label(F.col("home_runs"), F.col("away_runs")))
    return P_.split_by_date(g, "1996-12-31", "1997-12-31", "1998-06-30").select("game_id", "y", "split")


# --- weather -----------------------------------------------------------------------------------------------------------
HOUR = ("hourly AS (SELECT venue_id, hour, temp_c * 9.0 / 5.0 + 32.0 AS temp_f FROM {v_hourly}), near AS (SELECT c.game_id, "
    "h.hour, h.temp_f, row_number() OVER (PARTITION BY c.game_id ORDER BY abs(epoch(h.hour) - epoch(date_trunc('hour', "
    "c.commence_time))), h.hour) AS rn FROM {v_commence} c JOIN hourly h ON c.venue_id = h.venue_id AND h.hour BETWEEN "
    "date_trunc('hour', c.commence_time - INTERVAL 3 HOUR) AND date_trunc('hour', c.commence_time + INTERVAL 3 HOUR))")


@query("j12_nearest_hour", f"WITH {HOUR} SELECT game_id, hour, round(temp_f, 6) AS temp_f FROM near WHERE rn = 1")
def _(spark, d):
    h = v(spark, d, "v_hourly").select("venue_id", "hour", B.c_to_f(F.col("temp_c")).alias("temp_f"))
    return rounded(J.nearest_hour(v(spark, d, "v_commence"), h).select("game_id", "hour", "temp_f"))


@query("a2_j14_commence", "WITH o AS (SELECT game_id, min(commence_time) AS o FROM {v_odds} WHERE game_id % 3 <> 0 GROUP BY "
    "game_id), s AS (SELECT game_id, min(pulled_at) AS s FROM {v_odds} WHERE game_id % 5 <> 0 GROUP BY game_id) SELECT "
    "g.game_id, coalesce(o, s) AS commence_time FROM {v_games} g LEFT JOIN o USING (game_id) LEFT JOIN s USING (game_id)")
def _(spark, d):
    o = v(spark, d, "v_odds")
    s = A.earliest_commence(o.where("game_id % 5 <> 0").withColumn("commence_time", F.col("pulled_at")))
    return J.commence_times(v(spark, d, "v_games"), A.earliest_commence(o.where("game_id % 3 <> 0")), s)


@query("j15_located", "SELECT c.game_id, n_nationkey + 0.5 AS lat, n_nationkey - 0.5 AS lon FROM {v_commence} c JOIN {nation} "
    "ON c.venue_id = n_nationkey WHERE n_nationkey % 7 <> 0".replace("0.5", "CAST(0.5 AS DOUBLE)"))
def _(spark, d):
    n = v(spark, d, "nation").select(F.col("n_nationkey").alias("venue_id"), F.when(F.col("n_nationkey") % 7 != 0,
        F.col("n_nationkey") + 0.5).alias("lat"), (F.col("n_nationkey") - 0.5).alias("lon"))
    return J.located(v(spark, d, "v_commence"), n).select("game_id", "lat", "lon")


# --- sinks -------------------------------------------------------------------------------------------------------------
NEW = ("upd AS (SELECT CASE WHEN game_id % 7 = 0 THEN -game_id ELSE game_id END AS game_id, CASE WHEN game_id % 4 = 0 THEN NULL "
    "ELSE away_runs END AS home_runs, 99 AS venue_id FROM {v_games} WHERE game_id % 2 = 0)")


def _updates(spark, d):
    i = F.col("game_id")
    return v(spark, d, "v_games").where("game_id % 2 = 0").select(F.when(i % 7 == 0, -i).otherwise(i).alias("game_id"),
        F.when(i % 4 != 0, F.col("away_runs")).alias("home_runs"), F.lit(99).alias("venue_id"))


@query("k1_upsert", f"WITH {NEW} SELECT coalesce(g.game_id, u.game_id) AS game_id, CASE WHEN u.game_id IS NOT NULL THEN "
    f"u.home_runs ELSE g.home_runs END AS home_runs, CASE WHEN g.game_id IS NOT NULL THEN g.venue_id ELSE u.venue_id END AS "
    f"venue_id FROM {{v_games}} g FULL JOIN upd u ON g.game_id = u.game_id")
def _(spark, d):
    return K.upsert(v(spark, d, "v_games").select("game_id", "home_runs", "venue_id"), _updates(spark, d), ["game_id"], ["home_runs"])


@query("k2_update", f"WITH {NEW} SELECT g.game_id, CASE WHEN u.game_id IS NOT NULL THEN u.home_runs ELSE g.home_runs END AS "
    f"home_runs, u.venue_id AS new_venue FROM {{v_games}} g LEFT JOIN upd u ON g.game_id = u.game_id")
def _(spark, d):
    return K.update(v(spark, d, "v_games").select("game_id", "home_runs"), _updates(spark, d).withColumnRenamed("venue_id", "new_venue"), ["game_id"])


_ROW_ID = ("md5(concat_ws('|', CAST(game_date AS STRING), CAST(game_pk AS STRING), CAST(at_bat_number AS STRING), "
    "CAST(pitch_number AS STRING), CAST(pitcher AS STRING), coalesce(CAST(CASE WHEN batter % 50 <> 0 THEN batter END AS "
    "STRING), '<NA>')))")


@query("s10_f14_k3_pitches", f"SELECT DISTINCT {_ROW_ID} AS row_id, game_date, game_pk, pitcher, CASE WHEN batter % 50 <> 0 "
    f"THEN batter END AS batter FROM {{v_pitches}}")
def _(spark, d):
    p = v(spark, d, "v_pitches").select(*[F.col(c).cast("string") for c in ("game_date", "game_pk",
        "at_bat_number", "pitch_number", "pitcher", "pitch_type")], F.when(F.col("batter") % 50 != 0,
        F.col("batter").cast("string")).otherwise("x").alias("batter"))
    n = S.normalized_pitches(p)
    old = n.where("game_pk % 2 = 0").dropDuplicates(["row_id"])
    return K.insert_absent(old, n, "row_id").select("row_id", "game_date", "game_pk", "pitcher", "batter")


@query("k4_k6_stamped", "SELECT TIMESTAMP '2024-04-01 12:00:00' AS as_of_ts, game_id, CAST(NULL AS DOUBLE) AS ev_home FROM {v_games}")
def _(spark, d):
    return K.stamped(K.ensure_columns(v(spark, d, "v_games").select("game_id"), {"ev_home": "double", "game_id": "long"}), "2024-04-01 12:00:00")


# --- reshape, models, predictions ----------------------------------------------------------------------------------------
@query("u2_two_rows", "SELECT game_id, 1 AS is_home, home_team_id AS team_team_id, away_team_id AS opp_team_id, away_runs AS "
    "opp_runs, home_runs AS target_runs FROM {v_games} WHERE home_runs IS NOT NULL UNION ALL SELECT game_id, 0, away_team_id, "
    "home_team_id, home_runs, away_runs FROM {v_games} WHERE away_runs IS NOT NULL")
def _(spark, d):
    g = v(spark, d, "v_games").drop("home_win")
    return R.two_rows(g, target=True).select("game_id", "is_home", "team_team_id", "opp_team_id", "opp_runs", "target_runs")


@query("a9_mean_by_side", "SELECT is_home, round(avg(t), 6) AS mean_target_runs FROM (SELECT 1 AS is_home, home_runs AS t FROM "
    "{v_games} UNION ALL SELECT 0, away_runs FROM {v_games}) WHERE t IS NOT NULL GROUP BY is_home")
def _(spark, d):
    return rounded(A.mean_by_side(R.two_rows(v(spark, d, "v_games").drop("home_win"), target=True), "target_runs"))


@query("u3_f19_game_predictions", "SELECT game_id, CAST(greatest(home_runs_pred - 3, 0.1) AS DOUBLE) AS home_runs_pred, "
    "CAST(greatest(away_runs_pred - 3, 0.1) AS DOUBLE) AS away_runs_pred FROM {v_run_preds} WHERE home_runs_pred IS NOT NULL".replace("CAST(greatest",
    "round(CAST(greatest").replace("0.1) AS DOUBLE)", "0.1) AS DOUBLE), 6)"))
def _(spark, d):
    r = v(spark, d, "v_run_preds").where("home_runs_pred is not null")
    rows = R.two_rows(r).select("game_id", "is_home", F.col("team_runs_pred").alias("pred_runs"))
    g = R.game_predictions(rows).withColumns({"home_runs_pred": F.col("home_runs_pred") - 3, "away_runs_pred": F.col("away_runs_pred") - 3})
    return rounded(M.run_columns(g, "home_runs_pred", "away_runs_pred").select("game_id", "home_runs_pred", "away_runs_pred"))


def _trainable(spark, d):
    g = P_.completed(v(spark, d, "v_games"))
    f = J.both_sides(g, W.team_form(R.team_games(g)))
    f = f.withColumn("y", P.home_win_label(F.col("home_runs"), F.col("away_runs")))
    names = [f"{s}_{c}" for s in ("home", "away") for c in J.FORM]
    # stored, as every pass of a fit reads them
    return T.stored(P_.split_by_date(f, "1996-12-31", "1997-12-31", "1998-12-31"), "trainable"), names


@query("m1_m2_run_model")
def _(spark, d):
    f, names = _trainable(spark, d)
    out = f
    for side in ("home", "away"):
        model = M.fit_runs(f.where("split = 'train'").withColumn("target", F.col(f"{side}_runs") + 0.0), names, "target", prediction=f"{side}_p")
        out = M.score(out, model, names)
    return M.run_columns(out, "home_p", "away_p").select("game_id", "split", "home_runs_pred", "away_runs_pred", "total_runs_pred", "run_diff_pred")


PRED = (f"{SKELLAM}, {CONSENSUS}, pred AS (SELECT g.game_id, coalesce(t.team_name, CAST(g.home_team_id AS STRING)) AS home_team, "
    f"s.lose AS p_home_model, 1 - s.lose AS p_away_model, m.p_home_median AS ph, 1 - m.p_home_median AS pa, m.n_books_ml AS "
    f"n_books, {_AMERICAN.format('m.p_home_median')} AS hp, {_AMERICAN.format('(1 - m.p_home_median)')} AS ap FROM {{v_games}} "
    f"g JOIN {{v_run_preds}} r USING (game_id) LEFT JOIN {{v_teams}} t ON g.home_team_id = t.mlb_team_id LEFT JOIN skellam s ON "
    f"r.home_runs_pred = s.h AND r.away_runs_pred = s.a LEFT JOIN market m ON m.game_id = g.game_id WHERE r.home_runs_pred IS "
    f"NOT NULL), edge AS (SELECT *, p_home_model - ph AS eh, p_away_model - pa AS ea FROM pred), best AS (SELECT *, CASE WHEN "
    f"eh IS NULL THEN 'AWAY' WHEN greatest(eh, ea) < 0.01 THEN 'NO_BET' WHEN eh >= ea THEN 'HOME' ELSE 'AWAY' END AS best_side "
    f"FROM edge), final AS (SELECT *, CASE WHEN best_side <> 'NO_BET' AND eh IS NOT NULL THEN greatest(eh, ea) END AS "
    f"best_edge, CASE best_side WHEN 'HOME' THEN p_home_model WHEN 'AWAY' THEN p_away_model END AS best_p_model FROM best)")


def predictions(spark, d):
    r = v(spark, d, "v_run_preds").where("home_runs_pred is not null")
    g = J.with_names(v(spark, d, "v_games"), r, v(spark, d, "v_teams"))
    m = consensus(spark, d).select("game_id", F.col("p_home_median").alias("p_home_market_median"),
        (1 - F.col("p_home_median")).alias("p_away_market_median"), F.col("n_books_ml").alias("n_books"),
        F.col("home_price_close_consensus").alias("home_price_consensus"), F.col("away_price_close_consensus").alias("away_price_consensus"))
    p = P.inference_win(F.col("home_runs_pred"), F.col("away_runs_pred"))
    j = J.with_market(g, m).withColumn("p_home_model", p).withColumn("p_away_model", 1 - F.col("p_home_model"))
    return A.edges(j).withColumn("run_diff_pred", F.col("home_runs_pred") - F.col("away_runs_pred"))


@query("j5_j6_f18_predictions", f"WITH {PRED} SELECT game_id, home_team, round(p_home_model, 6) AS p_home_model, n_books, "
    f"best_side, round(best_edge, 6) AS best_edge, round(best_p_model, 6) AS best_p_model FROM final")
def _(spark, d):
    return rounded(predictions(spark, d).select("game_id", "home_team", "p_home_model", "n_books", "best_side", "best_edge", "best_p_model"))


@query("t1_top_bets", f"WITH {PRED} SELECT game_id, best_side, round(best_edge, 6) AS best_edge FROM final WHERE "
    f"coalesce(n_books, 0) >= 5 AND ph IS NOT NULL AND best_side <> 'NO_BET' ORDER BY final.best_edge DESC, game_id LIMIT 25")
def _(spark, d):
    return rounded(A.top_bets(predictions(spark, d), 25, 5).select("game_id", "best_side", "best_edge"))


@query("t2_largest_edges", f"WITH {PRED} SELECT game_id, round(greatest(abs(eh), abs(ea)), 6) AS abs_edge FROM final WHERE eh "
    f"IS NOT NULL ORDER BY round(greatest(abs(eh), abs(ea)), 9) DESC, game_id LIMIT 5")
def _(spark, d):
    p = predictions(spark, d).withColumns({c: F.round(c, 9) for c in ("edge_home", "edge_away")})
    return rounded(A.largest_edges(p).select("game_id", "abs_edge"))


@query("a10_prediction_summary", f"WITH {PRED} SELECT round(min(p_home_model + p_away_model), 6) AS p_sum_min, "
    f"round(avg(p_home_model + p_away_model), 6) AS p_sum_mean, round(max(p_home_model + p_away_model), 6) AS p_sum_max, "
    f"round(avg(eh), 6) AS edge_home_mean, round(avg(ea), 6) AS edge_away_mean, round(avg(home_runs_pred - away_runs_pred), 6) "
    f"AS run_diff_mean, round(stddev_samp(home_runs_pred - away_runs_pred), 6) AS run_diff_std, round(min(home_runs_pred - "
    f"away_runs_pred), 6) AS run_diff_min, round(max(home_runs_pred - away_runs_pred), 6) AS run_diff_max FROM final JOIN "
    f"{{v_run_preds}} USING (game_id)")
def _(spark, d):
    return rounded(A.prediction_summary(predictions(spark, d)))


@query("a11_row_count", "SELECT count(*) AS n FROM {v_pitches}")
def _(spark, d):
    return A.row_count(v(spark, d, "v_pitches"))


for _name, _f, _sql in feed_queries.FEEDS:
    register(_name, _f, _sql)

from gameline.plans import runs, stored_runs  # noqa: E402, F401  add their queries to those above


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
