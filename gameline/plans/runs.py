"""Registered queries of whole runs: appended tables, reports, feature alignment, fitted blends and model reports."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gameline.functions import baseball as B
from gameline.functions import prob as P
from gameline.operators import aggregates as A
from gameline.operators import boosting as BT
from gameline.operators import filters as FL
from gameline.operators import joins as J
from gameline.operators import models as M
from gameline.operators import reshape as R
from gameline.operators import sinks as K
from gameline.operators import stored as TB
from gameline.operators import windows as W
from gameline.plans import catalog as C
from gameline.sources import tables as T

SPLITS = ("1996-12-31", "1997-12-31", "1998-12-31")
FORM = [f"{side}_{c}" for side in ("home", "away") for c in J.FORM]


# --- tables that runs append to ----------------------------------------------------------------------------------------
@C.query(
    "k4_versioned_append",
    """SELECT t.as_of_ts, g.game_id, g.game_date, g.season, r.home_runs_pred, r.away_runs_pred
    FROM {v_games} g JOIN {v_run_preds} r USING (game_id),
      (VALUES (TIMESTAMP '2024-04-01 12:00:00'), (TIMESTAMP '2024-04-02 12:00:00')) AS t(as_of_ts)
    WHERE r.home_runs_pred IS NOT NULL""",
)
def versioned_append(spark, d):
    """Two runs append their stamped predictions, in sink order; the table keeps both versions."""
    games = C.v(spark, d, "v_games").select("game_id", "game_date", "season")
    rows = games.join(C.v(spark, d, "v_run_preds").where("home_runs_pred is not null"), "game_id")
    path = T.scratch(spark, "predictions")
    for as_of in ("2024-04-01 12:00:00", "2024-04-02 12:00:00"):
        TB.append(K.stamped(rows, as_of), path, "season", "game_date", "game_id")
    return spark.read.schema(K.stamped(rows, "2024-04-01 12:00:00").schema).parquet(path)


@C.query(
    "k5_odds_snapshots",
    """SELECT game_id, CAST(year(game_date) AS INTEGER) AS season, sportsbook, market, pulled_at, home_price, away_price,
      t1, t2, t3, t4 FROM {v_odds}""",
)
def odds_snapshots(spark, d):
    """Polls append their quotes without conflict handling; every quote stays."""
    columns = ("game_id", "sportsbook", "market", "pulled_at", "home_price", "away_price", "t1", "t2", "t3", "t4")
    odds = C.v(spark, d, "v_odds").select(*columns, B.season_of(F.lit(None), F.col("game_date")).alias("season"))
    path = T.scratch(spark, "odds")
    for poll in ("t1 % 2 = 0", "t1 % 2 <> 0"):
        TB.append(odds.where(poll), path, "season", "game_id")
    return spark.read.schema(odds.schema).parquet(path)


@C.query("t5_sink_order", "SELECT game_id, game_date, season, home_runs, away_runs FROM {v_games}")
def sink_order(spark, d):
    """A feature table whose files follow one another by date and game, each in that order."""
    rows = C.v(spark, d, "v_games").select("game_id", "game_date", "season", "home_runs", "away_runs")
    path = T.scratch(spark, "features")
    TB.write_in_order(rows, path, "game_date", "game_id")
    return spark.read.schema(rows.schema).parquet(path)


@C.query("k7_report_sink", C.REGRESSION_SQL)
def report_sink(spark, d):
    """The regression report as a JSON file, read again."""
    games = C.v(spark, d, "v_games").join(C.v(spark, d, "v_run_preds"), "game_id").dropna(subset=["home_runs_pred"])
    split = FL.split_by_date(FL.with_target(games, "home_runs"), *SPLITS)
    report = A.regression_report(split, "home_runs", "home_runs_pred")
    path = T.scratch(spark, "report")
    K.write_report(report, path, "json")
    return C.rounded(spark.read.schema(report.schema).json(path))


# --- features and calendars ----------------------------------------------------------------------------------------------
@C.query(
    "s14_p8_p13_aligned",
    f"""SELECT f.game_id, {', '.join('f.' + c for c in FORM)}, CAST(NULL AS DOUBLE) AS wind_out, r.home_runs_pred AS score
    FROM ({C.SQL['team_form_features']}) f LEFT JOIN {{v_run_preds}} r ON f.game_id = r.game_id""",
)
def aligned_features(spark, d):
    """A model's feature list from its artifact, checked, and the table aligned to it; the model knows one feature more
    than the table has. Names are chosen by type, without leaky ones and without those that the games supply."""
    games = C.v(spark, d, "v_games")
    table = C.team_form_features(spark, d).join(C.v(spark, d, "v_run_preds"), "game_id", "left")
    found = FL.drop_leaky(FL.without(FL.feature_columns(table, {"game_id", "season"}), games.columns))
    path = T.scratch(spark, "artifact")
    spark.createDataFrame([(json.dumps({"features": [*found, "wind_out"]}),)], "value string").coalesce(1).write.text(path)
    wanted = K.read_features(spark.read.text(path, wholetext=True).first()["value"])
    FL.require(table, [c for c in wanted if c != "wind_out"])
    score = FL.pick_first(table.columns, ["home_runs_model", "home_runs_pred"])
    return FL.aligned(table, wanted, keep=["game_id", F.col(score).alias("score")])


@C.query(
    "f16_f26_calendar",
    """WITH d AS (SELECT unnest(generate_series(DATE '1996-03-01', DATE '1996-11-30', INTERVAL 1 DAY)) AS day
      UNION ALL SELECT unnest(generate_series(DATE '1997-03-01', DATE '1997-10-15', INTERVAL 1 DAY))),
    n AS (SELECT game_date, count(*) AS n_games FROM {v_games} GROUP BY game_date)
    SELECT CAST(d.day AS DATE) AS day, CAST(year(d.day) AS INTEGER) AS season, coalesce(n.n_games, 0) AS n_games
    FROM d LEFT JOIN n ON n.game_date = CAST(d.day AS DATE)""",
)
def calendar_of_games(spark, d):
    """Games on every day of two seasons, one ending early, month by month."""
    months = [T.days(spark, a, b) for a, b in (*T.month_ranges(1996), *T.month_ranges(1997, season_end="1997-10-15"))]
    days = months[0]
    for m in months[1:]:
        days = days.unionByName(m)
    count = C.v(spark, d, "v_games").groupBy(F.col("game_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    season = B.season_of(F.lit(None), F.col("day"))
    return days.join(count, "day", "left").select("day", season.alias("season"), F.coalesce("n", F.lit(0)).alias("n_games"))


@C.query(
    "u4_first_per_key",
    """SELECT game_id, sportsbook, home_price FROM (SELECT *, row_number() OVER (PARTITION BY game_id
      ORDER BY pulled_at, t1, t2, t3, t4) AS rn FROM {v_odds}) WHERE rn = 1""",
)
def first_quote(spark, d):
    rows = C.v(spark, d, "v_odds").select("game_id", "sportsbook", "home_price", F.struct(*C.TIES).alias("at"))
    return R.first_per_key(rows, "game_id", "at").select("game_id", "sportsbook", "home_price")


@C.query(
    "w8_first_play",
    """SELECT game_id, team_id, pitcher_id, inning_entered FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team_id
      ORDER BY inning_entered, pitcher_id) AS rn FROM {v_appearances} WHERE inning_entered IS NOT NULL) WHERE rn = 1""",
)
def first_entry(spark, d):
    at = F.struct("inning_entered", "pitcher_id").alias("at")
    plays = C.v(spark, d, "v_appearances").where("inning_entered is not null").select("game_id", "team_id", "pitcher_id", "inning_entered", at)
    return W.first_play(plays, ["game_id", "team_id"], "at").drop("at")


# --- fitted blend and models -----------------------------------------------------------------------------------------------
@C.query(
    "f21_t4_fitted_blend",
    f"""WITH {C.JUDGED}, l AS (SELECT w, round(avg({C._LOSS.format('(w * p_model + (1 - w) * p_home_median)')}), 12) AS loss
      FROM judged, (SELECT unnest(range(0, 101)) / CAST(100 AS DOUBLE) AS w) WHERE split = 'val' GROUP BY w),
    best AS (SELECT w FROM l ORDER BY loss, w LIMIT 1)
    SELECT g.game_id, round(best.w * j.p_model + (1 - best.w) * j.p_home_median, 6) AS p_home_blend
    FROM {{v_games}} g LEFT JOIN (SELECT * FROM judged WHERE split = 'test') j ON g.game_id = j.game_id, best""",
)
def fitted_blend(spark, d):
    """The weight that is best on the validation rows blends the test rows; the games are updated with the result."""
    judged = C.judged(spark, d)
    losses = A.blend_losses(judged.where("split = 'val'"), "p_model", "p_home_median", "y")
    w = A.best_weight(losses).first()["w"]  # one number
    blend = judged.where("split = 'test'").select("game_id", P.blend(w, F.col("p_model"), F.col("p_home_median")).alias("p_home_blend"))
    return C.rounded(K.update(C.v(spark, d, "v_games").select("game_id"), blend, ["game_id"]))


@C.query(
    "m1_foreign_model",
    """SELECT game_id, round(1.5 + 0.5 * home_runs_pred - 0.25 * away_runs_pred, 6) AS margin
    FROM {v_run_preds} WHERE home_runs_pred IS NOT NULL""",
)
def foreign_model(spark, d):
    """Batches scored by an object that only has predict(array)."""
    rows = C.v(spark, d, "v_run_preds").where("home_runs_pred is not null")
    model = M.LinearModel((0.5, -0.25), 1.5)
    return C.rounded(M.score_any(rows, model, ["home_runs_pred", "away_runs_pred"], "margin").select("game_id", "margin"))


@C.query("m2_a4_run_report")
def run_report(spark, d):
    """Errors of the home and the away run model on each split."""
    rows, names = C._trainable(spark, d)
    out = None
    for side in ("home", "away"):
        train = rows.where("split = 'train'").withColumn("target", F.col(f"{side}_runs") + 0.0)
        scored = M.score(rows, M.fit_runs(train, names, "target"), names)
        one = A.regression_report(scored, f"{side}_runs", "prediction").withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return C.rounded(out)


def boosted_runs(spark, d):
    """({target: model}, rows, features): boosted trees for the home and the away runs, learned in the same passes."""
    rows, names = C._trainable(spark, d)
    rows = rows.select("game_id", "split", "home_runs", "away_runs", *names)
    fitted = rows.where("split in ('train', 'val')").withColumn("validate", F.col("split") == "val")
    return BT.fit_boosted(fitted, names, ["home_runs", "away_runs"], "validate", power=1.2, l1=0.5, row_fraction=0.7, feature_fraction=0.7), rows, names


@C.query("m2_boosted_runs")
def boosted_predictions(spark, d):
    models, rows, names = boosted_runs(spark, d)
    for side in ("home", "away"):
        rows = M.score_any(rows, models[f"{side}_runs"], names, f"{side}_p")
    return M.run_columns(rows, "home_p", "away_p").select("game_id", "split", "home_runs_pred", "away_runs_pred", "total_runs_pred", "run_diff_pred")


@C.query("m2_a4_boosted_report")
def boosted_report(spark, d):
    """Errors of the boosted home and away run models on each split."""
    models, rows, names = boosted_runs(spark, d)
    out = None
    for side in ("home", "away"):
        scored = M.score_any(rows, models[f"{side}_runs"], names, "prediction")
        one = A.regression_report(scored, f"{side}_runs", "prediction").withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return C.rounded(out)


@C.query("t3_k7_boosted_importances")
def boosted_importances(spark, d):
    """Gains of the boosted run models' features, largest first for each target, as CSV reports read again."""
    models, rows, _ = boosted_runs(spark, d)
    out = None
    for target, model in models.items():
        gains = A.importances(spark.createDataFrame(list(model.gains().items()), "feature string, gain double"))
        path = T.scratch(spark, "importances")
        K.write_report(gains, path, "csv")
        one = spark.read.schema(gains.schema).csv(path).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out


@C.query("m2_u3_team_run_model")
def team_run_model(spark, d):
    """One model on two rows a game, brought back to a row a game and judged on each split. Scores of the own game
    (opp_runs) are no features."""
    rows, _ = C._trainable(spark, d)
    rows = rows.drop("home_win", "home_team_name", "away_team_name")
    teams = R.two_rows(rows, target=True)
    names = [c for c in FL.feature_columns(teams, {"game_id", "season", "y", "venue_id", "target_runs", "opp_runs"}) if not c.endswith("team_id")]
    model = M.fit_runs(teams.where("split = 'train'").withColumn("target", F.col("target_runs") + 0.0), names, "target", power=1.1)
    games = R.game_predictions(M.score(teams, model, names).withColumnRenamed("prediction", "pred_runs"))
    judged = M.run_columns(games, "home_runs_pred", "away_runs_pred").join(rows.select("game_id", "split", "home_runs", "away_runs"), "game_id")
    reports = [A.regression_report(judged, f"{s}_runs", f"{s}_runs_pred").withColumn("side", F.lit(s)) for s in ("home", "away")]
    return C.rounded(reports[0].unionByName(reports[1]))


def win_model(spark, d):
    """(model, rows, features): boosted trees that stop where the validation split no longer gains."""
    rows, names = C._trainable(spark, d)
    fitted = rows.where("split in ('train', 'val')").withColumn("validate", F.col("split") == "val")
    return M.fit_win(fitted, names, "y", validation="validate"), rows, names


@C.query("m3_win_model")
def win_report(spark, d):
    model, rows, names = win_model(spark, d)
    scored = M.score(rows, model, names).withColumn("p", vector_to_array("probability")[1])
    return A.binary_report(scored.select("split", "p", "y"), "p", "y")


@C.query("t3_k7_importances")
def win_importances(spark, d):
    """Gains of the win model's features, largest first, as a CSV report read again."""
    model, rows, names = win_model(spark, d)
    gains = A.importances(M.tree_importances(model, names, rows))
    path = T.scratch(spark, "importances")
    K.write_report(gains, path, "csv")
    return spark.read.schema(gains.schema).csv(path)
