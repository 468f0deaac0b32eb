"""Feed parsers on documents made from the domain views; the SQL has the rows that the documents were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from gameline.plans.views import view
from gameline.sources import feeds as S

#: Games by id in a document of odds, and in a month's document of the schedule: larger tables have more documents, not longer ones.
ODDS_GAMES, SCHEDULE_GAMES = 250, 20_000
#: A batting order's slots.
SLOTS = range(1, 10)


def _page(games):
    return F.floor(F.col("game_id") / games).alias("page")


def _docs(df, *items):
    """A document for each run of game ids."""
    return df.groupBy(_page(ODDS_GAMES)).agg(*items)


def _schedule(spark, d):
    g = view(spark, d, "v_games")
    team = lambda s: F.struct(F.col(f"{s}_runs").alias("score"), F.struct(F.col(f"{s}_team_id").alias("id"),
        F.col(f"{s}_team_name").alias("name")).alias("team"))
    game = F.struct(F.col("game_id").alias("gamePk"), F.when(F.col("game_id") % 3 != 0, F.col("season").cast("string")).alias("season"),
        F.date_format(F.col("game_date").cast("timestamp") + F.expr("interval 19 hours"),
        "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"), F.col("game_type").alias("gameType"), F.lit("N").alias("doubleHeader"),
        F.lit(1).alias("seriesGameNumber"), F.struct(F.lit("Final").alias("detailedState")).alias("status"),
        F.struct(F.col("venue_id").alias("id"), F.concat(F.lit("Park "), F.col("venue_id").cast("string")).alias("name")).alias("venue"),
        F.struct(team("home").alias("home"), team("away").alias("away")).alias("teams"))
    days = g.groupBy("game_date", _page(SCHEDULE_GAMES)).agg(F.collect_list(game).alias("games"))
    return days.groupBy(F.date_trunc("month", "game_date").alias("m"), "page").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("game_date").cast("string").alias("date"),
        "games")).alias("dates"))).alias("doc"))


def s1(spark, d):
    return S.schedule_games(_schedule(spark, d))


def s2(spark, d):
    return S.schedule_venues(_schedule(spark, d))


def s12(spark, d):
    return S.schedule_commence(_schedule(spark, d))


def s3(spark, d):
    n = view(spark, d, "nation")
    i = F.col("n_nationkey")
    t = F.struct(i.cast("long").alias("id"), F.when(i % 3 == 0, "").otherwise(F.col("n_name")).alias("name"),
        F.when(i % 6 != 0, F.concat(F.lit("Club "), F.col("n_name"))).alias("teamName"), F.substring("n_name",
        1, 3).alias("abbreviation"))
    return S.teams(n.agg(F.to_json(F.struct(F.sort_array(F.collect_list(t)).alias("teams"))).alias("doc"))).select("mlb_team_id",
        "team_name", "abbreviation")


def _box(spark, d):
    a = view(spark, d, "v_appearances")
    ip = F.concat(F.floor(F.col("outs_pitched") / 3).cast("string"), F.lit("."), (F.col("outs_pitched") % 3).cast("string"))
    one = F.struct(F.concat(F.lit("ID"), F.col("pitcher_id").cast("string")).alias("key"), F.struct(F.struct(F.struct(ip.alias("inningsPitched"),
        F.col("runs_allowed").alias("runs")).alias("pitching")).alias("stats")).alias("value"))
    p = a.groupBy("game_id").agg(*[x for s, flag in (("home", F.col("is_home")), ("away", ~F.col("is_home"))) for x in (F.collect_list(F.when(flag,
        F.col("pitcher_id").cast("long"))).alias(f"{s}_ids"), F.map_from_entries(F.collect_list(F.when(flag,
        one))).alias(f"{s}_players"))])
    g = view(spark, d, "v_games").join(p, "game_id")
    team = lambda s: F.struct(F.col(f"{s}_team_id").alias("id"))
    side = lambda s: F.struct(F.col(f"{s}_ids").alias("pitchers"), F.col(f"{s}_players").alias("players"))
    doc = F.to_json(F.struct(F.struct(F.struct(team("home").alias("home"), team("away").alias("away")).alias("teams")).alias("gameData"),
        F.struct(F.struct(F.struct(side("home").alias("home"), side("away").alias("away")).alias("teams")).alias("boxscore")).alias("liveData")))
    return g.select("game_id", doc.alias("doc")), view(spark, d, "v_starters")


def s5(spark, d):
    docs, known = _box(spark, d)
    return S.appearances(docs, known).select("game_id", "pitcher_id", "team_id", "opponent_team_id",
        "is_home", "is_starter", "outs_pitched", F.round("innings_pitched", 6).alias("innings_pitched"),
        "runs_allowed")


def s6(spark, d):
    docs, known = _box(spark, d)
    return S.starter_lines(docs, known).select("game_id", "pitcher_id", "team_id", "is_home", "outs_pitched", "runs_allowed")


def _plays(spark, d):
    """Games with a play for every appearance, in the order of pitchers; even pitchers pitch in top halves."""
    a = view(spark, d, "v_appearances")
    half = F.when(F.col("pitcher_id") % 2 == 0, "top").otherwise("bottom")
    missing = F.col("pitcher_id") % 5 == 0
    play = F.struct(F.col("pitcher_id").alias("o"), F.struct(F.when(~missing, F.col("inning_entered")).alias("inning"),
        half.alias("halfInning"), F.when(~missing, F.col("outs_on_entry")).alias("outs")).alias("about"),
        F.struct(F.struct(F.col("pitcher_id").alias("id"), F.concat(F.lit("P"), F.col("pitcher_id").cast("string")).alias("fullName")).alias("pitcher")).alias("matchup"),
        F.array(F.struct(F.col("inning_entered").alias("inning"), F.col("outs_on_entry").alias("outs"))).alias("playEvents"))
    p = a.groupBy("game_id").agg(F.sort_array(F.collect_list(play)).alias("plays"))
    g = view(spark, d, "v_games").join(view(spark, d, "v_starters").select("game_id", "home_sp_id",
        "away_sp_id"), "game_id", "left").join(p, "game_id")
    pitcher = lambda c: F.struct(F.col(c).alias("id"), F.concat(F.lit("P"), F.col(c).cast("string")).alias("fullName"))
    team = lambda s: F.struct(F.col(f"{s}_team_id").alias("id"))
    innings = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(F.struct(((F.col("game_id") + i) % 3).cast("int").alias("runs")).alias("home"),
        F.struct(((F.col("game_id") + 2 * i) % 4).cast("int").alias("runs")).alias("away")))
    doc = F.to_json(F.struct(F.struct(F.struct(pitcher("home_sp_id").alias("home"), pitcher("away_sp_id").alias("away")).alias("probablePitchers"),
        F.struct(team("home").alias("home"), team("away").alias("away")).alias("teams")).alias("gameData"),
        F.struct(F.struct(F.col("plays").alias("allPlays")).alias("plays"), F.struct(innings.alias("innings")).alias("linescore")).alias("liveData")))
    return g.select("game_id", doc.alias("doc"))


def s4(spark, d):
    return S.starters(_plays(spark, d))


def s7(spark, d):
    return S.entry_context(_plays(spark, d))


def _lineups(spark, d):
    """A document for each game. Its slots are one hash grouping of numbers; lists and structures would have to be sorted."""
    x = view(spark, d, "v_lineups")
    of = {"home": F.col("is_home"), "away": ~F.col("is_home")}
    slot = lambda s, i: F.max(F.when(of[s] & (F.col("batting_order") == i), F.col("player_id")))
    g = x.groupBy("game_id", "game_date").agg(*[c for s in of for c in (F.max(F.when(of[s], F.col("team_id"))).alias(f"{s}_team"),
        *[slot(s, i).alias(f"{s}_{i}") for i in SLOTS])])
    key = lambda c: F.concat(F.lit("ID"), c.cast("string"))
    one = lambda p: F.struct(p.alias("key"), F.struct(F.struct(F.struct(F.when(F.right(p, F.lit(1)) != "0",
        "L").alias("code")).alias("batSide")).alias("person"), F.struct(F.lit("").alias("code"), F.lit("  Switch hitter ").alias("description")).alias("batSide"),
        F.struct(F.lit("").alias("abbreviation"), F.lit("Shortstop").alias("name")).alias("position")).alias("value"))

    def side(s):
        ids = F.array(*[F.lit("IDx") if i == 4 else key(F.col(f"{s}_{i}")) for i in SLOTS])
        players = F.array_except(F.array(*[F.col(f"{s}_{i}") for i in SLOTS]), F.array(F.lit(None).cast("int")))
        return F.struct(F.struct(F.col(f"{s}_team").alias("id")).alias("team"), ids.alias("battingOrder"),
            F.map_from_entries(F.transform(players, lambda p: one(key(p)))).alias("players")).alias(s)

    return g.select("game_id", "game_date", F.to_json(F.struct(F.struct(side("home"), side("away")).alias("teams"))).alias("doc"))


def s8(spark, d):
    return S.lineups(_lineups(spark, d))


def s9(spark, d):
    o = view(spark, d, "v_odds")
    g = view(spark, d, "v_games").select("game_id", "home_team_name", "away_team_name")
    o = o.groupBy("game_id", "sportsbook", "market").agg(F.max_by(F.struct("home_price",
        "away_price"), F.struct("pulled_at", "t1", "t2", "t3", "t4")).alias("p")).join(g, "game_id")
    outcome = lambda team, price: F.struct(F.col(team).alias("name"), price.alias("price"))
    market = F.struct(F.col("market").alias("key"), F.array(outcome("home_team_name", F.lit(7)),
        outcome("home_team_name", F.col("p.home_price")), outcome("away_team_name", F.col("p.away_price"))).alias("outcomes"))
    book = o.groupBy("game_id", "home_team_name", "away_team_name", "sportsbook").agg(F.sort_array(F.collect_list(market),
        asc=False).alias("markets"))
    event = book.groupBy("game_id", "home_team_name", "away_team_name").agg(F.collect_list(F.struct(F.lit("k").alias("key"),
        F.concat(F.lit(" "), F.col("sportsbook")).alias("title"), "markets")).alias("bookmakers"))
    e = event.withColumn("at", F.concat(F.lit("2024-04-0"), (F.col("game_id") % 2 + 1).cast("string"), F.lit("T18:00:00Z")))
    docs = _docs(e, F.to_json(F.collect_list(F.struct(F.col("at").alias("commence_time"), F.col("home_team_name").alias("home_team"),
        F.col("away_team_name").alias("away_team"), "bookmakers"))).alias("doc"))
    return S.odds(docs, "2024-04-01").select("home_team", "away_team", "sportsbook", "home_price", "away_price")


def s11(spark, d):
    h = view(spark, d, "v_hourly")
    docs = h.groupBy("venue_id").agg(F.sort_array(F.collect_list(F.struct("hour", "temp_c"))).alias("x")).select("venue_id",
        F.to_json(F.struct(F.struct(F.transform("x", lambda s: F.date_format(s["hour"],
        "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform("x", lambda s: s["temp_c"]).alias("temperature_2m"),
        F.transform("x", lambda s: s["temp_c"] / 2).alias("wind_speed_10m"), F.array(F.lit(25.4)).alias("precipitation")).alias("hourly"))).alias("doc"))
    return S.hourly_weather(docs).select("venue_id", "hour", F.round("temp_f", 6).alias("temp_f"), F.round("wind_mph",
        6).alias("wind_mph"), F.round("precip_in", 6).alias("precip_in"), "humidity")


_AT = "CAST(CAST(game_date AS DATE) AS TIMESTAMP) + INTERVAL 19 HOUR"
_PLAYS = ("seen AS (SELECT game_id, min(CASE WHEN pitcher_id % 2 = 0 THEN pitcher_id END) AS top, min(CASE WHEN pitcher_id % 2 = "
    "1 THEN pitcher_id END) AS bottom FROM {v_appearances} GROUP BY game_id)")
FEEDS = [
    ("s1_schedule_games", s1, "SELECT game_id, game_date, season, 'Final' AS status, home_team_id, away_team_id, "
        "home_team_name, away_team_name, home_runs, away_runs, home_win FROM {v_games}"),
    ("s2_schedule_venues", s2, "SELECT game_id, venue_id, 'Park ' || CAST(venue_id AS STRING) AS venue_name, game_type, 'N' AS "
        "doubleheader, 1 AS series_game_number FROM {v_games}"),
    ("s3_teams", s3, "SELECT CAST(n_nationkey AS BIGINT) AS mlb_team_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_name WHEN "
        "n_nationkey % 6 <> 0 THEN 'Club ' || n_name ELSE CAST(n_nationkey AS STRING) END AS team_name, substr(n_name, 1, 3) AS "
        "abbreviation FROM {nation}"),
    ("s4_starters", s4, f"WITH {_PLAYS}, k AS (SELECT g.game_id, s.home_sp_id AS h, s.away_sp_id AS a, seen.top, seen.bottom, "
        f"s.home_sp_id IS NOT NULL AND s.away_sp_id IS NOT NULL AS ok FROM {{v_games}} g JOIN seen USING (game_id) LEFT JOIN "
        f"{{v_starters}} s ON s.game_id = g.game_id) SELECT game_id, CASE WHEN ok THEN h ELSE bottom END AS home_sp_id, 'P' || "
        f"CAST(CASE WHEN ok THEN h ELSE bottom END AS STRING) AS home_sp_name, CASE WHEN ok THEN a ELSE top END AS away_sp_id, "
        f"'P' || CAST(CASE WHEN ok THEN a ELSE top END AS STRING) AS away_sp_name, CASE WHEN ok THEN 'probable' ELSE "
        f"'play_by_play' END AS source FROM k"),
    ("s5_appearances", s5, "SELECT a.game_id, a.pitcher_id, a.team_id, a.opponent_team_id, a.is_home, coalesce(a.pitcher_id = "
        "CASE WHEN a.is_home THEN s.home_sp_id ELSE s.away_sp_id END, false) AS is_starter, a.outs_pitched, "
        "round(a.outs_pitched / 3.0, 6) AS innings_pitched, a.runs_allowed FROM {v_appearances} a LEFT JOIN {v_starters} s ON "
        "a.game_id = s.game_id"),
    ("s6_starter_lines", s6, "SELECT a.game_id, a.pitcher_id, a.team_id, a.is_home, a.outs_pitched, a.runs_allowed FROM "
        "{v_appearances} a JOIN {v_starters} s ON a.game_id = s.game_id AND a.pitcher_id IN (s.home_sp_id, s.away_sp_id)"),
    ("s7_entry_context", s7, """WITH c AS (SELECT a.*, g.home_team_id, g.away_team_id, a.pitcher_id % 2 = 0 AS top FROM {v_appearances} a JOIN {v_games} g USING (game_id) WHERE a.inning_entered IS NOT NULL),
 s AS (SELECT *, coalesce((SELECT sum((game_id + i) % 3) FROM (SELECT unnest(range(1, 10)) AS i) WHERE i < inning_entered), 0) AS h, coalesce((SELECT sum((game_id + 2 * i) % 4) FROM (SELECT unnest(range(1, 10)) AS i) WHERE i < inning_entered OR (i = inning_entered AND NOT top)), 0) AS a FROM c)
 SELECT game_id, CASE WHEN top THEN home_team_id ELSE away_team_id END AS team_id, pitcher_id, inning_entered, outs_on_entry, CAST(CASE WHEN top THEN h - a ELSE a - h END AS INTEGER) AS score_diff_on_entry, inning_entered >= 7 AND abs(h - a) <= 2 AS is_high_leverage FROM s"""),
    ("s8_lineups", s8, "SELECT game_id, game_date, team_id, is_home, CASE WHEN batting_order > 4 THEN batting_order - 1 ELSE "
        "batting_order END AS batting_order, player_id, CASE WHEN player_id % 10 <> 0 THEN 'L' ELSE 'Switch hit' END AS bats, "
        "'Shortstop' AS pos FROM {v_lineups} WHERE batting_order <> 4 AND team_id <> 0"),
    ("s8_lineups_all", s8, "SELECT game_id, game_date, team_id, is_home, CASE WHEN batting_order > 4 THEN batting_order - 1 "
        "ELSE batting_order END AS batting_order, player_id, CASE WHEN player_id % 10 <> 0 THEN 'L' ELSE 'Switch hit' END AS "
        "bats, 'Shortstop' AS pos FROM {v_lineups} WHERE batting_order <> 4 AND team_id <> 0"),
    ("s9_odds", s9, "WITH x AS (SELECT *, row_number() OVER (PARTITION BY game_id, sportsbook ORDER BY pulled_at DESC, t1 DESC, "
        "t2 DESC, t3 DESC, t4 DESC) AS rn FROM {v_odds} WHERE market = 'h2h' AND game_id % 2 = 0) SELECT g.home_team_name AS "
        "home_team, g.away_team_name AS away_team, x.sportsbook, x.home_price, x.away_price FROM x JOIN {v_games} g USING "
        "(game_id) WHERE rn = 1"),
    ("s11_hourly_weather", s11, "SELECT venue_id, hour, round(temp_c * 9.0 / 5.0 + 32.0, 6) AS temp_f, round(temp_c / 2 * "
        "0.621371, 6) AS wind_mph, CASE WHEN row_number() OVER (PARTITION BY venue_id ORDER BY hour) = 1 THEN CAST(1 AS DOUBLE) "
        "END AS precip_in, CAST(NULL AS DOUBLE) AS humidity FROM {v_hourly}"),
    ("s12_schedule_commence", s12, f"SELECT game_id, {_AT} AS commence_time FROM {{v_games}}"),
]
