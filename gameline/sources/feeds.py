"""Landed JSON feeds to flat tables. Every parser takes a DataFrame with one document in a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gameline.functions import baseball as B

_TEAM = "struct<score: int, team: struct<id: int, name: string>>"
SCHEDULE = (f"struct<dates: array<struct<date: string, games: array<struct<gamePk: bigint, season: string, gameDate: string, "
    f"gameType: string, doubleHeader: string, seriesGameNumber: int, status: struct<detailedState: string>, venue: struct<id: "
    f"int, name: string>, teams: struct<home: {_TEAM}, away: {_TEAM}>>>>>>")
TEAMS = "struct<teams: array<struct<id: bigint, name: string, teamName: string, abbreviation: string>>>"
_PITCHER = "struct<id: int, fullName: string>"
_BOX = "struct<pitchers: array<bigint>, players: map<string, struct<stats: struct<pitching: struct<inningsPitched: string, runs: int>>>>>"
LIVE = (f"struct<gameData: struct<probablePitchers: struct<home: {_PITCHER}, away: {_PITCHER}>, teams: struct<home: struct<id: "
    f"int>, away: struct<id: int>>>, liveData: struct<plays: struct<allPlays: array<struct<about: struct<inning: int, "
    f"halfInning: string, outs: int>, matchup: struct<pitcher: {_PITCHER}>, playEvents: array<struct<inning: int, isTopInning: "
    f"boolean, halfInning: string, outs: int, count: struct<outs: int>>>>>>, linescore: struct<innings: array<struct<home: "
    f"struct<runs: int>, away: struct<runs: int>>>>, boxscore: struct<teams: struct<home: {_BOX}, away: {_BOX}>>>>")
_LINEUP = ("struct<team: struct<id: int>, battingOrder: array<string>, players: map<string, struct<person: struct<batSide: "
    "struct<code: string>>, batSide: struct<code: string, description: string>, position: struct<abbreviation: string, name: "
    "string>>>>")
BOX = f"struct<teams: struct<home: {_LINEUP}, away: {_LINEUP}>>"
ODDS = ("array<struct<commence_time: string, home_team: string, away_team: string, bookmakers: array<struct<key: string, title: "
    "string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: int>>>>>>>>")
HOURLY = ("struct<hourly: struct<time: array<string>, temperature_2m: array<double>, relative_humidity_2m: array<double>, "
    "precipitation: array<double>, surface_pressure: array<double>, wind_speed_10m: array<double>, wind_direction_10m: "
    "array<double>>>")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _games(docs: DataFrame, column: str) -> DataFrame:
    days = docs.select(F.posexplode(F.from_json(column, SCHEDULE)["dates"]).alias("i", "d"))
    return days.select("i", F.col("d.date").alias("date"), F.posexplode("d.games").alias("j", "g"))


def schedule_games(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One row for each game of the schedule; no winner without both scores, a tie is no home win."""
    g = _games(docs, column).where("g.gamePk is not null")
    h, a = F.col("g.teams.home"), F.col("g.teams.away")
    day = F.col("date").try_cast("date")
    return g.select(F.col("g.gamePk").alias("game_id"), day.alias("game_date"), F.coalesce(F.col("g.season").try_cast("int"),
        F.year(day)).alias("season"), F.col("g.status.detailedState").alias("status"), h["team"]["id"].alias("home_team_id"),
        a["team"]["id"].alias("away_team_id"), h["team"]["name"].alias("home_team_name"), a["team"]["name"].alias("away_team_name"),
        h["score"].alias("home_runs"), a["score"].alias("away_runs"), (h["score"] > a["score"]).alias("home_win"))


def schedule_venues(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Venue attributes of each game; of a game under several dates the last counts."""
    g = _games(docs, column).where("g.gamePk is not null")
    row = F.struct(F.col("g.venue.id").alias("venue_id"), F.col("g.venue.name").alias("venue_name"),
        F.col("g.gameType").alias("game_type"), F.col("g.doubleHeader").alias("doubleheader"), F.col("g.seriesGameNumber").alias("series_game_number"))
    return g.groupBy(F.col("g.gamePk").alias("game_id")).agg(F.max_by(row, F.struct("i", "j")).alias("r")).select("game_id", "r.*")


def schedule_commence(docs: DataFrame, column: str = "doc") -> DataFrame:
    g = _games(docs, column)
    return g.select(F.col("g.gamePk").alias("game_id"), F.try_to_timestamp("g.gameDate").alias("commence_time")).where("game_id is not null and commence_time is not null")


def teams(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Teams by their first non-empty name; the first row of an id counts."""
    t = docs.select(F.posexplode(F.from_json(column, TEAMS)["teams"]).alias("i", "t")).where("t.id is not null")
    row = F.struct(F.coalesce(_filled(F.col("t.name")), _filled(F.col("t.teamName")), F.col("t.id").cast("string")).alias("team_name"),
        F.col("t.abbreviation").alias("abbreviation"), F.col("t.name").alias("name_full"))
    return t.groupBy(F.col("t.id").alias("mlb_team_id")).agg(F.min_by(row, "i").alias("r")).select("mlb_team_id", "r.*")


def _live(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("game_id", F.from_json(column, LIVE).alias("f"))


def starters(docs: DataFrame, column: str = "doc", top_half_pitcher: str = "away") -> DataFrame:
    """Starting pitchers of each game (game_id, doc): the probable ones if both are named, else the first pitchers of
    the plays. By default the pitcher first seen in a top half counts as the away starter, as in the source data;
    top_half_pitcher="home" takes the rules of the game."""
    d = _live(docs, column)
    probable = F.col("f.gameData.probablePitchers")
    plays = F.coalesce(F.col("f.liveData.plays.allPlays"), F.array().cast("array<struct<about: struct<inning: int, halfInning: "
        "string, outs: int>, matchup: struct<pitcher: struct<id: int, fullName: string>>, playEvents: array<struct<inning: int, "
        "isTopInning: boolean, halfInning: string, outs: int, count: struct<outs: int>>>>>"))

    def first(half: str) -> Column:
        return F.get(F.filter(plays, lambda p: (F.lower(p["about"]["halfInning"]) == half) & p["matchup"]["pitcher"]["id"].isNotNull()),
            F.lit(0))["matchup"]["pitcher"]

    seen = {h: first(h) for h in ("top", "bottom")}
    home, away = ("bottom", "top") if top_half_pitcher == "away" else ("top", "bottom")
    both = F.coalesce(probable["home"]["id"].isNotNull() & probable["away"]["id"].isNotNull(), F.lit(False))
    pick = lambda side, half, field: F.when(both, probable[side][field]).otherwise(seen[half][field])
    return d.select("game_id", pick("home", home, "id").alias("home_sp_id"), pick("home", home,
        "fullName").alias("home_sp_name"), pick("away", away, "id").alias("away_sp_id"), pick("away",
        away, "fullName").alias("away_sp_name"), F.when(both, "probable").otherwise("play_by_play").alias("source"))


def _sides(d: DataFrame) -> DataFrame:
    box, of = F.col("f.liveData.boxscore.teams"), F.col("f.gameData.teams")
    sides = [F.struct(F.lit(s == "home").alias("is_home"), of[s]["id"].alias("team_id"), of[o]["id"].alias("opponent_team_id"),
        box[s]["pitchers"].alias("pitchers"), box[s]["players"].alias("players")) for s, o in (("home",
        "away"), ("away", "home"))]
    return d.withColumn("s", F.explode(F.array(*sides)))


def _line(pid: Column) -> list[Column]:
    stats = F.try_element_at("players", F.concat(F.lit("ID"), pid.cast("string")))["stats"]["pitching"]
    outs = B.innings_to_outs(stats["inningsPitched"])
    return [outs.alias("outs_pitched"), B.outs_to_innings(outs).alias("innings_pitched"), stats["runs"].alias("runs_allowed")]


def appearances(docs: DataFrame, known: DataFrame, column: str = "doc") -> DataFrame:
    """A row for each pitcher of each side. known has game_id, home_sp_id and away_sp_id."""
    d = _sides(_live(docs, column).join(known.select("game_id", "home_sp_id", "away_sp_id"), "game_id", "left"))
    p = d.select("game_id", "home_sp_id", "away_sp_id", "s.*").withColumn("pitcher_id", F.explode("pitchers")).withColumn("pitcher_id",
        F.col("pitcher_id").cast("int"))
    sp = F.when(F.col("is_home"), F.col("home_sp_id")).otherwise(F.col("away_sp_id"))
    return p.select("game_id", "pitcher_id", "team_id", "opponent_team_id", "is_home", F.coalesce(F.col("pitcher_id") == sp,
        F.lit(False)).alias("is_starter"), *_line(F.col("pitcher_id")))


def starter_lines(docs: DataFrame, known: DataFrame, column: str = "doc") -> DataFrame:
    """A row for each known starter; missing numbers are null."""
    d = _sides(_live(docs, column).join(known.select("game_id", "home_sp_id", "away_sp_id"),
        "game_id")).select("game_id", "home_sp_id", "away_sp_id", "s.*")
    d = d.withColumn("pitcher_id", F.when(F.col("is_home"), F.col("home_sp_id")).otherwise(F.col("away_sp_id")).cast("int")).where("pitcher_id is not null")
    return d.select("game_id", "pitcher_id", "team_id", "opponent_team_id", "is_home", *_line(F.col("pitcher_id")))


def entry_context(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Inning, outs and score difference at each pitcher's first play for a team, seen from that team."""
    d = _live(docs, column)
    innings = F.col("f.liveData.linescore.innings")
    plays = d.select("game_id", innings.alias("innings"), F.col("f.gameData.teams").alias("of"), F.posexplode("f.liveData.plays.allPlays").alias("pos",
        "play"))
    p = plays.withColumn("c", B.play_context(F.col("play"))).withColumn("pitcher_id", F.col("play.matchup.pitcher.id"))
    p = p.where("pitcher_id is not null and c.inning is not null and c.half in ('top', 'bottom') and c.outs is not null")
    s = B.score_at_half(F.coalesce(F.col("innings"), F.array().cast("array<struct<home: struct<runs: int>, away: struct<runs: "
        "int>>>")), F.col("c.inning"), F.col("c.half"))
    p = p.withColumn("s", s).withColumn("top", F.col("c.half") == "top")
    diff = F.when(F.col("top"), F.col("s.home") - F.col("s.away")).otherwise(F.col("s.away") - F.col("s.home"))
    p = p.select("game_id", F.when(F.col("top"), F.col("of.home.id")).otherwise(F.col("of.away.id")).alias("team_id"),
        "pitcher_id", F.struct(F.col("c.inning").alias("inning_entered"), F.col("c.outs").alias("outs_on_entry"),
        diff.alias("score_diff_on_entry"), B.high_leverage(F.col("c.inning"), diff).alias("is_high_leverage")).alias("row"),
        "pos")
    return p.groupBy("game_id", "team_id", "pitcher_id").agg(F.min_by("row", "pos").alias("row")).select("game_id", "team_id", "pitcher_id", "row.*")


def _player_id(x: Column) -> Column:
    """The integer after an ID prefix. A failed cast costs an exception, so that what cannot be an integer is not cast."""
    x = F.when(x.startswith("ID"), F.substr(x, F.lit(3))).otherwise(x)
    return F.when(x.rlike("^[^A-Za-z]*[0-9][^A-Za-z]*$"), x.try_cast("int"))


def _lineup(side: Column) -> Column:
    """The rows of a side's batting order, none without a team's id. Players are looked up here, so that no row carries them."""
    ids = F.filter(F.transform(side["battingOrder"], _player_id), lambda x: x.isNotNull())
    found = F.transform(ids, lambda i: F.struct(i.alias("id"), F.try_element_at(side["players"], F.concat(F.lit("ID"), i.cast("string"))).alias("one")))
    short = lambda *cs: F.substring(F.trim(F.coalesce(*[_filled(c) for c in cs])), 1, 10)

    def row(p: Column, i: Column) -> Column:
        one = p["one"]
        return F.struct((i + 1).alias("batting_order"), p["id"].alias("player_id"), short(one["person"]["batSide"]["code"],
            one["batSide"]["code"], one["batSide"]["description"]).alias("bats"), short(one["position"]["abbreviation"],
            one["position"]["name"]).alias("pos"))

    return F.when(F.coalesce(side["team"]["id"], F.lit(0)) != 0, F.transform(found, row))


def lineups(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Batting orders (game_id, game_date, doc): ids that are no integers are skipped before numbering."""
    d = docs.select("game_id", "game_date", F.from_json(column, BOX)["teams"].alias("t"))
    sides = F.array(*[F.struct(F.col("t")[s]["team"]["id"].alias("team_id"), F.lit(s == "home").alias("is_home"),
        _lineup(F.col("t")[s]).alias("rows")) for s in ("home", "away")])
    return d.select("game_id", "game_date", F.inline(sides)).select("game_id", "game_date", "team_id", "is_home", F.inline("rows"))


def raw_events(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(raw_key, raw): the text of each event of the documents and its digest."""
    e = docs.select(F.explode(F.from_json(column, "array<string>")).alias("raw")).where("raw is not null")
    return e.select(F.sha2("raw", 256).alias("raw_key"), "raw")


def odds(docs: DataFrame, day: str | None = None, allowed: list[str] = (), column: str = "doc", keep: list[str] = ()) -> DataFrame:
    """A row for each event and book of a UTC date (all dates without one): the first moneyline market, in it the last
    outcome of each team's name; missing prices stay null. keep: columns of docs that every row carries, such as the
    key of a landed document."""
    e = docs.select(*keep, F.explode(F.from_json(column, ODDS)).alias("e")).select(*keep, "e.*").withColumn("at", F.try_to_timestamp("commence_time"))
    if day:
        e = e.where(F.when(F.col("at").isNotNull(), F.to_date("at") == F.lit(day).cast("date")).otherwise(F.col("commence_time").startswith(day)))
    e = e.where(_filled(F.col("home_team")).isNotNull() & _filled(F.col("away_team")).isNotNull())
    b = e.select(*keep, "home_team", "away_team", F.col("at").alias("commence_time"), F.explode("bookmakers").alias("b"))
    b = b.withColumn("sportsbook", _filled(F.trim(F.coalesce(_filled(F.col("b.title")), F.col("b.key"))))).where("sportsbook is not null")
    if allowed:
        b = b.where(F.lower("sportsbook").isin(*[x.lower() for x in allowed]))
    b = b.withColumn("m", F.get(F.filter("b.markets", lambda m: m["key"] == "h2h"), F.lit(0))).where("m is not null")
    price = lambda team: F.try_element_at(F.filter("m.outcomes", lambda o: o["name"] == F.col(team)), F.lit(-1))["price"]
    return b.select(*keep, "home_team", "away_team", "commence_time", "sportsbook", F.lit("h2h").alias("market"),
        price("home_team").alias("home_price"), price("away_team").alias("away_price"))


PITCH_COLUMNS = {"game_date": "date", **dict.fromkeys(("game_pk", "at_bat_number", "pitch_number",
    "pitcher", "batter", "zone", "balls", "strikes", "inning"), "bigint"), **dict.fromkeys(("release_speed",
    "release_pos_x", "release_pos_z", "plate_x", "plate_z", "launch_speed", "launch_angle",
    "hit_distance_sc", "woba_value", "woba_denom", "estimated_woba_using_speedangle"), "double"), **dict.fromkeys(("stand",
    "p_throws", "pitch_type", "pitch_name", "events", "description", "type", "bb_type", "home_team",
    "away_team", "inning_topbot"), "string")}


def normalized_pitches(df: DataFrame) -> DataFrame:
    """The pitch table's columns in order, bad values null, absent ones null, with a row id."""
    out = df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in PITCH_COLUMNS.items()])
    keys = [F.col(c) for c in ("game_pk", "at_bat_number", "pitch_number", "pitcher", "batter")]
    return out.withColumn("row_id", B.pitch_row_id(*keys, date=F.col("game_date")))


def hourly_weather(docs: DataFrame, column: str = "doc") -> DataFrame:
    """A row for each hour of a venue's document (venue_id, doc), in Fahrenheit, miles per hour and inches."""
    h = docs.select("venue_id", F.from_json(column, HOURLY)["hourly"].alias("h"))
    z = h.select("venue_id", F.explode(F.arrays_zip(*[F.coalesce(F.col(f"h.{c}"), F.array().cast(f"array<{'string' if c == 'time' else 'double'}>")).alias(c) for c in ("time",
        "temperature_2m", "relative_humidity_2m", "precipitation", "surface_pressure",
        "wind_speed_10m", "wind_direction_10m")])).alias("z"))
    return z.select("venue_id", F.try_to_timestamp("z.time").alias("hour"), B.c_to_f(F.col("z.temperature_2m")).alias("temp_f"),
        B.kmh_to_mph(F.col("z.wind_speed_10m")).alias("wind_mph"), F.col("z.wind_direction_10m").alias("wind_dir_deg"),
        F.col("z.relative_humidity_2m").alias("humidity"), F.col("z.surface_pressure").alias("pressure_mb"),
        B.mm_to_in(F.col("z.precipitation")).alias("precip_in"))
