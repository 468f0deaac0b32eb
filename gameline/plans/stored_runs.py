"""Registered queries over stored tables: merges, first-wins inserts, versions, daily sums, buckets and landed events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gameline.functions import prob as P
from gameline.operators import aggregates as A
from gameline.operators import filters as FL
from gameline.operators import joins as J
from gameline.operators import reshape as R
from gameline.operators import sinks as K
from gameline.operators import stored as TB
from gameline.operators import windows as W
from gameline.plans import catalog as C
from gameline.sources import feeds as S
from gameline.sources import tables as T


# --- as-of lookups of season runs ------------------------------------------------------------------------------------
_SINCE = "make_date(year({0}.game_date), 1, 1) - 366"


@C.query(
    "j11_season_runs_batters",
    f"""WITH {C.SKILL}, lines AS (SELECT game_id, game_date, is_home, batting_order, CAST(player_id AS BIGINT) AS batter_id FROM {{v_lineups}}
      WHERE batting_order BETWEEN 1 AND 5),
    found AS (SELECT l.game_id, l.is_home, l.batting_order, max(s.as_of_date) AS at FROM lines l JOIN skill s ON l.batter_id = s.batter_id
      AND s.as_of_date BETWEEN {_SINCE.format('l')} AND l.game_date - 1 GROUP BY ALL)
    SELECT l.game_id, l.is_home, l.batting_order, {', '.join(f'round(s.{c}, 9) AS {c}' for c in A.SKILLS)} FROM lines l
      LEFT JOIN found f USING (game_id, is_home, batting_order) LEFT JOIN skill s ON s.batter_id = l.batter_id AND s.as_of_date = f.at""",
)
def season_runs_of_batters(spark, d):
    """Every season's run, in one: a lookup sees the rollups of its season and of the 366 days before it only."""
    start, end = C.game_range(spark, d)
    skill = T.stored(W.batter_skill(C.v(spark, d, "v_pitches")), "skill")
    since = F.date_sub(F.make_date(F.year("game_date"), F.lit(1), F.lit(1)), 366)
    found = J.as_of(T.stored(C.lines(spark, d), "lines"), skill, "batter_id", 365, f"{start[:4]}-01-01", end, since)
    return C.rounded(found.select("game_id", "is_home", "batting_order", *A.SKILLS), 9)


@C.query(
    "j11_season_runs_starters",
    f"""WITH {C.MIX}, asked AS (SELECT g.game_id, g.game_date, CAST(s.home_sp_id % 100 AS BIGINT) AS pitcher_id FROM {{v_games}} g LEFT JOIN {{v_starters}} s USING (game_id)),
    found AS (SELECT l.game_id, max(m.as_of_date) AS at FROM asked l JOIN mix m ON l.pitcher_id = m.pitcher_id
      AND m.as_of_date BETWEEN {_SINCE.format('l')} AND l.game_date - 1 GROUP BY ALL)
    SELECT l.game_id, {', '.join(f'round(m.{c}, 6) AS {c}' for c in A.MIXES)} FROM asked l
      LEFT JOIN found f USING (game_id) LEFT JOIN mix m ON m.pitcher_id = l.pitcher_id AND m.as_of_date = f.at""",
)
def season_runs_of_starters(spark, d):
    start, end = C.game_range(spark, d)
    mix = T.stored(W.pitch_mix(C.v(spark, d, "v_pitches")), "mix")
    since = F.date_sub(F.make_date(F.year("game_date"), F.lit(1), F.lit(1)), 366)
    return C.rounded(J.as_of(T.stored(C.home_starters(spark, d), "starters"), mix, "pitcher_id", 365, f"{start[:4]}-01-01", end, since).select("game_id", *A.MIXES))


# --- merges ------------------------------------------------------------------------------------------------------------
_UPDATES = """upd AS (SELECT CASE WHEN game_id % 7 = 0 THEN -game_id ELSE game_id END AS game_id, season, CASE WHEN game_id % 4 = 0 THEN NULL
  ELSE away_runs END AS home_runs, 99 AS venue_id FROM {v_games} WHERE game_id % 2 = 0)"""


def _game_table(spark, d, *columns):
    """The games as a stored table by season: (path, schema)."""
    games = C.v(spark, d, "v_games").select("game_id", *columns, "season")
    path = T.scratch(spark, "games")
    TB.append(games, path, "season", "game_id")
    return path, games.schema


def _changes(spark, d):
    i = F.col("game_id")
    return C.v(spark, d, "v_games").where("game_id % 2 = 0").select(F.when(i % 7 == 0, -i).otherwise(i).alias("game_id"), "season",
        F.when(i % 4 != 0, F.col("away_runs")).alias("home_runs"), F.lit(99).alias("venue_id"))


@C.query(
    "k1_merged_table",
    f"""WITH {_UPDATES} SELECT coalesce(g.game_id, u.game_id) AS game_id, CASE WHEN u.game_id IS NOT NULL THEN u.home_runs ELSE g.home_runs END AS home_runs,
      CASE WHEN g.game_id IS NOT NULL THEN g.venue_id ELSE u.venue_id END AS venue_id, coalesce(g.season, u.season) AS season
    FROM {{v_games}} g FULL JOIN upd u ON g.game_id = u.game_id""",
)
def merged_table(spark, d):
    """Games merged with updates in storage, read back."""
    path, schema = _game_table(spark, d, "home_runs", "venue_id")
    schema = TB.merge(spark, path, schema, _changes(spark, d), ["game_id"], "season", ["home_runs"])
    return TB.read(spark, path, schema)


@C.query(
    "k2_updated_table",
    f"""WITH {_UPDATES} SELECT g.game_id, CASE WHEN u.game_id IS NOT NULL THEN u.home_runs ELSE g.home_runs END AS home_runs, u.venue_id AS new_venue, g.season
    FROM {{v_games}} g LEFT JOIN upd u ON g.game_id = u.game_id""",
)
def updated_table(spark, d):
    """The same updates without inserts; a column that the table lacks is added to it."""
    path, schema = _game_table(spark, d, "home_runs")
    changes = _changes(spark, d).withColumnRenamed("venue_id", "new_venue")
    return TB.read(spark, path, TB.merge(spark, path, schema, changes, ["game_id"], "season", insert=False))


@C.query(
    "k3_first_wins",
    f"""SELECT DISTINCT {C._ROW_ID} AS row_id, CAST(year(game_date) AS INTEGER) AS season, game_pk, pitcher,
      CASE WHEN game_pk % 2 = 0 THEN 'old' ELSE 'first' END AS source FROM {{v_pitches}}""",
)
def first_wins(spark, d):
    """A batch that repeats every pitch with another value, in an order of its own, into a table that has half of them."""
    p = C.v(spark, d, "v_pitches").select(*[F.col(c).cast("string") for c in ("game_date", "game_pk", "at_bat_number", "pitch_number", "pitcher", "pitch_type")],
        F.when(F.col("batter") % 50 != 0, F.col("batter").cast("string")).otherwise("x").alias("batter"))
    rows = T.stored(S.normalized_pitches(p).select("row_id", F.year("game_date").alias("season"), "game_pk", "pitcher", "pitch_type"), "rows")
    sourced = lambda name: F.lit(name).alias("source")
    columns = ("row_id", "season", "game_pk", "pitcher")
    path = T.scratch(spark, "pitches")
    old = rows.where("game_pk % 2 = 0").select(*columns, sourced("old")).distinct()
    TB.append(old, path, "season", "row_id")
    lines = F.inline(F.array(*[F.struct(sourced(name), F.lit(n).alias("line")) for name, n in (("late", 2), ("first", 1))]))
    batch = rows.select(*columns, lines, "pitch_type")  # both lines of a pitch in one task, so that they combine before the shuffle
    TB.insert_first(spark, path, old.schema, batch, "row_id", ["line", "pitch_type"], "season")
    return TB.read(spark, path, old.schema)


@C.query(
    "k4_latest_version",
    """SELECT g.game_id, g.season, CASE WHEN g.game_id % 3 = 0 THEN TIMESTAMP '2024-04-02 12:00:00' ELSE TIMESTAMP '2024-04-01 12:00:00' END AS as_of_ts,
      CASE WHEN g.game_id % 3 = 0 THEN r.away_runs_pred ELSE r.home_runs_pred END AS home_runs_pred
    FROM {v_games} g JOIN {v_run_preds} r USING (game_id) WHERE r.home_runs_pred IS NOT NULL""",
)
def latest_predictions(spark, d):
    """Two runs, the later one of some games only; each game's latest version, over the seasons that the games have."""
    rows = C.v(spark, d, "v_games").select("game_id", "game_date", "season").join(C.v(spark, d, "v_run_preds").where("home_runs_pred is not null"), "game_id")
    path = T.scratch(spark, "predictions")
    later = rows.where("game_id % 3 = 0").withColumn("home_runs_pred", F.col("away_runs_pred"))
    for as_of, run in (("2024-04-02 12:00:00", later), ("2024-04-01 12:00:00", rows)):
        TB.append(K.stamped(run, as_of), path, "season", "game_date", "game_id")
    table = TB.read(spark, path, K.stamped(rows, "2024-04-01 12:00:00").schema)
    start, end = C.game_range(spark, d)
    seasons = F.col("season").between(int(start[:4]), int(end[:4]))
    return TB.latest_version(table, ["game_id"], "as_of_ts", seasons).select("game_id", "season", "as_of_ts", "home_runs_pred")


# --- windows -----------------------------------------------------------------------------------------------------------
@C.query("w1_w4_form_in_blocks", C.SQL["w1_w4_team_form"])
def form_in_blocks(spark, d):
    """Team form with a team's games dealt out in blocks."""
    return C.rounded(W.team_form_in_blocks(R.team_games(C.v(spark, d, "v_games"))).select("game_id", "team_id", *J.FORM))


def _by_days(spark, d, entity, to_days, of_days):
    """Rollups of two loads: all days but the last week, then that week; each run reads the days that it needs."""
    pitches = C.v(spark, d, "v_pitches").where("game_date is not null")
    r = pitches.agg(F.min("game_date").alias("a"), F.date_sub(F.max("game_date"), 6).alias("b"), F.max("game_date").alias("c")).first()
    first, week, last = (str(r[k] or "1900-01-07") for k in "abc")
    path, out = T.scratch(spark, "days"), None
    for low, high, rows in ((first, str(dt.date.fromisoformat(week) - dt.timedelta(days=1)), pitches.where(F.col("game_date") < F.lit(week).cast("date"))),
            (week, last, pitches.where(F.col("game_date") >= F.lit(week).cast("date")))):
        daily = to_days(rows)
        TB.add_days(spark, path, daily, entity)
        needed = TB.days_for(spark, path, daily.schema, low, high)
        rolled = of_days(needed).where(F.col("as_of_date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
        done = T.stored(rolled, "rollups")  # before a later load replaces files that the run has read
        out = done if out is None else out.unionByName(done)
    return out


@C.query("w10_mix_by_days", C.SQL["w10_pitch_mix"])
def mix_by_days(spark, d):
    return C.rounded(_by_days(spark, d, "pitcher", W.days_of_mix, W.mix_of_days))


@C.query("w11_skill_by_days", C.SQL["w11_batter_skill"])
def skill_by_days(spark, d):
    return C.rounded(_by_days(spark, d, "batter", W.days_of_skill, W.skill_of_days), 9)


_NARROW = "0.5 + CAST((game_id * 7919) % 100003 AS DOUBLE) / 1e12"


@C.query(
    "w9b_auc_of_a_narrow_band",
    f"""WITH x AS (SELECT season, {_NARROW} AS p, CASE WHEN home_runs > away_runs THEN 1 ELSE 0 END AS y FROM {{v_games}}),
    r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p) + (count(*) OVER (PARTITION BY season, p) - 1) / 2.0 AS r FROM x)
    SELECT season, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY season""",
)
def narrow_auc(spark, d):
    """Scores of all games within a ten-millionth of each other."""
    g = C.v(spark, d, "v_games").select("season", F.expr(_NARROW.replace("1e12", "1e12D")).alias("p"), P.home_win_label(F.col("home_runs"), F.col("away_runs")).alias("y"))
    return C.rounded(W.auc(g, "p", "y", "season"))


# --- bucketed joins --------------------------------------------------------------------------------------------------------
@C.query("j4_bucketed_bets", C.SQL["j4_f23_graded_bets"])
def bucketed_bets(spark, d):
    """Features, games and closing prices in buckets of game_id: their joins shuffle nothing."""
    r = C.v(spark, d, "v_run_preds").where("home_runs_pred is not null and away_runs_pred is not null")
    p = r.select("game_id", P.win_with_half_tie(F.col("home_runs_pred"), F.col("away_runs_pred"))["p"].alias("p_home"))
    known = p.join(C.consensus(spark, d).select("game_id", "n_books_ml"), "game_id").where(FL.enough_books(F.col("n_books_ml"), 3, strict=True))
    games = FL.completed(C.v(spark, d, "v_games")).select("game_id", "home_runs", "away_runs")
    features, games, closing = (TB.bucketed(t, n, "game_id") for t, n in ((known, "features"), (games, "games"), (C.closing(spark, d), "closing")))
    j = J.with_closing(features, games, closing)
    graded = A.graded_bets(j.withColumn("home_win", P.home_win_label(F.col("home_runs"), F.col("away_runs"))))
    return C.rounded(graded.select("game_id", "ev_home", "ev_away", "best_side", "best_odds", "won", "profit"))


@C.query("j9_bucketed_lacking_starts", C.SQL["j9_lacking_starts"])
def bucketed_lacking_starts(spark, d):
    games, starters, starts = (TB.bucketed(C.v(spark, d, n), n[2:], "game_id") for n in ("v_games", "v_starters", "v_starts"))
    return J.lacking_starts_by_game(games, starters, starts).select("game_id")


# --- landed events ---------------------------------------------------------------------------------------------------------
def polled(spark, d):
    """Documents of odds events as two polls give them: the second repeats every event of the first."""
    quotes = C.v(spark, d, "v_odds").where("market = 'h2h'").groupBy("game_id", "sportsbook").agg(F.max_by(F.struct("home_price", "away_price"), F.struct(*C.TIES)).alias("p"))
    quotes = quotes.join(C.v(spark, d, "v_games").select("game_id", "home_team_name", "away_team_name"), "game_id")
    outcome = lambda team, price: F.struct(F.col(team).alias("name"), F.col(price).alias("price"))
    market = F.struct(F.lit("h2h").alias("key"), F.array(outcome("home_team_name", "p.home_price"), outcome("away_team_name", "p.away_price")).alias("outcomes"))
    event = quotes.groupBy("game_id", "home_team_name", "away_team_name").agg(F.sort_array(F.collect_list(F.struct(F.col("sportsbook").alias("title"),
        F.array(market).alias("markets")))).alias("bookmakers"))
    docs = T.stored(event.select(F.to_json(F.array(F.struct(F.col("game_id").alias("id"), F.lit("2024-04-01T18:00:00Z").alias("commence_time"), F.col("home_team_name").alias("home_team"),
        F.col("away_team_name").alias("away_team"), "bookmakers"))).alias("doc")), "polled")
    return docs.unionByName(docs)


@C.query(
    "s9_k5_landed_events",
    """WITH b AS (SELECT DISTINCT game_id, sportsbook FROM {v_odds} WHERE market = 'h2h') SELECT game_id, 2 * count(*) AS n_odds, 1 AS n_raw
    FROM b JOIN {v_games} USING (game_id) GROUP BY game_id""",
)
def landed_events(spark, d):
    """Each event's text is stored once, however often it is polled; the odds rows of all polls keep its key."""
    events = S.raw_events(polled(spark, d))
    raw = T.stored(TB.landed(events), "raw")
    rows = S.odds(events.select("raw_key", F.concat(F.lit("["), "raw", F.lit("]")).alias("doc")), keep=["raw_key"])
    path = T.scratch(spark, "odds")
    TB.append(rows.withColumn("game_date", F.to_date("commence_time")), path, "game_date", "raw_key")
    odds = spark.read.parquet(path)
    per = odds.groupBy("raw_key").agg(F.count(F.lit(1)).alias("n_odds"))
    joined = raw.join(per, "raw_key", "left").select(F.get_json_object("raw", "$.id").cast("long").alias("game_id"), "n_odds")
    return joined.groupBy("game_id").agg(F.sum("n_odds").alias("n_odds"), F.count(F.lit(1)).cast("int").alias("n_raw"))
