"""Joins of games with form, starters, odds, rollups, venues and weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORM = ("win_pct_30", "runs_for_30", "runs_against_30", "avg_runs_scored_60", "avg_runs_allowed_60", "games_in_window_60")


def both_sides(games: DataFrame, form: DataFrame, columns=FORM) -> DataFrame:
    """games with home_ and away_ columns of its teams' rows: one grouping by game instead of two joins."""
    aggs = [F.max(F.when(F.col("is_home") == flag, F.col(c))).alias(f"{side}_{c}") for side, flag in (("home",
        True), ("away", False)) for c in columns]
    return games.join(form.groupBy("game_id").agg(*aggs), "game_id", "left")


def with_labels(features: DataFrame, games: DataFrame) -> DataFrame:
    return features.join(games.select("game_id", "home_runs", "away_runs"), "game_id")


def with_starters(features: DataFrame, starters: DataFrame) -> DataFrame:
    return features.join(starters.select("game_id", "home_sp_id", "away_sp_id"), "game_id", "left")


def with_closing(features: DataFrame, games: DataFrame, closing: DataFrame) -> DataFrame:
    return with_labels(features, games).join(closing, "game_id")


def with_names(games: DataFrame, features: DataFrame, teams: DataFrame) -> DataFrame:
    """Games of features with team names; a team without a row is named by its id. Teams are few by nature, and the
    planner broadcasts them where statistics say so."""
    t = teams.select("mlb_team_id", "team_name")
    home, away = t.toDF("h_id", "h_name"), t.toDF("a_id", "a_name")
    g = games.join(features, "game_id").join(home, F.col("home_team_id") == F.col("h_id"), "left").join(away,
        F.col("away_team_id") == F.col("a_id"), "left")
    name = lambda n, i: F.coalesce(F.col(n), F.col(i).cast("string"))
    return g.withColumns({"home_team": name("h_name", "home_team_id"), "away_team": name("a_name",
        "away_team_id")}).drop("h_id", "h_name", "a_id", "a_name")


def with_market(predictions: DataFrame, market: DataFrame) -> DataFrame:
    return predictions.join(market, "game_id", "left")


def without_starters(games: DataFrame, starters: DataFrame) -> DataFrame:
    return games.join(starters.select("game_id"), "game_id", "left_anti")


def without_appearances(games: DataFrame, starters: DataFrame, appearances: DataFrame) -> DataFrame:
    done = games.where("home_runs is not null and away_runs is not null")
    return done.join(starters.select("game_id", "home_sp_id", "away_sp_id"), "game_id").join(appearances.select("game_id"), "game_id", "left_anti")


def lacking_starts(games: DataFrame, starters: DataFrame, starts: DataFrame) -> DataFrame:
    """Completed games where either starter has no start row; a null starter never has one."""
    has = starts.select("game_id", "pitcher_id").distinct()
    g = games.where("home_runs is not null and away_runs is not null").join(starters.select("game_id", "home_sp_id", "away_sp_id"), "game_id")
    for side in ("home", "away"):
        g = g.join(has.toDF("game_id", f"{side}_sp_id").withColumn(f"{side}_has", F.lit(True)), ["game_id", f"{side}_sp_id"], "left")
    return g.where("home_has is null or away_has is null").drop("home_has", "away_has")


def lacking_starts_by_game(games: DataFrame, starters: DataFrame, starts: DataFrame) -> DataFrame:
    """The same, matched by game alone, as both starters' ids are compared within the game's few start rows: tables
    that are bucketed by game_id are not shuffled."""
    has = starts.groupBy("game_id").agg(F.collect_set("pitcher_id").alias("seen"))
    g = games.where("home_runs is not null and away_runs is not null").join(starters.select("game_id", "home_sp_id", "away_sp_id"), "game_id")
    seen = lambda c: F.coalesce(F.array_contains("seen", F.col(c)), F.lit(False))
    return g.join(has, "game_id", "left").where(~(seen("home_sp_id") & seen("away_sp_id"))).drop("seen")


def lacking_context(games: DataFrame, appearances: DataFrame) -> DataFrame:
    """Regular games with relief rows that miss any entry context."""
    bad = appearances.where("not is_starter and (inning_entered is null or outs_on_entry is null or score_diff_on_entry is null "
        "or is_high_leverage is null)")
    return games.where("game_type = 'R'").join(bad.select("game_id"), "game_id", "left_semi")


def as_of(lookups: DataFrame, rollups: DataFrame, entity: str, days: int = 365, start: str | None = None, end: str | None = None,
    since: Column | None = None, bucket_days: int = 92) -> DataFrame:
    """lookups (entity, game_date, ...) with the entity's latest rollup of at most the day before. The latest row wins
    even where it holds nulls. A run of games from start to end reads the rollups of [start - 366 days, end] only, a
    filter that reaches the scan; since, a date of the lookup, hides what is older.

    Only the days that an entity is asked for, each once, look for their rollup; the lookups then meet these by entity and
    day. An entity's days are dealt out by time buckets: each bucket is one sorted stream that begins with the last rollup
    of the buckets before, so no task holds more than a bucket of an entity, and one row of each bucket when the last ones
    are carried over. Null entities are kept apart, so that they do not meet in one group."""
    values = [c for c in rollups.columns if c not in (entity, "as_of_date", "window_days")]
    known = rollups.where((F.col("window_days") == days) & F.col(entity).isNotNull())
    if start:
        known = known.where(F.col("as_of_date") >= F.date_sub(F.lit(start).cast("date"), 366))
    if end:
        known = known.where(F.col("as_of_date") <= F.lit(end).cast("date"))
    bucket = F.floor(F.datediff("at", F.lit("1970-01-01").cast("date")) / bucket_days).alias("bucket")
    r = known.select(entity, F.col("as_of_date").alias("at"), F.lit(0).alias("ask"), F.struct("as_of_date", *values).alias("found")).select("*", bucket)
    own = lookups.where(F.col(entity).isNotNull())
    asked = own.select(entity, F.date_sub("game_date", 1).alias("at")).distinct().select("*", F.lit(1).alias("ask"), bucket)
    last = r.groupBy(entity, "bucket").agg(F.max_by("found", "at").alias("found"))
    wanted = asked.groupBy(entity, "bucket").agg(F.lit(True).alias("wanted"))
    before = Window.partitionBy(entity).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(wanted, [entity, "bucket"], "full_outer").withColumn("found", F.last("found", ignorenulls=True).over(before)).where("wanted and found is not null")
    first = carried.select(entity, F.lit(None).cast("date").alias("at"), F.lit(0).alias("ask"), "found", "bucket")
    w = Window.partitionBy(entity, "bucket").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    hit = r.unionByName(first).unionByName(asked, allowMissingColumns=True).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("ask = 1")
    hit = hit.select(F.col(entity).alias("__entity"), F.date_add("at", 1).alias("__day"), F.col("found").alias("__found"))
    on = (F.col(entity) == F.col("__entity")) & (F.col("game_date") == F.col("__day"))
    shown = F.lit(True) if since is None else F.col("__found.as_of_date") >= since
    met = own.join(hit.hint("shuffle_hash"), on, "left").select(*lookups.columns, *[F.when(shown, F.col(f"__found.{c}")).alias(c) for c in values])
    none = lookups.where(F.col(entity).isNull()).select("*", *[F.lit(None).cast(rollups.schema[c].dataType).alias(c) for c in values])
    return met.unionByName(none)


def nearest_hour(games: DataFrame, hourly: DataFrame, reach: int = 3) -> DataFrame:
    """Games (game_id, venue_id, commence_time) with the venue's nearest hour within reach; the earlier one of two;
    games without any are left out. An equi-join on the possible hours."""
    h = F.date_trunc("hour", "commence_time")
    low = F.date_trunc("hour", F.col("commence_time") - F.expr(f"interval {reach} hours"))
    high = F.date_trunc("hour", F.col("commence_time") + F.expr(f"interval {reach} hours"))
    asked = games.select("*", h.alias("center"), F.explode(F.sequence(low, high, F.expr("interval 1 hour"))).alias("hour"))
    gap = F.abs(F.unix_timestamp("hour") - F.unix_timestamp("center"))
    values = [c for c in hourly.columns if c != "venue_id"]
    return asked.join(hourly, ["venue_id", "hour"]).groupBy("game_id", "venue_id", "commence_time").agg(F.min_by(F.struct(*values),
        F.struct(gap, "hour")).alias("found")).select("game_id", "venue_id", "commence_time",
        "found.*")


def odds_game_id(odds: DataFrame, games: DataFrame) -> DataFrame:
    """odds with the game of its date and team names; the smaller id of a doubleheader; null without a match."""
    one = games.groupBy("game_date", F.col("home_team_name").alias("home_team"), F.col("away_team_name").alias("away_team")).agg(F.min("game_id").alias("game_id"))
    return odds.drop("game_id").join(one, ["game_date", "home_team", "away_team"], "left")


def commence_times(games: DataFrame, odds_times: DataFrame, schedule_times: DataFrame) -> DataFrame:
    """Games of the range with the odds' commence time, else the schedule's."""
    o, s = odds_times.select("game_id", F.col("commence_time").alias("o")), schedule_times.select("game_id", F.col("commence_time").alias("s"))
    return games.select("game_id").join(o, "game_id", "left").join(s, "game_id", "left").select("game_id",
        F.coalesce("o", "s").alias("commence_time"))


def located(games: DataFrame, venues: DataFrame) -> DataFrame:
    return games.where("commence_time is not null").join(venues.where("lat is not null and lon is not null").select("venue_id",
        "lat", "lon"), "venue_id")
