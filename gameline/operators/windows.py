"""Trailing windows, latest-per-key selections and rank sums."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gameline.sources.tables import stored

PITCHES = ("FF", "SI", "FC", "SL", "CU", "CH", "SP", "FS")


def _form(w: WindowSpec) -> list[Column]:
    """The trailing numbers as differences of running sums, which are exact on integers: a sliding frame is summed anew
    for every row, a frame that only grows takes one step a row."""

    def last(n: int, what: Column) -> Column:
        upto = lambda k: F.coalesce(what.over(w.rowsBetween(Window.unboundedPreceding, -k)), F.lit(0).cast("long"))
        return upto(1) - upto(n + 1)

    def mean(n: int, c: str) -> Column:
        known = last(n, F.count(c))
        return F.when(known > 0, last(n, F.sum(c)) / known)

    return [
        mean(30, "win").alias("win_pct_30"),
        mean(30, "runs_for").alias("runs_for_30"),
        mean(30, "runs_against").alias("runs_against_30"),
        mean(60, "runs_for").alias("avg_runs_scored_60"),
        mean(60, "runs_against").alias("avg_runs_allowed_60"),
        last(60, F.count("game_id")).alias("games_in_window_60"),
    ]


def team_form(team_games: DataFrame) -> DataFrame:
    """Trailing form before each game of a team: 30 games (share won, runs for and against) and 60 games (averages and
    games in the window). Windows cross seasons; a first game has nulls and 0 games. One shuffle by team."""
    return team_games.select("*", *_form(Window.partitionBy("team_id").orderBy("game_date", "game_id")))


def positions(df: DataFrame, key: str, date: str, tie: str, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, among its key's rows by (date, tie). Rows are counted by day and numbered inside
    a day; only the days' counts of a key meet in one window."""
    days = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    start = days.select(key, date, F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(key, date).orderBy(tie)) - 1
    return df.withColumn("__inside", inside).join(start, [key, date]).withColumn(name, F.col("__start") + F.col("__inside")).drop("__start", "__inside")


def team_form_in_blocks(team_games: DataFrame, block_rows: int = 8192) -> DataFrame:
    """team_form for few teams with long histories: a team's games are cut into blocks of block_rows in order, each with
    copies of the 60 games before it, and a task holds blocks, never a team. Same rows as team_form."""
    p = positions(team_games, "team_id", "game_date", "game_id")
    own = F.floor(F.col("position") / block_rows)
    last = F.floor((F.col("position") + 60) / block_rows)
    copies = p.withColumns({"own": own, "block": F.explode(F.sequence(own, last))})
    w = Window.partitionBy("team_id", "block").orderBy("position")
    return copies.select("*", *_form(w)).where("block = own").drop("own", "block", "position")


def starter_form(starts: DataFrame, games: int = 5) -> DataFrame:
    """Runs per 27 outs and innings per start over a pitcher's last starts, this one excluded."""
    w = Window.partitionBy("pitcher_id").orderBy("game_date", "game_id").rowsBetween(-games, -1)
    outs, runs, n = F.sum("outs_pitched").over(w), F.sum("runs_allowed").over(w), F.count("game_id").over(w)
    return starts.where("outs_pitched is not null and runs_allowed is not null").select("game_id",
        "pitcher_id", F.when(outs > 0, 27.0 * runs / outs).alias("sp_ra9_last5"), F.when(n > 0, outs / 3.0 / n).alias("sp_ip_per_start_last5"))


def bullpen_load(appearances: DataFrame, team_days: DataFrame, spans=(1, 3, 5)) -> DataFrame:
    """Outs of a team's relievers on the days before each of its game days, all and high-leverage; none is 0. Summed to
    (team, day) first, so a window holds at most a few days."""
    day = F.datediff("game_date", F.lit("1970-01-01"))
    relief = appearances.where("not is_starter").groupBy("team_id", "game_date").agg(F.sum("outs_pitched").alias("outs"),
        F.sum(F.when(F.col("is_high_leverage"), F.col("outs_pitched"))).alias("hlev"))
    wanted = team_days.select("team_id", "game_date").distinct().withColumn("wanted", F.lit(True))
    both = relief.join(wanted, ["team_id", "game_date"], "full_outer").withColumn("day", day)
    w = Window.partitionBy("team_id").orderBy("day")
    cols = [F.coalesce(F.sum(c).over(w.rangeBetween(-n, -1)), F.lit(0)).cast("long").alias(f"bp_{name}outs_{n}d") for c,
        name in (("outs", ""), ("hlev", "hlev_")) for n in spans]
    return both.select("team_id", "game_date", "wanted", *cols).where("wanted").drop("wanted")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """values of each key's last row in the order, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row")).select(*keys, "row.*")


def first_play(plays: DataFrame, keys: list[str], position: str) -> DataFrame:
    rest = [c for c in plays.columns if c not in keys]
    return plays.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("row")).select(*keys, "row.*")


def auc(df: DataFrame, p: str, y: str, by: str | None = None, parts: int = 256) -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties counted half. Rows are summed to distinct scores, stored once;
    these are cut into parts of about as many scores at quantiles of the scores themselves, however narrow their band;
    prefix sums run inside the parts, and the parts' totals are carried from one to the next."""
    keys = [by] if by else []
    d = stored(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum(1 - F.col(y).cast("long")).alias("neg")), "scores")
    cuts = d.agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] or []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    d = Bucketizer(splits=splits, inputCol="p", outputCol="b").transform(d)
    inner = Window.partitionBy(*keys, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "b").agg(F.sum("neg").alias("n")).select(*keys, "b", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    d = d.withColumn("inside", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(totals, [*keys, "b"])
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2.0))
    return d.groupBy(*keys).agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def days_of_mix(pitches: DataFrame) -> DataFrame:
    """A pitcher's typed pitches of each kind on a day."""
    kind = F.upper("pitch_type")
    return pitches.where("pitcher is not null and game_date is not null and pitch_type is not null").groupBy("pitcher",
        "game_date").agg(*[F.sum(F.when(kind == c, 1).otherwise(0)).alias(c) for c in PITCHES], F.count(F.lit(1)).alias("n"))


def mix_of_days(daily: DataFrame, days: int = 365) -> DataFrame:
    rolled = _rolling(daily, "pitcher", days, [*PITCHES, "n"])
    return rolled.select(F.col("pitcher").alias("pitcher_id"), F.col("game_date").alias("as_of_date"),
        F.lit(days).alias("window_days"), *[(F.col(c) / F.col("n")).alias(f"pct_{c.lower()}") for c in PITCHES])


def pitch_mix(pitches: DataFrame, days: int = 365) -> DataFrame:
    """A pitcher's share of each pitch type over the trailing days up to each date pitched, over typed pitches."""
    return mix_of_days(days_of_mix(pitches), days)


def days_of_skill(pitches: DataFrame) -> DataFrame:
    """A batter's values and opportunities against each pitch type on a day."""
    kind = F.upper("pitch_type")
    sums = [F.sum(F.when(kind == c, F.col(v))).alias(f"{c}_{v[5]}") for c in PITCHES for v in ("woba_value", "woba_denom")]
    return pitches.where("batter is not null and game_date is not null and pitch_type is not null").groupBy("batter", "game_date").agg(*sums)


def skill_of_days(daily: DataFrame, days: int = 365) -> DataFrame:
    rolled = _rolling(daily, "batter", days, [f"{c}_{v}" for c in PITCHES for v in "vd"])
    return rolled.select(F.col("batter").alias("batter_id"), F.col("game_date").alias("as_of_date"),
        F.lit(days).alias("window_days"), *[F.when(F.col(f"{c}_d") != 0, F.col(f"{c}_v") / F.col(f"{c}_d")).alias(f"skill_{c.lower()}") for c in PITCHES])


def batter_skill(pitches: DataFrame, days: int = 365) -> DataFrame:
    """A batter's value per opportunity against each pitch type over the trailing days; null without opportunities."""
    return skill_of_days(days_of_skill(pitches), days)


def _rolling(daily: DataFrame, entity: str, days: int, sums: list[str]) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(F.datediff("game_date", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return daily.select(entity, "game_date", *[F.sum(c).over(w).alias(c) for c in sums])
