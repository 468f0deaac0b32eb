"""Games to team rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_games(games: DataFrame) -> DataFrame:
    """Two rows for each completed game, one for each team; one scan. A tie is a loss for both."""
    sides = F.array(*[F.struct(F.col(f"{a}_team_id").alias("team_id"), F.lit(a == "home").alias("is_home"),
        F.col(f"{a}_runs").alias("runs_for"), F.col(f"{b}_runs").alias("runs_against")) for a, b in (("home",
        "away"), ("away", "home"))])
    out = games.where("home_runs is not null and away_runs is not null").select("game_id",
        "game_date", F.explode(sides).alias("s")).select("game_id", "game_date", "s.*")
    return out.withColumn("win", F.when(F.col("runs_for") > F.col("runs_against"), 1).otherwise(0))


def two_rows(df: DataFrame, target: bool = False) -> DataFrame:
    """A home and an away row for each game: home_x and away_x become team_x and opp_x and the other way round; other
    columns are kept. With target, target_runs is the team's own score (opp_runs stays, as in the source data)."""
    sided = sorted({c[5:] for c in df.columns if c[:5] in ("home_", "away_")} & {c[5:] for c in df.columns if c.startswith("home_")} & {c[5:] for c in df.columns if c.startswith("away_")})
    shared = [c for c in df.columns if c[:5] not in ("home_", "away_")]

    def row(own: str, other: str, flag: int) -> DataFrame:
        extra = [F.col(f"{own}_runs").alias("target_runs")] if target else []
        return df.select(*shared, *[F.col(f"{own}_{c}").alias(f"team_{c}") for c in sided], *[F.col(f"{other}_{c}").alias(f"opp_{c}") for c in sided],
            F.lit(flag).alias("is_home"), *extra)

    out = row("home", "away", 1).unionByName(row("away", "home", 0))
    return out.where("target_runs is not null").drop("team_runs") if target else out


def game_predictions(team_rows: DataFrame, pred: str = "pred_runs") -> DataFrame:
    """One row for each game from two team rows."""
    g = team_rows.groupBy("game_id").agg(*[F.max(F.when(F.col("is_home") == i, F.col(pred))).alias(n) for i,
        n in ((1, "home_runs_pred"), (0, "away_runs_pred"))])
    return g.withColumns({"total_runs_pred": F.col("home_runs_pred") + F.col("away_runs_pred"),
        "run_diff_pred": F.col("home_runs_pred") - F.col("away_runs_pred")})


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*")
