"""Filters and column selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of column names that give away the result; the short ones hit starter, bullpen and lineup features too.
LEAKY = ("price", "_pred", "p_home", "p_away", "p_tie", "p_")


def completed(df: DataFrame) -> DataFrame:
    return df.where("home_runs is not null and away_runs is not null")


def in_dates(df: DataFrame, start: str, end: str, column: str = "game_date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def of_types(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("game_type").isin(*types))


def top_of_order(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("batting_order").between(1, n))


def books(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows of the named sportsbooks, whatever their case; an empty list allows all."""
    return df.where(F.lower("sportsbook").isin(*[b.lower() for b in allowed])) if allowed else df


def enough_books(n_books: Column, least: int, strict: bool = False) -> Column:
    """At least so many books; a missing number counts as 0, or as false if strict."""
    return F.coalesce(n_books >= least, F.lit(False)) if strict else F.coalesce(n_books, F.lit(0)) >= least


def drop_leaky(columns: list[str], parts=LEAKY) -> list[str]:
    return [c for c in columns if not any(p in c.lower() for p in parts)]


def feature_columns(df: DataFrame, drop: set[str]) -> list[str]:
    """Numeric and boolean columns that are not named."""
    return [f.name for f in df.schema.fields if f.name not in drop and isinstance(f.dataType, T.NumericType | T.BooleanType)]


def pick_first(columns: list[str], candidates: list[str]) -> str:
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {candidates} in {columns}")


def split_by_date(df: DataFrame, train_end: str, val_end: str, test_end: str, column: str = "game_date", check: bool = False) -> DataFrame:
    """df with a split column: train up to train_end, then val, then test; later rows go. check raises on an empty split."""
    d = F.col(column)
    day = lambda x: F.lit(x).cast("date")
    out = df.withColumn("split", F.when(d <= day(train_end), "train").when(d <= day(val_end), "val").when(d <= day(test_end),
        "test")).where("split is not null")
    if check and out.select("split").distinct().count() < 3:
        raise ValueError("a split has no rows")
    return out


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is a number."""
    return df.withColumn(target, F.col(target).try_cast("double")).dropna(subset=[target])


def with_both(df: DataFrame, model: str, market: str) -> DataFrame:
    return df.dropna(subset=[model, market])


def without(columns: list[str], supplied: list[str]) -> list[str]:
    return [c for c in columns if c not in set(supplied)]


def aligned(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """The features in the model's order; absent ones are null."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in features])


def require(df: DataFrame, features: list[str]) -> None:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise KeyError(f"missing features: {missing}")
