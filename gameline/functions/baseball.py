"""Innings, leverage, play context, row ids, units and calendars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def innings_to_outs(text: Column) -> Column:
    """Outs of innings text such as 5.2; a fraction other than 0, 1 and 2 counts as none; no integer parts: null."""
    parts = F.split(F.trim(text), "\\.", 2)
    whole = F.get(parts, F.lit(0)).try_cast("int")
    part = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(F.size(parts) == 1, whole * 3).when(part.isNotNull(), whole * 3 + F.when(part.between(0, 2), part).otherwise(0))


def outs_to_innings(outs: Column) -> Column:
    return outs / F.lit(3.0)


def high_leverage(inning: Column, diff: Column) -> Column:
    """Seventh inning or later within two runs; null if either is null."""
    return F.when(inning.isNotNull() & diff.isNotNull(), (inning >= 7) & (F.abs(diff) <= 2))


def score_at_half(innings: Column, inning: Column, half: Column) -> Column:
    """struct(home, away): runs before a half-inning. innings is an array of structs home.runs, away.runs; what is
    missing counts 0; in the bottom half the away runs of the inning are in."""

    def total(side):
        done = F.slice(innings, F.lit(1), F.greatest(inning - 1, F.lit(0)))
        return F.coalesce(F.aggregate(done, F.lit(0), lambda s, x: s + F.coalesce(x[side]["runs"], F.lit(0)).cast("int")), F.lit(0))

    now = F.coalesce(F.get(innings, inning - 1)["away"]["runs"], F.lit(0)).cast("int")
    return F.struct(total("home").alias("home"), (total("away") + F.when(half == "bottom", now).otherwise(0)).alias("away"))


def play_context(play: Column) -> Column:
    """struct(inning, half, outs): from the play, else from its last event."""
    about, last = play["about"], F.try_element_at(play["playEvents"], F.lit(-1))
    half = F.coalesce(about["halfInning"], F.when(last["isTopInning"].isNotNull(), F.when(last["isTopInning"],
        "top").otherwise("bottom")), last["halfInning"])
    return F.struct(F.coalesce(about["inning"], last["inning"]).cast("int").alias("inning"), F.lower(half).alias("half"),
        F.coalesce(about["outs"], last["outs"], last["count"]["outs"]).cast("int").alias("outs"))


def pitch_row_id(*keys: Column, date: Column) -> Column:
    """md5 of the date and five integer keys joined by bars; missing ones have their customary names."""
    return F.md5(F.concat_ws("|", F.coalesce(date.cast("string"), F.lit("NaT")), *[F.coalesce(k.cast("long").cast("string"),
        F.lit("<NA>")) for k in keys]))


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def kmh_to_mph(v: Column) -> Column:
    return v * 0.621371


def mm_to_in(v: Column) -> Column:
    return v / 25.4


def season_of(season: Column, date: Column) -> Column:
    return F.coalesce(season.cast("int"), F.year(date))


def dot_or_null(a: list[Column], b: list[Column]) -> Column:
    """Sum of products; null if any number is."""
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out
