"""American odds, implied probabilities and profit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_implied(odds: Column) -> Column:
    """Implied probability; null for 0 and null."""
    return F.when(odds < 0, -odds / (-odds + F.lit(100.0))).when(odds > 0, F.lit(100.0) / (odds + F.lit(100.0)))


def prob_to_american(p: Column) -> Column:
    """Odds of a probability clipped to [1e-6, 1 - 1e-6], rounded half to even."""
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))
    return F.rint(F.when(q >= 0.5, -100.0 * q / (1 - q)).otherwise(100.0 * (1 - q) / q)).cast("int")


def profit_if_win(odds: Column) -> Column:
    """Profit of a winning unit bet; null for 0 and null."""
    return F.when(odds > 0, odds / F.lit(100.0)).when(odds < 0, F.lit(100.0) / F.abs(odds))


def expected_value(p: Column, odds: Column) -> Column:
    return p * profit_if_win(odds) - (1 - p)


def vig_free(home_odds: Column, away_odds: Column) -> Column:
    """The home side's probability with the bookmaker's margin taken out."""
    h, a = american_to_implied(home_odds), american_to_implied(away_odds)
    return h / (h + a)


def valid_odds(odds: Column, max_abs: float | None = 2000) -> Column:
    """At least 100 away from 0 and, if there is a limit, no further than it. Null is not valid."""
    ok = (odds <= -100) | (odds >= 100)
    return F.coalesce(ok if max_abs is None else ok & (F.abs(odds) <= max_abs), F.lit(False))
