"""Win probabilities from expected runs, blends and scores of probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Terms of the Poisson sums; enough for rates up to 30.
TERMS = 150
EPS = 2.220446049250313e-16


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("win", "tie", "lose")]))
def _outcomes(home: pd.Series, away: pd.Series) -> pd.DataFrame:
    """All rows of an Arrow batch take a step of the masses' recurrence at once."""
    x, y = home.to_numpy(dtype=float), away.to_numpy(dtype=float)
    h, a = np.exp(-x), np.exp(-y)
    h_below, a_below, win, lose, tie = h.copy(), a.copy(), np.zeros(len(x)), np.zeros(len(x)), h * a
    for k in range(1, TERMS + 1):
        h, a = h * x / k, a * y / k
        win += h * a_below
        lose += a * h_below
        tie += h * a
        h_below += h
        a_below += a
    return pd.DataFrame({"win": win, "tie": tie, "lose": lose})


def poisson_outcomes(home: Column, away: Column) -> Column:
    """struct(win, tie, lose): P(H > A), P(H = A) and P(H < A) for independent Poisson counts; null where a rate is.

    The sums have no built-in form that Spark compiles: as a higher-order aggregate they are interpreted, 150 steps a
    row and again for every field read, so they run on Arrow batches, once a row for equal arguments."""
    return F.when(home.isNotNull() & away.isNotNull(), _outcomes(home.cast("double"), away.cast("double")))


def clipped(x: Column, low: float, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    y = F.greatest(x, F.lit(low))
    return F.when(x.isNotNull(), y if high is None else F.least(y, F.lit(high)))


def win_with_half_tie(home: Column, away: Column) -> Column:
    """struct(p, tie): win probability with half of the ties, rates clipped to [0.05, 30]."""
    s = poisson_outcomes(clipped(home, 0.05, 30.0), clipped(away, 0.05, 30.0))
    return F.struct((s["win"] + s["tie"] / 2).alias("p"), s["tie"].alias("tie"))


def win_strict(home: Column, away: Column) -> Column:
    return poisson_outcomes(clipped(home, 1e-9), clipped(away, 1e-9))["win"]


def inference_win(home: Column, away: Column, swap_lambdas: bool = True) -> Column:
    """Strict win probability as predictions use it: with the rates swapped unless told otherwise."""
    return poisson_outcomes(clipped(home, 1e-9), clipped(away, 1e-9))["lose" if swap_lambdas else "win"]


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the five-term rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # fixed values of the approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def win_normal(home: Column, away: Column) -> Column:
    """Win probability by a normal difference with continuity correction."""
    return 1 - normal_cdf((0.5 - (home - away)) / F.sqrt(home + away))


def blend(w: Column | float, model: Column, market: Column) -> Column:
    w = F.lit(w) if isinstance(w, float | int) else w
    return w * model + (1 - w) * market


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p, EPS, 1 - EPS)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def home_win_label(home_runs: Column, away_runs: Column) -> Column:
    """1 for a home win, 0 for everything else, missing scores too."""
    return F.when(home_runs > away_runs, 1).otherwise(0)
