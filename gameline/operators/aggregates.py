"""Market consensus, lineup vectors, reports, searches over small grids and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gameline.functions import odds as O
from gameline.functions import prob as P
from gameline.operators import windows

SKILLS = tuple(f"skill_{p.lower()}" for p in windows.PITCHES)
MIXES = tuple(f"pct_{p.lower()}" for p in windows.PITCHES)
WEIGHTS = tuple(i / 100 for i in range(101))
EV_THRESHOLDS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)


def market_consensus(latest: DataFrame, max_abs: float = 2000) -> DataFrame:
    """Exact median of the books' vig-free home probability, their number, and the median's odds of both sides."""
    ok = latest.where(O.valid_odds(F.col("home_price"), max_abs) & O.valid_odds(F.col("away_price"), max_abs))
    m = ok.groupBy("game_id").agg(F.median(O.vig_free(F.col("home_price"), F.col("away_price"))).alias("p_home_median"),
        F.count(F.lit(1)).alias("n_books_ml"))
    return m.withColumns({"home_price_close_consensus": O.prob_to_american(F.col("p_home_median")),
        "away_price_close_consensus": O.prob_to_american(1 - F.col("p_home_median"))})


def earliest_commence(odds: DataFrame) -> DataFrame:
    return odds.where("game_id is not null and commence_time is not null").groupBy("game_id").agg(F.min("commence_time").alias("commence_time"))


def lineup_vectors(batters: DataFrame) -> DataFrame:
    """Mean skill against each pitch type over a lineup's batters with all eight numbers, and the mean of the means;
    nulls for a lineup without such a batter."""
    whole = F.lit(True)
    for c in SKILLS:
        whole = whole & F.col(c).isNotNull()
    sums = [F.sum(F.when(whole, F.col(c))).alias(c) for c in SKILLS]
    out = batters.groupBy("game_id", "is_home").agg(*sums, F.count(F.when(whole, 1)).alias("n"))
    out = out.select("game_id", "is_home", *[F.when(F.col("n") > 0, F.col(c) / F.col("n")).alias(c) for c in SKILLS])
    total = F.col(SKILLS[0])
    for c in SKILLS[1:]:
        total = total + F.col(c)
    return out.withColumn("lineup_skill", total / len(SKILLS))


def regression_report(df: DataFrame, y: str, p: str) -> DataFrame:
    d = F.col(y) - F.col(p)
    return df.groupBy("split").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(y).alias("mean_true"), F.avg(p).alias("mean_pred"))


def blend_losses(df: DataFrame, model: str, market: str, y: str, weights=WEIGHTS) -> DataFrame:
    """Mean log loss of every blend weight: rows meet the grid in the scan, sums are combined before the shuffle."""
    loss = P.log_loss(P.blend(F.col("w"), F.col(model), F.col(market)), F.col(y))
    return df.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights]))).groupBy("w").agg(F.avg(loss).alias("loss"))


def best_weight(losses: DataFrame) -> DataFrame:
    return losses.agg(F.min_by("w", F.struct(F.round("loss", 12), "w")).alias("w"))


def graded_bets(df: DataFrame) -> DataFrame:
    """Expected values, the better side (home on ties), its odds and the result of one unit. df has p_home, home_price,
    away_price and home_win (1 or 0)."""
    ev_home, ev_away = O.expected_value(F.col("p_home"), F.col("home_price")), O.expected_value(1 - F.col("p_home"), F.col("away_price"))
    d = df.withColumns({"ev_home": ev_home, "ev_away": ev_away})
    home = F.coalesce(F.col("ev_home") >= F.col("ev_away"), F.lit(False))
    d = d.withColumns({"best_side": F.when(home, "HOME").otherwise("AWAY"), "best_ev": F.when(home,
        F.col("ev_home")).otherwise(F.col("ev_away")), "best_odds": F.when(home, F.col("home_price")).otherwise(F.col("away_price"))})
    won = F.when(F.col("best_side") == "HOME", F.col("home_win") == 1).otherwise(F.col("home_win") == 0)
    return d.withColumns({"won": won.cast("int"), "profit_if_win": O.profit_if_win(F.col("best_odds"))}).withColumn("profit",
        F.when(F.col("won") == 1, F.col("profit_if_win")).otherwise(-1.0))


def ev_sweep(bets: DataFrame, thresholds=EV_THRESHOLDS, books: str = "n_books_ml") -> DataFrame:
    """One row for each threshold of expected value; without bets only their number, 0."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("best_ev") >= t
        aggs += [F.count(F.when(hit, 1)).alias(f"n{i}"), *[F.avg(F.when(hit, F.col(c).cast("double"))).alias(f"{c}{i}") for c in ("profit",
            "won", "best_ev", "profit_if_win", books)]]
    one = bets.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("ev_threshold"), F.col(f"n{i}").alias("n_bets"),
        F.col(f"profit{i}").alias("roi"), F.col(f"won{i}").alias("win_rate"), F.col(f"best_ev{i}").alias("avg_ev"),
        F.col(f"profit_if_win{i}").alias("avg_profit_if_win"), F.col(f"{books}{i}").alias("avg_books")) for i,
        t in enumerate(thresholds)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def binary_report(df: DataFrame, p: str, y: str, by: str = "split") -> DataFrame:
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    r = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(P.log_loss(F.col(p), F.col(y))).alias("log_loss"),
        F.avg(P.brier(F.col(p), F.col(y))).alias("brier"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return r.join(windows.auc(d, p, y, by), by)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for each column its non-nulls, mean, least and greatest value."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{name}") for c in columns for name,
        f in (("count", F.count), ("avg", F.avg), ("min", F.min), ("max", F.max))])


def mean_by_side(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("is_home").agg(F.avg(target).alias(f"mean_{target}"))


def prediction_summary(df: DataFrame) -> DataFrame:
    s = F.col("p_home_model") + F.col("p_away_model")
    return df.agg(F.min(s).alias("p_sum_min"), F.avg(s).alias("p_sum_mean"), F.max(s).alias("p_sum_max"),
        F.avg("edge_home").alias("edge_home_mean"), F.avg("edge_away").alias("edge_away_mean"), F.avg("run_diff_pred").alias("run_diff_mean"),
        F.stddev_samp("run_diff_pred").alias("run_diff_std"), F.min("run_diff_pred").alias("run_diff_min"),
        F.max("run_diff_pred").alias("run_diff_max"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def top_bets(df: DataFrame, k: int, min_books: int) -> DataFrame:
    """The k best edges among games with enough books, or with any where none has enough; no market, no bet.

    Both tiers are cut to k rows, already in the tasks that make them; the choice is made on what is left of both."""
    n = F.coalesce(F.col("n_books"), F.lit(0))
    bet = F.col("p_home_model").isNotNull() & F.col("p_home_market_median").isNotNull() & (F.col("best_side") != "NO_BET")
    tiers = df.where(n >= 1).withColumns({"__enough": n >= min_books, "__bet": F.coalesce(bet, F.lit(False))})
    order = [F.desc("__bet"), F.desc("best_edge"), "game_id"]
    rows = tiers.withColumn("__rank", F.row_number().over(Window.partitionBy("__enough").orderBy(*order))).where(F.col("__rank") <= k)
    rows = rows.withColumn("__any", F.max("__enough").over(Window.partitionBy(F.lit(1))))
    return rows.where("__bet and (__enough or not __any)").orderBy(F.desc("best_edge"), "game_id").limit(k).drop("__enough",
        "__bet", "__rank", "__any")


def largest_edges(df: DataFrame, k: int = 5) -> DataFrame:
    size: Column = F.greatest(F.abs("edge_home"), F.abs("edge_away"))
    return df.where(size.isNotNull()).withColumn("abs_edge", size).orderBy(F.desc("abs_edge"), "game_id").limit(k)


def importances(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("gain"), "feature")


def edges(df: DataFrame, least: float = 0.01) -> DataFrame:
    """Edges and expected values of both sides and the best side: home on ties; away, without an edge, where the market
    is unknown; NO_BET and nulls below the least edge."""
    d = df.withColumns({"edge_home": F.col("p_home_model") - F.col("p_home_market_median"),
        "edge_away": F.col("p_away_model") - F.col("p_away_market_median"), "ev_home": O.expected_value(F.col("p_home_model"),
        F.col("home_price_consensus")), "ev_away": O.expected_value(F.col("p_away_model"), F.col("away_price_consensus"))})
    known = F.col("edge_home").isNotNull() & F.col("edge_away").isNotNull()
    home = F.coalesce(F.col("edge_home") >= F.col("edge_away"), F.lit(False))
    best = F.when(known, F.greatest("edge_home", "edge_away"))
    out = best < least
    pick = lambda a, b: F.when(F.coalesce(out, F.lit(False)), F.lit(None)).when(home, F.col(a)).otherwise(F.col(b))
    return d.withColumns({"best_side": F.when(F.coalesce(out, F.lit(False)), "NO_BET").when(home,
        "HOME").otherwise("AWAY"), "best_edge": F.when(~F.coalesce(out, F.lit(False)), best),
        "best_ev": pick("ev_home", "ev_away"), "best_p_model": pick("p_home_model", "p_away_model"),
        "best_p_market": pick("p_home_market_median", "p_away_market_median")})
