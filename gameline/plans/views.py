"""Domain views over the order, line, event and nation tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "lineitem", "events", "nation")
VIEWS = {
    "v_games": """SELECT game_id, game_date, season, home_team_id, away_team_id, concat('Team ', CAST(home_team_id AS STRING)) AS home_team_name, concat('Team ', CAST(away_team_id AS STRING)) AS away_team_name, home_runs, away_runs, home_runs > away_runs AS home_win, home_team_id AS venue_id, game_type FROM (
      SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INT) AS season, CAST(o_custkey % 30 AS INT) AS home_team_id, CAST((o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS INT) AS away_team_id,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 10 AS INT) END AS home_runs,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 10) AS BIGINT) % 10 AS INT) END AS away_runs,
        CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE 'R' END AS game_type FROM {orders})""",
    "v_teams": "SELECT CAST(n_nationkey AS BIGINT) AS mlb_team_id, n_name AS team_name FROM {nation}",
    "v_odds": """SELECT l.l_orderkey AS game_id, CAST(o.o_orderdate AS DATE) AS game_date, CASE WHEN l_suppkey % 8 = 0 THEN 'DraftKings' ELSE concat('book_', CAST(l_suppkey % 8 AS STRING)) END AS sportsbook, CASE WHEN l_linenumber = 7 THEN 'spreads' ELSE 'h2h' END AS market, l_shipdate AS pulled_at,
      CAST(CASE WHEN l_partkey % 40 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 5000 WHEN l_returnflag = 'A' THEN -(95 + 3 * CAST(floor(l_quantity) AS INT)) WHEN l_returnflag = 'N' THEN 95 + 3 * CAST(floor(l_quantity) AS INT) ELSE -(100 + CAST(floor(l_quantity) AS INT)) END AS INT) AS home_price,
      CAST(CASE WHEN l_returnflag = 'A' THEN 85 + 3 * CAST(floor(l_quantity) AS INT) WHEN l_returnflag = 'N' THEN -(105 + 3 * CAST(floor(l_quantity) AS INT)) ELSE 90 + CAST(floor(l_quantity) AS INT) END AS INT) AS away_price,
      l_linenumber AS t1, l_partkey AS t2, l_suppkey AS t3, l_extendedprice AS t4, l_shipdate AS commence_time FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "v_appearances": """SELECT a.game_id, g.game_date, a.pitcher_id, CASE WHEN a.pitcher_id % 2 = 0 THEN g.home_team_id ELSE g.away_team_id END AS team_id, CASE WHEN a.pitcher_id % 2 = 0 THEN g.away_team_id ELSE g.home_team_id END AS opponent_team_id, a.pitcher_id % 2 = 0 AS is_home, a.outs_pitched, a.runs_allowed, a.is_starter, a.inning_entered, CAST(a.game_id % 3 AS INT) AS outs_on_entry, a.score_diff_on_entry, a.inning_entered >= 7 AND abs(a.score_diff_on_entry) <= 2 AS is_high_leverage FROM (
      SELECT l_orderkey AS game_id, CAST(l_suppkey AS INT) AS pitcher_id, CAST(CAST(floor(min(l_quantity)) AS BIGINT) % 10 AS INT) AS outs_pitched, CAST(min(l_partkey) % 5 AS INT) AS runs_allowed, min(l_linenumber) = 1 AS is_starter, CASE WHEN min(l_partkey) % 37 = 0 THEN NULL ELSE CAST(min(l_linenumber) + 2 AS INT) END AS inning_entered, CAST(min(l_partkey) % 9 - 4 AS INT) AS score_diff_on_entry FROM {lineitem} GROUP BY l_orderkey, l_suppkey) a JOIN {v_games} g ON a.game_id = g.game_id""",
    "v_starts": "SELECT game_id, game_date, pitcher_id, team_id, outs_pitched, runs_allowed FROM {v_appearances} WHERE is_starter",
    "v_starters": "SELECT game_id, min(CASE WHEN pitcher_id % 2 = 0 THEN pitcher_id END) AS home_sp_id, min(CASE WHEN "
        "pitcher_id % 2 = 1 THEN pitcher_id END) AS away_sp_id FROM {v_appearances} WHERE is_starter AND game_id % 41 <> 0 "
        "GROUP BY game_id",
    "v_lineups": "SELECT o.o_orderkey AS game_id, g.game_date, CASE WHEN s.h = 1 THEN g.home_team_id ELSE g.away_team_id END AS "
        "team_id, s.h = 1 AS is_home, CAST(b.b AS INT) AS batting_order, CAST((o.o_custkey + 7 * b.b + 13 * s.h) % 200 AS INT) "
        "AS player_id FROM {orders} o JOIN {v_games} g ON o.o_orderkey = g.game_id, (VALUES (0), (1)) AS s(h), (VALUES (1), "
        "(2), (3), (4), (5), (6), (7), (8), (9)) AS b(b)",
    "v_pitches": """SELECT DISTINCT CAST(l_shipdate AS DATE) AS game_date, l_orderkey AS game_pk, CAST(l_linenumber AS BIGINT) AS at_bat_number, l_partkey AS pitch_number, CAST(l_suppkey % 100 AS BIGINT) AS pitcher, CAST(l_partkey % 200 AS BIGINT) AS batter,
      CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'ff' WHEN 1 THEN 'SI' WHEN 2 THEN 'FC' WHEN 3 THEN 'SL' WHEN 4 THEN 'CU' WHEN 5 THEN 'CH' WHEN 6 THEN 'SP' WHEN 7 THEN 'FS' END AS pitch_type, l_tax * 10 AS woba_value, CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS woba_denom FROM {lineitem}""",
    "v_run_preds": "SELECT o_orderkey AS game_id, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 2 + (o_custkey % 50) / CAST(10 "
        "AS DOUBLE) END AS home_runs_pred, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 2 + (o_orderkey % 47) / CAST(10 AS "
        "DOUBLE) END AS away_runs_pred FROM {orders}",
    "v_hourly": "SELECT CAST(user_id % 30 AS INT) AS venue_id, date_trunc('hour', ts) AS hour, avg(value) AS temp_c FROM "
        "{events} GROUP BY user_id % 30, date_trunc('hour', ts)",
    "v_commence": "SELECT event_id AS game_id, CAST((user_id + 1) % 30 AS INT) AS venue_id, ts AS commence_time FROM {events} "
        "WHERE event_type = 'signup'",
}


def _needs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def with_views(select: str) -> str:
    """DuckDB SQL: select over {view} names, with the views it needs before it."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in BASE and n not in order:
            for m in _needs(VIEWS[n]):
                add(m)
            order.append(n)

    for n in _needs(select):
        add(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(select).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
