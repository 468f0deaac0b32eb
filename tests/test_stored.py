"""Stored tables, as-of lookups, blocked windows and boosted trees on small tables, against brute force."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gameline.operators import boosting
from gameline.operators import joins as J
from gameline.operators import models as M
from gameline.operators import sinks as K
from gameline.operators import stored as TB
from gameline.operators import windows as W
from gameline.plans import catalog
from gameline.sources import tables as T
from tests.conftest import SF, rows

GAMES = "game_id long, season int, runs int, venue int"


def files(path, column):
    out = {}
    for folder, _, names in os.walk(path):
        if f"{column}=" in folder:
            out[folder.split(f"{column}=")[1]] = sorted(n for n in names if n.endswith(".parquet"))
    return out


def plan_of(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def games(spark, tmp_path):
    df = spark.createDataFrame([(i, 2000 + i % 4, i, 7) for i in range(40)], GAMES).repartition(3)
    path = f"{tmp_path}/games"
    TB.append(df, path, "season", "game_id")
    return path, df.schema


def test_append_writes_a_file_a_partition(spark, games):
    path, schema = games
    assert {k: len(v) for k, v in files(path, "season").items()} == {str(2000 + i): 1 for i in range(4)}
    TB.append(TB.read(spark, path, schema).where("season = 2001"), path, "season")
    assert {k: len(v) for k, v in files(path, "season").items()} == {"2000": 1, "2001": 2, "2002": 1, "2003": 1}
    assert TB.read(spark, path, schema).count() == 50


def test_merge_touches_the_partitions_of_its_updates(spark, games):
    path, schema = games
    before = files(path, "season")
    updates = spark.createDataFrame([(1, 2001, None, 9), (5, 2001, 50, 9), (101, 2001, 3, 9)], GAMES)
    schema = TB.merge(spark, path, schema, updates, ["game_id"], "season", ["runs"])
    after = files(path, "season")
    assert [k for k in before if before[k] != after[k]] == ["2001"]
    got = {r.game_id: (r.season, r.runs, r.venue) for r in TB.read(spark, path, schema).collect()}
    want = {i: (2000 + i % 4, i, 7) for i in range(40)} | {1: (2001, None, 7), 5: (2001, 50, 7), 101: (2001, 3, 9)}
    assert got == want


def test_merge_without_inserts_adds_columns(spark, games):
    path, schema = games
    updates = spark.createDataFrame([(2, 2002, "x"), (500, 2002, "y")], "game_id long, season int, note string")
    grown = TB.merge(spark, path, schema, updates, ["game_id"], "season", insert=False)
    got = {r.game_id: r.note for r in TB.read(spark, path, grown).collect()}
    assert got == {i: "x" if i == 2 else None for i in range(40)} and set(grown.names) == {*schema.names, "note"}


def test_merge_of_keys_that_move(spark, games):
    path, schema = games
    updates = spark.createDataFrame([(i, 2001, -i, 1) for i in range(3, 40, 4)] + [(0, 1999, 5, 5)], GAMES)  # 2003 is left without games
    TB.merge(spark, path, schema, updates, ["game_id"], "season", moves=True)
    got = {r.game_id: (r.season, r.runs) for r in TB.read(spark, path, schema).collect()}
    assert got == {i: (2001, -i) if i % 4 == 3 else (2000 + i % 4, i) for i in range(1, 40)} | {0: (1999, 5)}
    assert sorted(files(path, "season")) == ["1999", "2000", "2001", "2002"]


def test_merge_refuses_a_null_partition_and_takes_nothing(spark, games):
    path, schema = games
    with pytest.raises(ValueError, match="season"):
        TB.merge(spark, path, schema, spark.createDataFrame([(1, None, 1, 1)], GAMES), ["game_id"], "season")
    before = files(path, "season")
    TB.merge(spark, path, schema, spark.createDataFrame([], GAMES), ["game_id"], "season")
    assert files(path, "season") == before


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_first_row_of_a_batch_wins(spark, tmp_path, parts):
    path = f"{tmp_path}/pitches"
    old = spark.createDataFrame([("a", 2000, "old"), ("z", 2001, "old")], "row_id string, season int, v string")
    TB.append(old, path, "season")
    lines = [(k, 2000, f"{k}{n}", n) for n in (3, 1, 2) for k in "abc"] + [("z", 2001, "new", 1)]
    batch = spark.createDataFrame(lines, "row_id string, season int, v string, line int").repartition(parts, "line")
    TB.insert_first(spark, path, old.schema, batch, "row_id", ["line"], "season")
    assert rows(TB.read(spark, path, old.schema).select("row_id", "v")) == [("a", "old"), ("b", "b1"), ("c", "c1"), ("z", "old")]
    TB.insert_first(spark, path, old.schema, batch, "row_id", ["line"], "season")
    assert TB.read(spark, path, old.schema).count() == 4


@pytest.mark.parametrize("parts", [1, 3])
def test_first_row_wins_without_storage(spark, parts):
    target = spark.createDataFrame([("a", "old")], "row_id string, v string")
    batch = spark.createDataFrame([(k, f"{k}{n}", n) for n in (3, 1, 2) for k in "abc"], "row_id string, v string, line int").repartition(parts, "line")
    assert rows(K.insert_absent(target, batch, "row_id", ["line"])) == [("a", "old"), ("b", "b1"), ("c", "c1")]
    assert rows(K.insert_absent(target, batch.drop("line"), "row_id")) == [("a", "old"), ("b", "b1"), ("c", "c1")]


def test_first_insert_reads_the_batch_s_partitions_only(spark, games):
    path, schema = games
    held = TB._within(TB.read(spark, path, schema).select("game_id", "season"), "season", [2001])
    assert "(season#" in plan_of(held).split("PartitionFilters: [")[1].split("]")[0] and held.select(F.input_file_name().alias("f")).distinct().count() == 1


def test_latest_version(spark, tmp_path):
    path = f"{tmp_path}/runs"
    df = spark.createDataFrame([(1, 2000, "b", 2), (1, 2000, "a", 1), (2, 2000, "c", 1), (3, 2001, "d", 1)], "game_id int, season int, v string, as_of int")
    TB.append(df, path, "season")
    table = TB.read(spark, path, df.schema)
    assert rows(TB.latest_version(table, ["game_id"], "as_of").select("game_id", "v")) == [(1, "b"), (2, "c"), (3, "d")]
    pruned = TB.latest_version(table, ["game_id"], "as_of", F.col("season") == 2000)
    assert rows(pruned.select("game_id", "v")) == [(1, "b"), (2, "c")] and "PartitionFilters: [isnotnull(season" in plan_of(pruned)


def test_files_in_order_do_not_overlap(spark, tmp_path):
    r = random.Random(3)
    df = spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(r.randrange(90)), r.randrange(10_000)) for _ in range(2000)], "game_date date, game_id int").repartition(5)
    TB.write_in_order(df, f"{tmp_path}/t", "game_date", "game_id", files=6)
    key = F.struct("game_date", "game_id")
    spans = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).agg(F.min(key), F.max(key)).select("min(struct(game_date, game_id))",
        "max(struct(game_date, game_id))").collect())
    assert len(spans) == 6 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    for name in os.listdir(f"{tmp_path}/t"):
        if name.endswith(".parquet"):
            import pyarrow.parquet as pq

            held = [tuple(x.values()) for x in pq.read_table(f"{tmp_path}/t/{name}").to_pylist()]
            assert held == sorted(held)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["j4_bucketed_bets", "j9_bucketed_lacking_starts"])
def test_bucketed_joins_shuffle_nothing(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 3


def test_days_are_read_by_month_and_can_be_loaded_again(spark, tmp_path):
    r = random.Random(5)
    first = dt.date(2000, 1, 1)
    pitches = [(r.randrange(3), first + dt.timedelta(r.randrange(500)), r.choice([*W.PITCHES, "ff", None])) for _ in range(3000)]
    df = spark.createDataFrame(pitches, "pitcher int, game_date date, pitch_type string")
    week = first + dt.timedelta(493)
    path, out = f"{tmp_path}/days", []
    for low, high, part in ((first, week - dt.timedelta(1), df.where(F.col("game_date") < week)), (week, first + dt.timedelta(500), df.where(F.col("game_date") >= week))):
        daily = W.days_of_mix(part)
        TB.add_days(spark, path, daily, "pitcher")
        needed = TB.days_for(spark, path, daily.schema, str(low), str(high))
        out += rows(W.mix_of_days(needed).where(F.col("as_of_date").between(low, high)))
    assert sorted(out, key=str) == rows(W.pitch_mix(df))
    assert "(month#" in plan_of(needed).split("PartitionFilters: [")[1].split("]")[0]
    months = {r.m for r in needed.select(F.regexp_extract(F.input_file_name(), "month=([^/]*)", 1).alias("m")).distinct().collect()}
    assert min(months) == "2000-05-01" and "2000-04-01" in files(path, "month")
    before = files(path, "month")
    TB.add_days(spark, path, daily, "pitcher")
    assert [m for m in before if before[m] != files(path, "month")[m]] == ["2001-05-01"]
    assert rows(W.mix_of_days(TB.days_for(spark, path, daily.schema, str(first), str(high)))) == rows(W.pitch_mix(df))


# --- as-of lookups -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bucket_days", [1, 7, 92, 10_000])
def test_as_of_in_buckets_and_bounds(spark, bucket_days):
    r = random.Random(bucket_days)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    rolled = {(e, day(r.randrange(-600, 700))): r.choice([None, r.random()]) for e in range(5) for _ in range(25)}
    asked = [(i, r.choice([0, 1, 2, 3, 4, 9, None]), day(r.randrange(0, 365))) for i in range(300)]
    rollups = spark.createDataFrame([(e, d, 365, v, "x") for (e, d), v in rolled.items()] + [(1, day(300), 30, 5.0, "other")], "e int, as_of_date date, window_days int, v double, w string")
    lookups = spark.createDataFrame(asked, "i int, e int, game_date date")
    since = F.date_sub(F.trunc("game_date", "month"), 40)
    for hidden in (None, since):
        got = {x.i: (x.v, x.w) for x in J.as_of(lookups, rollups, "e", 365, "2000-01-01", "2000-12-30", hidden, bucket_days).collect()}
        for i, e, d in asked:
            low = max(day(-366), d.replace(day=1) - dt.timedelta(40)) if hidden is not None else day(-366)
            dates = [x for k, x in rolled if k == e and low <= x <= min(d - dt.timedelta(1), dt.date(2000, 12, 30))]
            assert got[i] == ((rolled[e, max(dates)], "x") if dates else (None, None))


def test_as_of_bound_reaches_the_scan(spark):
    rollups = T.stored(spark.createDataFrame([(1, dt.date(2000, 1, 1), 365, 1.0)], "e int, as_of_date date, window_days int, v double"), "rollups")
    lookups = spark.createDataFrame([(1, 1, dt.date(2000, 2, 1))], "i int, e int, game_date date")
    plan = plan_of(J.as_of(lookups, rollups, "e", 365, "2000-01-01", "2000-12-31"))
    assert "GreaterThanOrEqual(as_of_date,1998-12-31)" in plan and "LessThanOrEqual(as_of_date,2000-12-31)" in plan


# --- windows -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block_rows", [1, 7, 64, 8192])
def test_form_in_blocks_is_the_single_window_s(spark, block_rows):
    r = random.Random(1)
    games = [(g, dt.date(2000, 1, 1) + dt.timedelta(r.randrange(70)), t, r.randrange(9), r.randrange(9)) for t in (1, 2) for g in range(t * 1000, t * 1000 + 150)]
    df = spark.createDataFrame([(*g, int(g[3] > g[4])) for g in games] + [(5000, dt.date(2000, 1, 1), 3, 1, 0, 1)],
        "game_id int, game_date date, team_id int, runs_for int, runs_against int, win int")
    columns = ["game_id", "team_id", *J.FORM]
    tidy = lambda d: d.select(*[F.round(c, 9).alias(c) if c in J.FORM[:-1] else F.col(c) for c in columns])
    assert rows(tidy(W.team_form_in_blocks(df, block_rows))) == rows(tidy(W.team_form(df)))
    assert W.team_form_in_blocks(df.limit(0), block_rows).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-9])
def test_auc_of_any_band(spark, scale):
    r = random.Random(2)
    data = [(s, 0.25 + scale * r.randrange(300) / 1000, int(r.random() < 0.4)) for s in "ab" for _ in range(700)]
    df = spark.createDataFrame([*data, ("a", None, 1), ("b", 0.1, None)], "split string, p double, y int")
    got = {x.split: x.auc for x in W.auc(df, "p", "y", "split", parts=16).collect()}
    for s in "ab":
        pos, neg = ([p for k, p, y in data if k == s and y == v] for v in (1, 0))
        assert got[s] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))


# --- boosted trees -------------------------------------------------------------------------------------------------------
def twin(x, y, val, cuts, power, rounds, rate, depth, l2, least):
    """The same trees on one machine, node by node with plain loops."""
    import math

    bins = [[0 if math.isnan(v) else 1 + sum(c < v for c in cuts[j]) for j, v in enumerate(row)] for row in x]
    learn = [i for i in range(len(y)) if not val[i]]
    f = [math.log(sum(y[i] for i in learn) / len(learn))] * len(y)
    losses = []

    def best(members, g, h):
        gt, ht, out = sum(g[i] for i in members), sum(h[i] for i in members), (0.0, -1, 0)
        for j in range(len(x[0])):
            for b in range(1 + max(map(len, cuts))):
                left = [i for i in members if bins[i][j] <= b]
                if len(left) >= least and len(members) - len(left) >= least:
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl * gl / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt * gt / (ht + l2)
                    if gain > out[0] + 1e-9:
                        out = (gain, j, b)
        return out

    for _ in range(rounds):
        losses.append(sum((y[i] - math.exp(f[i])) ** 2 for i in range(len(y)) if val[i]) / sum(val))
        g = [math.exp((2 - power) * s) - t * math.exp((1 - power) * s) for s, t in zip(f, y, strict=True)]
        h = [(2 - power) * math.exp((2 - power) * s) - (1 - power) * t * math.exp((1 - power) * s) for s, t in zip(f, y, strict=True)]
        groups = [(learn, list(range(len(y))))]
        for _ in range(depth):
            nxt = []
            for members, everyone in groups:
                _, j, b = best(members, g, h)
                side = (lambda i, j=j, b=b: j >= 0 and bins[i][j] > b)
                nxt += [([i for i in members if not side(i)], [i for i in everyone if not side(i)]), ([i for i in members if side(i)], [i for i in everyone if side(i)])]
            groups = nxt
        for members, everyone in groups:
            step = -rate * sum(g[i] for i in members) / (sum(h[i] for i in members) + l2)
            for i in everyone:
                f[i] += step
    return f, losses


@pytest.mark.parametrize("rewrite", [2, 50])
def test_boosted_trees_are_the_twin_s(spark, rewrite):
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(240, 3)), 1)
    x[r.random(240) < 0.1, 1] = np.nan
    y = r.poisson(np.exp(0.6 + 0.5 * (x[:, 0] > 0) + np.where(np.isnan(x[:, 1]), 0.4, 0))).astype(float)
    val = r.random(240) < 0.25
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in a), float(t), float(t) + 1, bool(v)) for a, t, v in zip(x, y, val, strict=True)],
        "a double, b double, c double, runs double, more double, val boolean").repartition(3)
    options = {"power": 1.2, "rounds": 5, "rate": 0.3, "depth": 2, "l2": 1.0, "least": 10}
    models = boosting.fit_boosted(df, ["a", "b", "c"], ["runs", "more"], "val", bins=8, patience=99, rewrite=rewrite, **options)
    for name, target in (("runs", y), ("more", y + 1)):
        m = models[name]
        f, losses = twin(x.tolist(), target.tolist(), val.tolist(), m.cuts, **options)
        kept = len(m.trees)
        assert m.losses[:5] == pytest.approx(losses) and kept == int(np.argmin(m.losses))
        f, _ = twin(x.tolist(), target.tolist(), val.tolist(), m.cuts, **{**options, "rounds": kept})
        assert m.predict(x) == pytest.approx(np.exp(f))


def test_boosting_on_shares_of_rows_and_features(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 3))
    y = r.poisson(np.exp(0.5 + 0.8 * (x[:, 1] > 0.2)))
    df = spark.createDataFrame([(*map(float, a), float(t), i % 4 == 0) for i, (a, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, runs double, val boolean")
    options = {"rounds": 6, "rate": 0.3, "depth": 2, "l1": 0.5, "row_fraction": 0.7, "feature_fraction": 0.7, "patience": 99}
    one, two = (boosting.fit_boosted(df.repartition(n), ["a", "b", "c"], ["runs"], "val", **options)["runs"] for n in (1, 4))
    assert one.losses == pytest.approx(two.losses) and one.predict(x) == pytest.approx(two.predict(x))
    assert one.trees and all(len(set(t.feature) - {-1}) <= 2 for t in one.trees)
    gains = one.gains()
    assert sum(gains.values()) == pytest.approx(1) and max(gains, key=gains.get) == "b"
    keys = r.integers(-(2**63), 2**63 - 1, 20_000)
    shares = [boosting.in_bag(keys, n, 0.7) for n in range(3)]
    assert all(abs(s.mean() - 0.7) < 0.02 for s in shares) and abs((shares[0] & shares[1]).mean() - 0.49) < 0.02


def test_l1_shrinks_sums():
    assert boosting.shrunk(np.array([-2.0, -0.3, 0.0, 0.4, 3.0]), 0.5).tolist() == [-1.5, -0.0, 0.0, 0.0, 2.5]


def test_boosting_stops_early_and_knows_missing_numbers(spark):
    r = np.random.default_rng(9)
    data = [(float(r.normal()), float(r.poisson(3)), bool(i % 3 == 0)) for i in range(300)] + [(None, 4.0, None), (1.0, None, False)]
    df = spark.createDataFrame(data, "a double, runs double, val boolean")
    m = boosting.fit_boosted(df, ["a"], ["runs"], "val", rounds=40, rate=0.5, depth=3, least=2, patience=3)["runs"]
    assert len(m.losses) < 41 and len(m.trees) == int(np.argmin(m.losses)) and np.isfinite(m.predict(np.array([[np.nan], [0.0]]))).all()
    flat = boosting.fit_boosted(df.withColumn("a", F.lit(None).cast("double")), ["a"], ["runs"], "val", rounds=2)["runs"]
    assert np.isfinite(flat.predict(np.array([[np.nan]]))).all()


def test_boosted_trees_beat_the_linear_model_where_runs_bend(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 2))
    y = r.poisson(np.exp(0.5 + np.abs(x[:, 0])))
    df = spark.createDataFrame([(float(a), float(b), float(t), i % 3 == 0) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, runs double, val boolean")
    linear = M.score(df, M.fit_runs(df.where("not val"), ["a", "b"], "runs"), ["a", "b"]).where("val").toPandas()
    model = boosting.fit_boosted(df, ["a", "b"], ["runs"], "val", rounds=25, rate=0.2, depth=3)["runs"]
    boosted = M.score_any(df, model, ["a", "b"], "prediction").where("val").toPandas()
    error = lambda d: ((d.runs - d.prediction) ** 2).mean() ** 0.5
    assert error(boosted) < 0.8 * error(linear)
