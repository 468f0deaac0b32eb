"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from gameline.plans import catalog, runs
from tests.conftest import SF

HAVE = os.path.isdir(SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or (not isinstance(x, str | list) and pd.isna(x)):
        return None
    if isinstance(x, dt.datetime | dt.date):
        return x.isoformat().removesuffix("T00:00:00")
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(x) for x in row]) for row in df[columns].astype(object).values.tolist())


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert table(catalog.queries()[name](spark, SF).toPandas()) == table(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_models_give_finite_numbers(spark, name):
    out = catalog.queries()[name](spark, SF).toPandas()
    assert len(out) and out.select_dtypes("number").notna().all().all()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if HAVE:
        assert e.entry(spark).count() > 0


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_model_reports_are_sane(spark):
    q = catalog.queries()
    for name in ("m2_a4_run_report", "m2_u3_team_run_model"):
        r = q[name](spark, SF).toPandas()
        assert sorted(set(r.split)) == ["test", "train", "val"] and set(r.side) == {"home", "away"}
        # runs are 0 to 9 and have nothing to do with the features, so the error is about that of their mean
        assert r.rmse.between(2, 4).all() and (r.mae <= r.rmse).all() and r[r.split == "train"].mean_pred.sub(4.5).abs().max() < 0.5
    win = q["m3_win_model"](spark, SF).toPandas()
    assert win.auc.between(0, 1).all() and win.set_index("split").auc["train"] > 0.5
    gains = q["t3_k7_importances"](spark, SF).toPandas()
    assert gains.gain.is_monotonic_decreasing or sorted(gains.gain)[::-1] == gains.gain.tolist()
    assert gains.gain.sum() == pytest.approx(1) and set(gains.feature) == {f"{s}_{c}" for s in ("home", "away") for c in ("win_pct_30", "runs_for_30", "runs_against_30", "avg_runs_scored_60", "avg_runs_allowed_60", "games_in_window_60")}


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_reports_of_the_models_by_brute_force(spark):
    models, rows, names = runs.boosted_runs(spark, SF)
    frame = rows.toPandas()
    report = catalog.queries()["m2_a4_boosted_report"](spark, SF).toPandas().set_index(["split", "side"])
    model, kept, features = runs.win_model(spark, SF)
    scored = runs.M.score(kept, model, features).withColumn("p", runs.vector_to_array("probability")[1]).select("split", "p", "y")
    for (split, side), r in report.iterrows():
        part = frame[frame.split == split]
        p = models[f"{side}_runs"].predict(part[names].to_numpy(dtype=float))
        y = part[f"{side}_runs"].to_numpy(dtype=float)
        assert r.mae == pytest.approx(abs(y - p).mean(), abs=1e-5) and r.rmse == pytest.approx(((y - p) ** 2).mean() ** 0.5, abs=1e-5)
        assert r.mean_true == pytest.approx(y.mean(), abs=1e-5) and r.mean_pred == pytest.approx(p.mean(), abs=1e-5)
    said = runs.A.binary_report(scored, "p", "y").toPandas().set_index("split")
    for split, part in scored.toPandas().groupby("split"):
        p, y = part.p.to_numpy(), part.y.to_numpy()
        pos, neg = p[y == 1], p[y == 0]
        auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
        assert said.n[split] == len(p) and said.auc[split] == pytest.approx(auc) and said.brier[split] == pytest.approx(((p - y) ** 2).mean())
        assert said.log_loss[split] == pytest.approx(-np.log(np.where(y == 1, p, 1 - p)).mean()) and said.mean_p[split] == pytest.approx(p.mean())
    gains = [(g.feature, g.gain) for g in catalog.queries()["t3_k7_importances"](spark, SF).collect()]
    assert gains == sorted(gains, key=lambda x: (-x[1], x[0]))
    assert dict(gains) == pytest.approx(dict(zip(features, model.stages[-1].featureImportances.toArray(), strict=True)))
