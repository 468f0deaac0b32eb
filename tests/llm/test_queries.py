"""The registered queries on the smallest tables, and the pipeline's stages one by one."""

import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gameline.llm import decontaminate, ngram_join, registry, toxicity
from gameline.llm.common import stored, table
from pyspark.sql import functions as F
from tests.conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "pipeline" and not n.startswith("op12")])
def test_a_row_for_every_input_row(spark, name):
    out = registry.queries()[name](spark, SF)
    key = "page_id" if name.startswith("op4") else "query_id" if name.startswith("op9") else "doc_id"
    source = "pages" if key == "page_id" else "documents"
    rows = out.count()
    assert rows == (table(spark, SF, source).count() if key != "query_id" else 20 * out.select("query_id").distinct().count())


def test_stages(spark):
    docs = table(spark, SF, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        after[name] = docs
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.join(before, "doc_id", "left_anti").isEmpty() and docs.count() <= before.count()
        if name == "toxicity":
            scored = toxicity.toxicity_scores(before, table(spark, SF, "labels"), F.lit(True))
            assert docs.count() == scored.where("predicted = 0").count()
        if name == "near_duplicates":
            c = ngram_join.ngram_components(before, 5, 80)
            assert docs.count() == c.select("component_id").distinct().count()
        if name == "benchmark":
            assert decontaminate.contaminated(docs, table(spark, SF, "benchmark")).where("contaminated").isEmpty()
    assert after["mixing"].count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_nearest_recall_at_the_larger_size(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = np.asarray(t["vec_id"]), np.array(t["embedding"].to_pylist(), dtype=np.float64)
    found: dict = {}
    for r in registry.queries()["op9_nearest"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(found[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9
