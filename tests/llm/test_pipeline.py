"""The pipeline's stages, one after the other, against brute force on a small corpus with nulls, copies and odd rows."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gameline.llm import mixing, ngram_join, toxicity
from gameline.llm.common import stored
from tests.llm.test_small_tables import WORDS, lower, sets, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def corpus():
    r = random.Random(21)
    rows = [(i, t) for i, t, _ in texts(60)]
    for i in range(100, 260):
        w = [r.choice(WORDS) for _ in range(70)]
        if i % 5 == 0:
            for _ in range(5):
                w[r.randrange(70)] = r.choice(["vrotzik", "grumpaz", "skelbur"])
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (301, "other text of the same id"), (302, " \n "), (None, "no id here"), (None, None), (303, "Kx!ri,ta. " * 30)]
    rows.append((304, "before " + " ".join(f"item{k}" for k in range(12)) + " after"))
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b"]), None if t is None else len(t), 0.5, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(100, 260)] + [(None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"ITEM{k}" for k in range(12))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(row):
    return str(row)


def kept_texts(rows, length=100):
    """Texts without repeated strings, by looking at every string of the corpus in order."""
    seen, out = set(), []
    for n, (i, t, *_) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] or "")):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - length + 1 if i is not None else 0):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((n, bytes(c for c, m in zip(data, mask, strict=True) if not m).decode("utf-8", "ignore"), any(mask)))
    return [x for _, *x in sorted(out)]


def test_stages_by_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)  # clusters of several pieces
    docs = stored(spark.createDataFrame(corpus(), SCHEMA))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_passages", "benchmark", "mixing"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=key)

    after = stored(stages["toxicity"](spark, docs, sf_dir))
    assert after.columns == corpus_pipeline.COLUMNS
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True), keep_text=True)
    assert rows(after) == rows(scores.where("score < 0.3"))
    gone = {r[0] for r in rows(docs)} - {r[0] for r in rows(after)}
    assert len(gone & set(range(100, 260, 5))) >= 31 and len(gone) <= 34

    before, after = after, stored(stages["near_duplicates"](spark, after, sf_dir))
    given = rows(before)
    s = sets([(n, r[1], None) for n, r in enumerate(given)], 5)
    root = {n: n for n in s}
    for a, b in itertools.combinations(sorted(s), 2):
        same_id = given[a][0] is not None and given[a][0] == given[b][0]
        near = s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
        if same_id or (near and given[a][0] is not None and given[b][0] is not None):
            x, y = sorted((root[a], root[b]))
            root = {n: x if v == y else v for n, v in root.items()}
    groups: dict = {}
    for n, r in enumerate(given):
        groups.setdefault(root[n], []).append(r)
    want = []
    for g in groups.values():
        if g[0][0] is None:
            want += g
        else:
            least = min(r[0] for r in g)
            want.append(min((r for r in g if r[0] == least), key=lambda r: (r[1] is not None, r[1] or "")))
    assert rows(after) == sorted(want, key=key) and len(want) < len(given) - 10

    before, after = after, stored(stages["repeated_passages"](spark, after, sf_dir))
    given = rows(before)
    want = []
    for r, (text, cut) in zip(given, kept_texts(given), strict=True):
        if not cut:
            want.append((r[0], r[1] or "", *r[2:]))
        elif text.strip(" \t\n\v\f\r"):
            want.append((r[0], text, r[2], r[3], len(text)))
    assert rows(after) == sorted(want, key=key) and sum(len(r[1]) for r in want) < sum(len(r[1] or "") for r in given) - 300

    before, after = after, stored(stages["benchmark"](spark, after, sf_dir))
    item = [f"item{k}" for k in range(12)]
    windows = [item[k : k + 10] for k in range(3)]

    def leaks(text):
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text))
        return any(w[k : k + 10] in windows for k in range(len(w)))

    want = [r for r in rows(before) if not leaks(r[1])]
    assert rows(after) == want and len(want) < before.count()

    out = stages["mixing"](spark, after, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{after.inputFiles()[0].rsplit('/', 1)[0].removeprefix('file:')}/*.parquet')")
    wanted = con.execute(f"SELECT doc_id, n_tokens, round(probability, 6) AS p FROM ({mixing.OP8_SQL}) WHERE sampled").fetchall()
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.n_tokens, round(r.probability, 6))) for r in out.collect()) and wanted


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name
