"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gameline.llm import decontaminate, graph, html_text, license_scan, lsh_forest, mixing, ngram_join, ppm, quality, suffix_dedup, toxicity, trees

DOCS = "doc_id long, text string, lang string"
WORDS = [a + b for a in "kolm ta ri ne su".split() for b in "x ba de fo gi hu".split()]


def texts(n=60, seed=3):
    """Invented texts with exact and near copies, a shared passage, nulls, empty, blank and long ones."""
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    out = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 150))) for _ in range(n // 2)]
    out += [out[2], out[2], "", None, " \n ", out[3] + " é" * 70, "Á " + passage, passage.upper() + " end", "x" * 5000 + passage, "ab " * 400]
    while len(out) < n:
        w = r.choice([t for t in out if t and len(t) > 200]).split()
        w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return [(i, t, "en") for i, t in enumerate(out)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sets(rows, k):
    out = {}
    for i, t, _ in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", lower(t))
        out[i] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_components(spark, k, percent):
    rows = texts()
    s = sets(rows, k)
    root = {i: i for i in s}
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if v == y else v for i, v in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOCS), k, percent).collect()}
    assert got == {i: (len(s[i]), root[i]) for i in s}


def test_ngram_join_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b", "x"), (2, "", "x")], DOCS)
    assert sorted(tuple(r) for r in ngram_join.ngram_components(d).collect()) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]


def test_words_that_fool_polynomial_hashes_stay_apart(spark):
    """A Thue-Morse word of 1,024 letters and its complement have one hash modulo 2**64, whatever the base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rows = [(1, word, "x"), (2, word.translate(str.maketrans("ab", "ba")), "x"), (3, word, "x")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ngram_components_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 2)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    test_ngram_components(spark, 5, 80)


def test_blocked_product_links_the_rest_of_a_cluster():
    r = np.random.default_rng(5)
    base = r.choice(1 << 40, 100, replace=False).astype(np.uint64)
    many = [np.sort(np.concatenate([base[i : i + 80], r.choice(1 << 40, 4).astype(np.uint64)])) for i in range(15)]
    got = set(ngram_join._product([x.tobytes() for x in many], [x.tobytes() for x in many], 80))
    want = {(i, j) for i, j in itertools.product(range(15), repeat=2) if 100 * len(set(many[i]) & set(many[j])) >= 80 * len(set(many[i]) | set(many[j]))}
    assert got == want and len(want) > 15


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def removed(rows, length):
    seen, out = set(), {}
    for key, t, _ in sorted(((i, t or "", c) for i, t, c in rows), key=lambda x: x[:2]):
        data = t.encode()
        mask = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        out.setdefault(key, []).append((len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(c for c, m in zip(data, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [3, 60_000])
def test_suffix_dedup(spark, hot, monkeypatch):
    rows = texts()
    rows += [(5, rows[9][1], "en"), (5, "z" * 300, "en")]
    monkeypatch.setattr(suffix_dedup, "_repeats", _with_hot(suffix_dedup._repeats, hot))
    d = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))
    out = suffix_dedup.suffix_dedup(d, 100)
    assert "lang" in out.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert len(r.kept) == r.n_bytes - r.n_removed
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in removed(rows, 100).items()}


def _with_hot(f, hot):
    def make(each):
        run = f(each)

        def other(batches):
            suffix_dedup.HOT = hot
            yield from run(batches)

        return other

    return make


def test_merged_transforms_find_the_repeats():
    r = random.Random(9)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(12, 30))).encode() for _ in range(40)]
    data, size = np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(s) for s in strings])
    group, string, offset = suffix_dedup.merged_repeats(data, size, 12, 5)
    found = {}
    for g, s, o in zip(group.tolist(), string.tolist(), offset.tolist(), strict=True):
        found.setdefault(g, set()).add((s, o))
    want = {}
    for i, s in enumerate(strings):
        for o in range(len(s) - 11):
            want.setdefault(s[o : o + 12], set()).add((i, o))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("last", [5_536, 5_537, 60_000])
def test_slot_counts_do_not_wrap(last):
    units = [{"block": 0, "once": b"", "many": np.array([3], dtype="u4").tobytes(), "count": np.array([n], dtype="u4").tobytes()} for n in (60_000, last)]
    out = next(suffix_dedup._repeats(16)(iter([pa.RecordBatch.from_pylist(units, schema=suffix_dedup._SLOTS)]))).to_pylist()[0]
    assert np.unpackbits(np.frombuffer(out["bits"], dtype=np.uint8))[3] == 1 and np.frombuffer(out["hot"], dtype="u4").tolist() == [3]


def test_suffix_dedup_across_unit_borders(spark):
    """A text longer than a unit, with passages that repeat inside it, across its units' borders and in another text."""
    r = random.Random(14)
    words_ = lambda n: " ".join("".join(r.choices("abcdefgé", k=r.randrange(2, 9))) for _ in range(n))
    passage = words_(40)
    long = ""
    while len(long.encode()) < 700_000:
        long += words_(6000) + " " + passage + " "
    border = long.encode()[suffix_dedup._UNIT - 150 : suffix_dedup._UNIT + 150].decode("utf-8", "ignore")
    rows = [(1, long, "en"), (2, f"{words_(9)} {border} {passage}", "en"), (3, "z" * 600_000, "en")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS), 100, keep_text=False, keep_bytes=False).collect()}
    assert got == {i: x[0] for i, x in removed(rows, 100).items()} and got[2][1] > 400 and got[3][1] == 599_999


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    r = suffix_dedup.suffix_dedup(spark.createDataFrame([(None, "a" * 300, "x")], DOCS)).first()
    assert (r.n_bytes, r.n_removed) == (300, 0)


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 120)  # several blocks of items
    r = random.Random(4)
    bench = [(i, " ".join(r.choice(WORDS[:9]) for _ in range(n))) for i, n in enumerate((3, 12, 15, 10, 9, 2, 30))] + [(6, None), (None, "kx"), (8, "  "), (1, "one more text of the item")]
    rows = texts(30) + [(100 + i, f"{WORDS[20]}; {(t or '').upper()}-{WORDS[21]} {(t or '')[:40]}", "x") for i, (_, t) in enumerate(bench)] + [(7, None, "x")]
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(t))
    window: dict = {}
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n and i is not None else 0):
            window.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    want = []
    for i, t, _ in rows:
        w, hit, items = words(t), set(), set()
        for x, own in window.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    items |= own
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    out = decontaminate.contaminated(spark.createDataFrame(rows, DOCS).withColumn("items", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == sorted(want)
    none = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_decontamination_in_pieces(spark, monkeypatch):
    """Candidates in pieces, a long text, an empty table of documents."""
    r = random.Random(6)
    bench = spark.createDataFrame([(i, " ".join(r.choices(["kx", "ri", "ta"], k=14))) for i in range(30)], "item_id long, text string")
    long = " ".join(r.choices(["kx", "ri", "ta", "mm"], k=20_000))
    docs = spark.createDataFrame([(1, long, "x"), (2, " ".join(r.choices(["kx", "ri", "ta"], k=300)), "x"), (3, "", "x"), (None, "kx " * 30, "x")], DOCS)
    read = lambda: sorted(tuple(x) for x in decontaminate.contaminated(docs, bench).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", "n_items", "items_sha256").collect())
    want = read()
    assert [x[1] for x in want] == [30, 20_000, 300, 0] and want[1][2] > 0
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    assert read() == want
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_ppm_is_a_probability_and_the_base_is_exact(spark):
    rows = [(i, t, c) for i, t, c in texts(40)]
    d = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.col("doc_id") % 3 == 1)
    got = {r.doc_id: r for r in ppm.ppm_scores(d, ~F.col("held_out")).collect()}
    words = {i: [*re.findall("[^\\x20\\x09-\\x0D]+", lower(t)), None] for i, t, _ in rows}
    count: dict = {}
    for i, w in words.items():
        if i % 3 != 1:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0
    # the probabilities of all next bytes after any context sum to 1
    keys = np.unique(np.concatenate([k for k, _, _ in ppm._keys([t for i, t, _ in rows if i % 3 != 1])]), return_counts=True)
    edges = []
    for k in range(ppm.ORDER + 1):
        e, inverse = np.unique(keys[0] & ppm._mask(k + 1), return_inverse=True)
        edges.append((e, np.bincount(inverse, weights=keys[1]).astype(np.int64)))
    trie = ppm.build_trie(edges)
    for context in (b"kolmx", b"ta ri", b"\xff\xff\xffab", b"zzzzz", b"qq so"):
        key = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert (10.0 ** ppm.code_lengths(trie, key.astype(np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_rare_words_go_through_the_join(spark, monkeypatch):
    d = spark.createDataFrame(texts(40), DOCS)
    learn = F.col("doc_id") % 3 != 1
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in ppm.ppm_scores(d, learn).collect())
    monkeypatch.setattr(ppm, "MOST_WORDS", 12)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in ppm.ppm_scores(d, learn).collect()) == want


def test_rare_edges_go_through_the_joins(spark, monkeypatch):
    rows = texts(40)
    d = spark.createDataFrame([*rows, (100, "kolmzz qux ta\x00ri 日本 ne", "en")], DOCS)
    keys = np.unique(np.concatenate([k for k, _, _ in ppm._keys([t for i, t, _ in rows if i % 3 != 1])]), return_counts=True)
    edges = []
    for k in range(ppm.ORDER + 1):
        e, inverse = np.unique(keys[0] & ppm._mask(k + 1), return_inverse=True)
        edges.append((e, np.bincount(inverse, weights=keys[1]).astype(np.int64)))
    trie = ppm.build_trie(edges)
    want = {r.doc_id: ppm.code_lengths(trie, next(ppm._keys([r.text]))[0]).sum() for r in d.collect()}
    for most in (2_000_000, 50, 0):
        monkeypatch.setattr(ppm, "MOST_EDGES", most)
        got = {r.doc_id: r.score for r in ppm.ppm_scores(d, (F.col("doc_id") % 3 != 1) & (F.col("doc_id") < 100)).collect()}
        assert got == pytest.approx(want, rel=1e-6)


def test_ppm_without_training(spark):
    r = ppm.ppm_scores(spark.createDataFrame([(1, "ab", "x"), (2, None, "x")], DOCS), F.lit(False)).orderBy("doc_id").collect()
    assert [x.n_known for x in r] == [0, 0] and r[0].score == pytest.approx(-3 * np.log10(256)) and r[0].train_tokens == 0


def test_ppm_of_nothing_repeated_rows_long_texts_and_clashing_columns(spark):
    assert ppm.ppm_scores(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
    long = "kolm ta " * 150_000
    rows = [(1, "kolm ta", "x"), (1, "kolm ta", "x"), (2, long, "x"), (None, "kolm", "x")]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("score", "edges", "key", "n", "kind", "row", "times")})
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.score) for r in ppm.ppm_scores(d, F.lit(True)).collect()), key=str)
    assert [x[:3] for x in got] == [(0, 2, 2), (1, 3, 3), (1, 3, 3), (2, 300_001, 300_001)] and got[1] == got[2]
    out = ppm.ppm_scores(d, F.lit(True))
    assert {"key", "n", "kind"} <= set(out.columns) and out.where("key = 'clash'").count() == 4
    keys = np.concatenate([k for k, _, _ in ppm._keys([t for _, t, _ in rows])])
    edges = [np.unique(keys & ppm._mask(k + 1), return_counts=True) for k in range(ppm.ORDER + 1)]
    trie = ppm.build_trie([(e, n.astype(np.int64)) for e, n in edges])
    want = ppm.code_lengths(trie, np.concatenate([k for k, _, _ in ppm._keys([long])])).sum()
    assert got[3][3] == pytest.approx(want, rel=1e-6)


def labelled(n=240):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [r.choice(WORDS) for _ in range(80)]
        if bad:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["vrotzik", "grumpaz", "skelbur"])
        rows.append((i, (" ".join(w).upper() + "!!" * 40) if i % 5 == 0 else " ".join(w), "en"))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return rows + [(1000, None, "en"), (1001, "", "en"), (1001, "", "en"), (None, "x", "en")], labels


@pytest.mark.parametrize(("f", "label", "least"), [(toxicity.toxicity_scores, "toxic", 0.95), (quality.quality_scores, "quality", 0.99)])
def test_classifiers_hold_out(spark, f, label, least):
    rows, labels = labelled()
    d = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = f(d, lab, F.col("doc_id") % 3 != 1).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    y = {i: (q if label == "quality" else t) for i, q, t in labels}
    held = [(r.score, y[r.doc_id]) for r in got if r.doc_id in y and r.doc_id % 3 == 1]
    wins = [(a > b) + (a == b) / 2 for a, i in held for b, j in held if i == 1 and j == 0]
    assert np.mean(wins) >= least
    changed = spark.createDataFrame([(i, 1 - q, 1 - t) if i % 3 == 1 else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in f(d, changed, F.col("doc_id") % 3 != 1).collect()} == {r.doc_id: r.score for r in got}


def test_quality_statistics_by_brute_force():
    some = [t for _, t, _ in texts(40)] + ["A b! a  B?\n\nx | [1] 22\nx | [1] 22", "ÄÖ ß", "\t"]
    got = quality.statistics(some)
    for t, row in zip(some, got, strict=True):
        t = t or ""
        data = t.encode()
        w = re.findall("[^\\x20\\x09-\\x0D]+", lower(t))
        n, size = max(len(w), 1), max(len(data), 1)
        upper, small = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
        assert row[:2].tolist() == pytest.approx([np.log1p(len(data)), np.log1p(len(w))])
        assert row[2] == pytest.approx((len(data) - len(re.findall("[ \\n\\r\\t\\v\\f]", t))) / n)
        assert row[3 + 1] == pytest.approx(small / size) and row[3 + 2] == pytest.approx(upper / size) and row[3 + 3] == pytest.approx(len(re.findall("[0-9]", t)) / size)
        assert row[3 + 11] == pytest.approx(sum(c >= 128 for c in data) / size) and row[15] == pytest.approx(upper / max(small + upper, 1))
        pairs = list(zip(w, w[1:]))
        lines = t.split("\n")
        want = [len(set(w)) / n, max(map(w.count, set(w)), default=0) / n, len(set(pairs)) / max(len(pairs), 1) if pairs else row[-5], sum(x == y for x, y in pairs) / n, len(lines), len(set(lines)) / len(lines), len(data) / len(lines)]
        assert row[-7:].tolist() == pytest.approx(want)


def test_classifiers_without_labels(spark):
    d, lab = spark.createDataFrame([(1, "a b", "x")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(d, lab, F.lit(True)).first().score == 0.5
    assert toxicity.toxicity_scores(d, lab, F.lit(True)).first().score == 0.5


def test_toxicity_by_brute_force(spark):
    """Scores of whole texts, each window compressed by a compressor of its own."""
    import xxhash
    import zstandard

    rows, labels = labelled()
    rows.append((1002, " ".join(random.Random(5).choices(WORDS, k=150_000)) + " vrotzik", "en"))  # about 0.6 MB
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 3 != 1
    model = toxicity.fit(d, lab, learn, "toxic", toxicity.SAMPLE)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(d, lab, learn).collect() if r.doc_id is not None}

    def size(window, content):
        c = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(window))

    for i, t, _ in rows[::20] + rows[-4:-1]:
        if i is None:
            continue
        w = re.findall("[^\\x20\\x09-\\x0D]+", lower(t))
        w = [x.encode() + xxhash.xxh3_64(x.encode()).digest() for x in w]
        runs = [b" " + b" ".join(w[k : k + 6]) + b" " for k in range(0, max(1, len(w) - 3), 3)] if w else []
        tail = bytes([*range(1, 9), *range(14, 32)])
        gain = [size(x + tail, model["pair"][1]) - size(x + tail, model["pair"][0]) for x in runs]
        beyond = [sum(g >= k for g in gain) for k in range(10, 22)]
        z = model["weights"][0] + sum(model["weights"][1 + k] * np.log1p(b) + model["weights"][13 + k] * np.log1p(100 * b / max(len(gain), 1)) for k, b in enumerate(beyond))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-min(max(z, -30), 30))), rel=1e-9)
    assert got[1002] > 0 and toxicity.toxicity_scores(d.limit(0), lab, learn).count() == 0


def test_held_out_toxicity_by_language():
    """Documents of sf0.1: most toxic ones are caught, few others flagged, in each language. One process, no Spark."""
    d = "/root/testdata/sf0.1/"
    docs = pq.read_table(d + "documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    df = docs.merge(pq.read_table(d + "labels.parquet").to_pandas(), on="doc_id")
    df = df[df.toxic.isin([0, 1])]
    crc = np.array([zlib.crc32(str(i).encode()) for i in df.doc_id])
    sample, held = df[crc % 4 != 2].assign(half=(crc[crc % 4 != 2] >> 8) % 2), df[crc % 4 == 2]
    pick = lambda rows, y: list(rows[rows.toxic == y].text.dropna())
    x, y = [], []
    for half in (0, 1):
        own, other = sample[sample.half == half], sample[sample.half != half]
        differ = toxicity.Differ(toxicity.train_dictionaries(pick(own, 1), pick(own, 0)))
        x += [differ.features(t) for t in other.text]
        y += list(other.toxic)
    weights = toxicity.calibrate(np.array(x), np.array(y, dtype=np.float64))
    differ = toxicity.Differ(toxicity.train_dictionaries(pick(sample, 1), pick(sample, 0)))
    flagged = np.array([differ.features(t) @ weights for t in held.text]) >= np.log(0.3 / 0.7)
    toxic = held.toxic.to_numpy() == 1
    assert flagged[toxic].mean() >= 0.85 and flagged[~toxic].mean() <= 0.02
    for lang, most in (("en", 0.005), ("de", 0.08), ("fr", 0.06), ("es", 0.03)):
        assert flagged[~toxic & (held.lang == lang).to_numpy()].mean() <= most, lang


def test_copies_do_not_make_words_telling():
    r = random.Random(3)
    text = lambda *own: " ".join(w for _ in range(12) for w in [*r.choices(WORDS, k=6), *own])
    copy = text("qarn")  # the same text again and again, qarn always after the same words
    toxic = [text("zloop") for _ in range(20)] + ["x " + " ".join(["abc", "def", "qarn"] * 5)] * 9
    found = b" ".join(toxicity.telling_stretches(toxic, [text() for _ in range(40)] + [copy]))
    assert b"zloop" in found and b"qarn" not in found


def test_sample_bytes_bound_the_texts_that_are_learned_from(spark, monkeypatch):
    rows, labels = labelled()
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 30_000)
    assert toxicity.fit(d, lab, F.lit(True), "toxic", 200) is not None
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    assert toxicity.fit(d, lab, F.lit(True), "toxic", 200) is None


def test_tree_predictions_by_walking(spark):
    r = np.random.default_rng(4)
    x = r.random((300, 5)).round(1)
    model = trees.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=12, depth=3)
    for row, p in zip(x, trees.predict(model, x), strict=True):
        z = model["base"]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
            node = 0
            for _ in range(model["depth"]):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            z += value[node - 7]
        assert p == pytest.approx(1 / (1 + np.exp(-z)))
    d = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(d, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).count() == 0
    long = spark.createDataFrame([(1, "ab cd. " * 200_000, "x")], DOCS)
    assert quality.quality_scores(long, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).first().score == 0.5


def test_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = trees.predict(trees.fit(x[:1500], y[:1500]), x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">ax</a></li><li><a href="/b">bx</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this.</div><article><h1>%s</h1><p><b>%s one &lt;two&gt;
  three<br><p>%s four&nbsp;five.</p></article><footer>&copy; somebody</footer>"""


def test_html_text(spark):
    r = random.Random(6)
    some = lambda: " ".join(r.choice(WORDS) for _ in range(30)) + "."
    parts = [(some(), some(), some()) for _ in range(40)]
    rows = [(i, "u", PAGE % p) for i, p in enumerate(parts)] + [(100, "u", None), (101, None, ""), (102, "u", "<nav><a href=x>only</a></nav>"), (103, "u", "<p unfinished")]
    got = {x.page_id: x for x in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    for i, (a, b, c) in enumerate(parts):
        assert got[i].text == f"{a}\n{b} one <two> three\n{c} four five." and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == got[103].text == "" and got[101].n_chars == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_articles_and_with_odd_markup(spark):
    r = random.Random(7)
    some = lambda n=30: " ".join(r.choice(WORDS) for _ in range(n)) + "."
    page = '<html><body><nav><ul><li><a href="/a">ax</a></li><li><a href="/b">bx</a></li></ul></nav><main class="content"><h1>%s</h1>%s</main><footer>&copy; somebody</footer></body></html>'
    parts = [(some(6), [some() for _ in range(4)]) for _ in range(20)]
    rows = [(i, page % (h, "".join(f"<p>{t}</p>" for t in ts))) for i, (h, ts) in enumerate(parts)]
    a, b, c = some(), some(), some()
    odd = {
        "label": (f'<p data-y="left">{a}</p><p data-y="0">{b}</p><p data-y=1>{c}</p>', f"{a}\n{b}\n{c}"),
        "button": (f"<p>{a}</p><button>go<p>{b}</p><p>{c}</p>", f"{a}\ngo\n{b}\n{c}"),
        "closed button": (f"<p>{a}<button>go</button></p><p>{b}</p><p>{c}</p>", f"{a}\n{b}\n{c}"),
        "svg": (f'<p>{a}</p><svg width="1"/><p>{b}</p><svg><path d="M0"/></svg><p>{c}</p>', f"{a}\n{b}\n{c}"),
        "math": (f"<p>{a} <math><mi>x</mi></math></p><p>{b}</p><p>{c}</p>", f"{a} x\n{b}\n{c}"),
        "slash": (f"<p>{a} \\1 \\g</p><p>{b}</p><p>{c}</p>", f"{a} \\1 \\g\n{b}\n{c}"),
    }
    rows += [(100 + i, page % (some(6), x)) for i, (x, _) in enumerate(odd.values())]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, page % (some(6), f"<p>{a}</p>" * 20_000))]
    got = {x.page_id: x.text for x in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    for i, (h, ts) in enumerate(parts):
        assert got[i] == "\n".join([h, *ts])
    for i, (name, (_, want)) in enumerate(odd.items()):
        assert got[100 + i].split("\n", 1)[1] == want, name
    assert got[200] == got[0] and got[201].count("\n") == 20_000
    # the articles of a table's own pages may have attributes
    own = [(i, h.replace("<main class", "<ARTICLE lang=en class").replace("</main>", "</article >")) for i, h in rows[:20]]
    again = {x.page_id: x.text for x in html_text.extract_pages(spark.createDataFrame(own, "page_id long, html string")).collect()}
    assert all(again[i] == "\n".join([h, *ts]) for i, (h, ts) in enumerate(parts))


def test_inner_parts_of_articles_are_kept():
    some = "<p>" + " ".join(WORDS[:20]) + ", and so on.</p>"
    model = html_text.fit([])
    parts = {"table": "<table class=infobox><tr><th>qborn</th><td>qplace</td></tr></table>", "figure": "<figure><img src=x><figcaption>qcaption</figcaption></figure>",
        "summary": "<details><summary>qsum</summary><p>qmore text, here.</p></details>", "list": "<dl><dt>qterm</dt><dd>qmeans this.</dd></dl>"}
    for name, part in parts.items():
        for body in (part + some * 4, some * 2 + part + some * 2, some * 4 + part):
            page = f"<html><body><nav><ul><li><a href=/>home</a></li><li><a href=/n>news</a></li></ul></nav><article><h1>qtitle</h1>{body}</article><footer>&copy; nobody</footer></body></html>"
            text = html_text.main_texts([page], model)[0]
            assert set(re.findall(r"\bq\w+", part)) <= set(text.split()) | set(re.findall(r"\w+", text)), (name, text)
            assert "home" not in text and "nobody" not in text


@pytest.mark.parametrize("page", ["<button>x " * 100_000, "<div>x " * 140_000, '<a x="' * 170_001, "<div>" * 80_000 + "</p>" * 100_000, "<svg>" * 90_000 + "<p>" + "</svg>" * 90_000,
    "<b><p>x" * 100_000, "<ul><li>x" * 80_000, "<p x=" + " " * 900_000, "<" * 900_000], ids=range(9))
def test_long_pages_with_nothing_closed(page):
    model = html_text.fit([])
    start = time.monotonic()
    html_text.main_texts([page], model)
    assert time.monotonic() - start < 60  # squares of these lengths take hours


def test_controls_and_quotes():
    f = html_text.Forest()
    f.add(0, "<p>a<button>b<select>c</select>d</button>e</p><p title=don't>f<svg>g<p>h</svg>i</p><p title='>'>j<canvas/>k</canvas></p><p x=\"l>m")
    assert [t for _, t in f.blocks] == ["ae", "fg", "hi", "jk"]


def test_node_features_by_brute_force():
    """Sums over subtrees and marks of ancestors, node by node."""
    r = random.Random(6)
    bits = ["<div class=ad>", "<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<nav>", "</nav>", "<a href=x>lk</a>", "one, two. ", "<form id=search>", "</form>", "<b>x</b>"]
    f = html_text.Forest()
    for page in range(30):
        f.add(page, "".join(r.choice(bits) for _ in range(r.randrange(40))))
    f.arrays()
    n, parent = len(f.page), f.parent.tolist()
    chains = []
    for i in range(n):
        chain = [i]
        while parent[chain[-1]] >= 0:
            chain.append(parent[chain[-1]])
        chains.append(chain)
    own = np.array([[r.randrange(5), r.randrange(2)] for _ in range(n)], dtype=np.float64)
    up = np.zeros(n)
    for i, chain in enumerate(chains):
        for a in chain:
            up[a] += own[i, 0]
    assert (f.up(own[:, 0]) == up).all()
    assert (f.down(own[:, 1:])[:, 0] == [max(own[a, 1] for a in chain) for chain in chains]).all()
    x = f.features()
    size = [sum(len(t) for node, t in f.blocks if i in chains[node]) for i in range(n)]
    kinds, hits = len(html_text._GROUPS), len(html_text._WORDS)
    at = kinds + hits + hits + 6  # depth comes here
    assert (x[:, at] == [len(c) - 1 for c in chains]).all() and np.allclose(x[:, at + 1], np.log1p(size))
    assert np.allclose(x[:, -2], [s / max(size[c[-1]], 1) for s, c in zip(size, chains, strict=True)])


def test_decoding_keeps_nothing_below_a_dropped_node():
    f = html_text.Forest()
    f.add(0, "<body><div><p>a</p><div><p>b</p></div></div><p>c</p></body>")
    f.arrays()
    r = np.random.default_rng(0)
    n = len(f.page)
    for _ in range(50):
        p = r.random(n)
        kept = f.decode(p)
        assert all(kept[f.parent[i]] for i in range(1, n) if kept[i])
        q = np.clip(p, 1e-6, 1 - 1e-6)
        score = lambda k: sum(np.log(q[i]) if k[i] else np.log(1 - q[i]) for i in range(1, n))  # noqa: B023, E731
        best = max((k for k in itertools.product((False, True), repeat=n) if k[0] and all(k[f.parent[i]] for i in range(1, n) if k[i])), key=score)
        assert score(kept) == pytest.approx(score(best))


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((600, 16)).round(4)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None, *[1.0] * 15]), (780, [1.0]), (None, [1.0] * 16)]
    got = lsh_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    found, hits = {}, []
    for g in got:
        found.setdefault(g.query_id, []).append(g)
        assert g.score == pytest.approx(float(x[g.query_id] @ x[g.vec_id]), abs=1e-12) and g.query_id != g.vec_id
    assert set(found) == set(range(0, 600, 20))
    for q, rs in found.items():
        rs.sort(key=lambda g: g.rank)
        assert [g.rank for g in rs] == list(range(1, 21)) and [(-g.score, g.vec_id) for g in rs] == sorted((-g.score, g.vec_id) for g in rs)
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len({g.vec_id for g in rs} & set(np.lexsort((np.arange(600), -s))[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9
    assert lsh_forest.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).count() == 3
    assert lsh_forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1e-150, 1e30, 1e150])
def test_nearest_of_any_magnitude(spark, scale):
    """No square overflows or vanishes before the exact scores; rows of small and large magnitudes meet in one block."""
    r = np.random.default_rng(9)
    x = r.standard_normal((60, 8)) * scale
    x[50:] *= 1e-6
    got = lsh_forest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    for q in (0, 20, 40):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [v for _, v, _ in mine] == np.lexsort((np.arange(60), -s))[:20].tolist() and [t for _, _, t in mine] == pytest.approx(np.sort(s)[::-1][:20].tolist())


def test_nearest_with_repeated_ids(spark):
    """Rows that repeat an id count each as candidates; a query in several rows is asked once, by its smallest vector."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 3.0]), (2, [5.0, 1.0])]
    got = lsh_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash")), F.col("vec_id") == 0, 20).collect()
    assert [(g.rank, g.vec_id, g.score) for g in sorted(got, key=lambda g: g.rank)] == [(1, 1, 3.0), (2, 1, 2.0), (3, 2, 1.0)]


def test_mixing_with_clashing_columns_and_long_texts(spark):
    rows = [(1, "n " * 300_000, "en", "a"), (2, None, None, "a"), (2, "", "de", "b"), (None, "t t", "de", "b")]
    d = mixing.with_topic(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    d = d.withColumns({c: F.lit("clash") for c in ("c0", "c1", "probability", "sampled", "tokens")})
    got = {(r.doc_id, r.text and r.text[:2]): r for r in mixing.mixed(d).collect()}
    assert len(got) == 4 and all(r.c0 == r.c1 == r.tokens == "clash" and 0 <= r.probability <= 1 for r in got.values())
    assert [got[k].topic for k in ((1, "n "), (2, None), (2, ""), (None, "t "))] == [1, -1, -1, 0] and got[1, "n "].n_tokens == 300_000


def test_mixing_meets_the_margins(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(0, 9)) if i % 50 else None, r.choice(["en", "de", None]), r.choice("abbbbb")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"lang": {"en": 0.5, "de": 0.3, None: 0.2}, "source": {"a": 0.4, "b": 0.6}}
    got = mixing.mixed(d, {"lang": 1.0, "source": 1.0}, share=0.2, targets=want).collect()
    assert len(got) == 400
    total = sum(g.n_tokens for g in got)
    for m, shares in want.items():
        for value, share in shares.items():
            assert sum(g.n_tokens * g.probability for g in got if g[m] == value) == pytest.approx(0.2 * total * share, rel=0.02)
    assert mixing.mixed(d.limit(0), {"lang": 1.0}).count() == 0
    assert mixing.scale(np.array([9.0, 1, 1]), np.array([10.0, 10, 10]), 0.5) == pytest.approx(0.25)


def test_license_scan(spark):
    rows = [
        (1, "src/LICENSE", "MIT License\n\nReleased under the MIT License."), (2, "src/a/b/x.py", "code"), (3, "src/a/COPYING.txt", "intro\nThis work is licensed under the GNU General Public License, version 3."),
        (4, "src/a/c.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (5, "other/x", "Licensed under CC BY-NC 4.0."), (6, "other/y", None), (7, None, ""), (8, "README", "the license of this"), (9, "src/d/x.py", "x " * 9000),
    ]
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", F.lit(1))).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "src/a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: ("Apache-2.0", "Apache-2.0", None), 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None), 9: (None, "MIT", "src")}


def test_every_notice_of_the_tables_is_found(spark):
    notices = {"All rights reserved.": "Proprietary", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    rows = [(i, f"d{i}/x", f"kolm ta ri\n{t}\nne su") for i, t in enumerate(notices)] + [(100 + i, f"n{i}/x", "kolm ta ri ne su") for i in range(30)]
    rows.append((99, "both/x", "All rights reserved.\nReleased under the MIT License."))
    got = {r.doc_id: r.own_license for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values()) and got[99] == "MIT" and got[100] is None


def test_license_texts_headers_and_long_lines(spark):
    mit = next(t for n, t in license_scan.LONG_TEMPLATES if n == "MIT")
    apache = next(t for n, t in license_scan.LONG_TEMPLATES if n == "Apache-2.0").split()
    filler = " ".join(WORDS * 4)
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 X. All rights reserved.\n\n" + "\n".join(" ".join(mit.split()[i : i + 6]) for i in range(0, 90, 6))),
        (2, "a/b/x.py", "code"), (3, "c/x.py", "\n".join("# " + " ".join(apache[i : i + 5]) for i in range(0, len(apache), 5)) + "\n\ncode"),
        (4, "d/x", f"{filler} Licensed under CC BY-NC 4.0. {filler}"), (5, "e/x", filler),
    ] + [(10 + i, f"n{i}/x", filler) for i in range(30)]
    got = {r.doc_id: (r.own_license, r.license) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(1, 6)] == [("MIT", "MIT"), (None, "MIT"), ("Apache-2.0", "Apache-2.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), (None, None)]


def test_license_prefix_loses_no_line():
    r = random.Random(1)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.terms(t)})
    m = license_scan.Matcher(license_scan.TEMPLATES, 1000, {w: r.randrange(300) for w in words}, license_scan.THRESHOLD)
    for _ in range(500):
        line = " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))
        if m.line(line)[1]:
            assert m.prefix.search(line)


def test_license_versions_ties_and_other_columns(spark):
    isc = next(t for n, t in license_scan.LONG_TEMPLATES if n == "ISC")
    rows = [
        (1, "a/x", "This work is licensed under the GNU Lesser General Public License, version 2.1.", 7), (2, "a/y", isc, 7),
        (3, "b/LICENSE", "Released under the MIT License.", 7), (4, "b/COPYING", "Licensed under CC BY 4.0.", 7), (5, "b/c/x", None, 8), (5, "b/c/x", None, 8),
    ]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string, dir int").withColumn("up", F.lit(1)).withColumn("k", F.lit(2)).withColumn("near", F.lit(3))
    out = license_scan.license_scan(d)
    assert {"dir", "up", "k", "near"} <= set(out.columns)
    got = sorted((r.doc_id, r.license, r.inherited_from, r.dir, r.near) for r in out.collect())
    # both files match whole, so the smaller name counts
    assert got == [(1, "LGPL-2.1", None, 7, 3), (2, "ISC", None, 7, 3), (3, "MIT", None, 7, 3), (4, "CC-BY-4.0", None, 7, 3), (5, "CC-BY-4.0", "b", 8, 3), (5, "CC-BY-4.0", "b", 8, 3)]
    assert license_scan.license_scan(d.limit(0)).count() == 0


def test_license_cosine_by_brute_force(spark):
    """Every span, line, header and whole file against every template, without any bound."""
    r = random.Random(12)
    pool = [*WORDS[:8], *sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.terms(t)})]
    notices = [t for _, t in license_scan.TEMPLATES]
    texts_ = ["\n".join(" ".join(r.choice(pool) for _ in range(r.randrange(0, 14))) if r.random() < 0.7 else r.choice(notices)[: r.randrange(20, 200)] for _ in range(r.randrange(1, 5))) for _ in range(80)]
    every = (*license_scan.TEMPLATES, *license_scan.LONG_TEMPLATES)
    df: dict = {}
    lines = 0
    for t in texts_:
        for line in t.lower().split("\n"):
            if line.strip():
                lines += 1
                for w in set(license_scan.terms(line)):
                    df[w] = df.get(w, 0) + 1
    vocabulary = {w for _, t in every for w in license_scan.terms(t)}
    weigh = lambda w: np.log((1 + lines) / (1 + (df.get(w, 0) if w in vocabulary else 1))) + 1

    def cosine(a, b):
        x, y = ({w: p.count(w) * weigh(w) for w in set(p)} for p in (a, b))
        norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    rows = [(i, f"d{i}/{'LICENSE' if i % 3 == 0 else 'x'}", t) for i, t in enumerate(texts_)]
    got = {x.doc_id: x for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, path, t in rows:
        w = license_scan.terms(t)
        pieces = [license_scan.terms(x) for x in (*t.split("\n"), re.split("\n[^a-zA-Z0-9\n]*\n", t.strip(), maxsplit=1)[0], *([t] if path.endswith("LICENSE") else []))]
        best: dict = {}
        for name, text in every:
            own = license_scan.terms(text)
            spans = [w[k : k + len(own)] for k in range(len(w) - len(own) + 1)]
            best[name] = max([best.get(name, 0.0), *(cosine(x, own) for x in (*pieces, *spans))])
        able = {n: s for n, s in best.items() if s >= license_scan.THRESHOLD}
        kind = [n for n in able if n not in license_scan.LAST] or list(able)
        if not kind:
            assert got[i].own_license is None
        else:
            top = max(able[n] for n in kind)
            assert got[i].own_score == pytest.approx(top) and able[got[i].own_license] == pytest.approx(top)
