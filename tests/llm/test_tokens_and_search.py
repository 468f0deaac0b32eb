"""Token alignment, lexical search and byte-level BPE against brute force and the public libraries."""

import base64
import hashlib
import math
import os
import random
import re
from bisect import bisect_left
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gameline.llm import byte_bpe, lexical, token_align
from gameline.llm.common import table
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string"
HARD = ["", None, " ", "  ", "a", " a ", "a  b \n\n  c\t d", "<|endoftext|> x <s> </s> <unk> <0x41>", "▁ a▁b", "\x00\x1c \x1d x", "naïve café — “ok” 中文字符 日本語です", "ﬁne Å ① ½", "a b  c　 d", "👩‍👩‍👧 🇩🇪!",
    "don't we'll I'M 3.14159 100000", "x" * 700, "=" * 300 + " " * 120 + "\n" * 50, "aa aa aa", "الع рус ский", "​ zero ﻿", "a" * 3 + "é" * 90 + " z"]


def hard_texts(n=60, seed=1):
    r = random.Random(seed)
    words = [w for t in HARD if t for w in t.split(" ") if "▁" not in w] + ["the", "of", "value", "Ünï", "kola", "12", "\n", "\t", "", ""]
    return [*HARD, *(" ".join(r.choice(words)[:40] for _ in range(r.randrange(1, 80))) for _ in range(n))]


def files(*names):
    return [open(P.path(n), "rb").read() for n in names]


# --- byte-level BPE ------------------------------------------------------------------------------------------------------
def by_library(file, text):
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), text


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_are_the_library_s(spark, name):
    (file,) = files(name)
    library, _ = by_library(file, "")
    texts = hard_texts()
    if os.path.isdir(SF):
        texts += pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = byte_bpe.decoded(byte_bpe.encoded(rows, file, P.PATTERN), file, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and bytes(r.bytes) == (texts[r.doc_id] or "").encode() and r.text == texts[r.doc_id]


def test_tree_merges_the_leftmost_least_pair():
    ranks = {bytes([c]): c for c in range(97, 101)} | {w: 200 + i for i, w in enumerate([b"ab", b"bc", b"aba", b"aa", b"abab", b"cd", b"abcd", b"ccc", b"cc"])}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    r = random.Random(4)
    for n in [*range(1, 40), 257, 1000]:
        for _ in range(30 if n < 100 else 2):
            piece = bytes(r.choice(b"abcd") for _ in range(n))
            assert byte_bpe.merged(piece, ranks, 4) == ([ranks[piece]] if piece in ranks else plain(piece))


def test_bpe_of_long_and_repeated_rows_nothing_and_clashes(spark):
    (file,) = files("byte_bpe_multi_50k.tiktoken")
    library, _ = by_library(file, "")
    long = "ab" * 40_000 + " word" * 60_000 + "é" * 3000
    rows = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, "ok", 8)], "doc_id long, text string, ids int").withColumn("bytes", F.lit("x"))
    got = byte_bpe.decoded(byte_bpe.encoded(rows, file, P.PATTERN, keep_text=False), file, P.PATTERN)
    assert got.columns == ["doc_id", "ids", "bytes"]
    got = got.collect()
    assert [r.ids == library.encode_ordinary(long) for r in got if r.doc_id == 1] == [True, True] and [bytes(r.bytes) for r in got if r.doc_id is None] == [b"ok"]
    assert byte_bpe.encoded(spark.createDataFrame([], DOCS), file, P.PATTERN).count() == 0
    assert byte_bpe.decoded(spark.createDataFrame([(None,), ([],)], "ids array<int>"), file, P.PATTERN).collect()[0]["bytes"] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_op13(spark):
    library, _ = by_library(*files("byte_bpe_multi_50k.tiktoken"), "")
    want = set()
    for r in table(spark, SF, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in byte_bpe.op13_byte_bpe(spark, SF).collect()} == want


# --- alignment -----------------------------------------------------------------------------------------------------------
def brute_alignment(rows):
    """Whole texts through both libraries, groups by set intersection, links by loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in printable)}
    docs, held = [], Counter()
    for doc, text in rows:
        groups, data = [], (" " + (text or "")).encode()
        ta = [(i, bytes(decode[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text or ""))]
        if text and b"".join(x for _, x in ta) == data == b"".join(x for _, x in tb):
            ends = []
            for tokens in (ta, tb):
                at, out = 0, []
                for i, x in tokens:
                    at += len(x)
                    out.append((i, at))
                ends.append(out)
            stops = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
            groups = [([], []) for _ in stops]
            for side, tokens in enumerate(ends):
                for i, e in tokens:
                    groups[bisect_left(stops, e)][side].append(i)
        linked = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(linked.keys())
        docs.append((doc, groups, linked))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for doc, groups, linked in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()), sum(n for p, n in linked.items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in linked.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("range_bytes", "sent"), [(token_align.RANGE_BYTES, token_align.SENT_PAIRS), (40, 60), (7, 0)])
def test_alignment(spark, range_bytes, sent):
    texts = hard_texts()
    texts += [texts[-1], texts[-1]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x"), (5, "again a row", "x"), (5, "again a row", "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "n_a")
    got = token_align.aligned(docs, *files("byte_bpe_50k.json", "piece_bpe_32k.model"), range_bytes=range_bytes, sent_pairs=sent)
    assert tuple(got.columns) == ALIGNED
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_alignment([r[:2] for r in rows]), key=str)


def test_alignment_of_a_long_text_keeps_its_groups(spark):
    r = random.Random(2)
    words = [t for t in HARD if t and "▁" not in t]
    long = " ".join(r.choice(words) for _ in range(300)) + "y" * 900 + " end"
    docs = spark.createDataFrame([(1, long, ""), (2, None, "")], DOCS)
    got = {x.doc_id: x for x in token_align.aligned(docs, *files("byte_bpe_50k.json", "piece_bpe_32k.model"), keep_text=True, range_bytes=64).collect()}
    assert got[1].n_groups > 1000 and hashlib.sha256(got[1].text).hexdigest() == got[1].groups_sha256 == brute_alignment([(1, long)])[0][-1] and got[2].text is None
    assert token_align.aligned(spark.createDataFrame([], DOCS), *files("byte_bpe_50k.json", "piece_bpe_32k.model")).count() == 0


def test_fragments_compose_in_any_grouping():
    pair = token_align.pair_of(*files("byte_bpe_50k.json", "piece_bpe_32k.model"))
    data = b" " + "naïve tokens — unaligned 中文 boundaries, strengthened 1234567".encode()
    cuts = [0, 3, 4, 11, 12, 13, 26, 40, 41, 55, len(data)]
    leaves = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        f, text = token_align._fragment(pair, data, low, high, 0, False)
        f.text = [token_align._packed(text)] if text else []
        leaves.append(f)

    def seen(f):
        keys, counts = token_align._sum_by_key(f.keys, f.counts)
        said = b";".join(token_align.zstandard.decompress(t) for t in f.text)
        return f.closed, f.prefix, f.suffix, said, f.n_a, f.n_b, f.n_groups, f.n_links, keys.tolist(), counts.tolist()

    def folded(fs, r):
        fs = list(fs)
        while len(fs) > 1:
            i = r.randrange(len(fs) - 1)
            fs[i : i + 2] = [token_align.composed(fs[i], fs[i + 1], pair)]
        return seen(fs[0])

    whole, text = token_align._fragment(pair, data, 0, len(data), 0, True)
    whole.text = [token_align._packed(text)]
    assert all(folded([token_align.Fragment(), *leaves, token_align.Fragment()], random.Random(s)) == seen(whole) for s in range(20))
    assert len({folded(leaves[2:7], random.Random(s))[3] for s in range(10)}) == 1


def test_large_groups_pair_distinct_ids_once(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    a, b = r.integers(0, 9, 500), r.integers(0, 9, 600)
    of_a, of_b = np.sort(r.integers(0, 4, 500)), np.sort(r.integers(0, 4, 600))
    want = token_align.links(a, b, of_a, of_b, 4, 10)
    monkeypatch.setattr(token_align, "LARGE_GROUP", 10)
    got = token_align.links(a, b, of_a, of_b, 4, 10)
    assert got[0] == want[0] == want[2].sum() and all((x == y).all() for x, y in zip(got[1:], want[1:], strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_op11(spark):
    want = brute_alignment([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    assert sorted(map(tuple, token_align.op11_token_align(spark, SF).select(*ALIGNED).collect())) == sorted(want)


# --- lexical search ------------------------------------------------------------------------------------------------------
def brute_search(docs, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(d, c) for d, c in ((d, Counter(terms(t))) for d, t in docs) if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 60])
def test_search(spark, block_bytes):
    r = random.Random(6)
    words = ["ba", "Be", "bi", "BO", "é", "Éa", "x1", "the", "the", "the", "中", "a_b", "c-d", " q"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(80)]
    docs = [*enumerate(texts), (80, texts[3]), (81, texts[3]), (81, texts[3]), (None, texts[3]), (90, None), (91, ""), (92, " -- "), (93, "the " * 5000)]
    items = [("i1", texts[3]), ("i2", "the"), ("i3", "é éa É"), ("i4", None), ("i5", "--"), ("i6", "never"), (None, "bo 中"), ("i7", " ".join(words) * 3)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = lexical.search(d, it, 10, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)


def test_search_of_nothing(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "x y"), ("a", "x y")], "item_id string, text string")
    assert lexical.search(none, items).count() == 0
    some = spark.createDataFrame([(1, "x", ""), (2, "z", "")], DOCS)
    assert lexical.search(some, items.limit(0)).count() == 0
    assert sorted(tuple(r)[:3] for r in lexical.search(some, items).collect()) == [("a", 1, 1), ("a", 1, 1)]


def test_terms_of_long_texts_are_split_between_terms(monkeypatch):
    text = "Abc1 " * 50 + "x" * 900 + "-é " + "tail"
    want = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "SPLIT_BYTES", 7)
    assert lexical.term_counts(text) == want == Counter({"abc1".encode(): 50, b"x" * 900: 1, "é".encode(): 1, b"tail": 1})
