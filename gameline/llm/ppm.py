"""Language-model scoring by partial matching over byte contexts, beside a word unigram base.

Training counts every (context of ORDER bytes, next byte) of the learned texts, A-Z lower-cased, each preceded by
ORDER end marks and followed by one. Shorter contexts follow by summing. The whole context trie is kept as one table of
edges for each order; the code lengths of its most frequent longest edges are broadcast, and all other symbols of the
texts are resolved by joins with these tables. In its longest known context a symbol seen c times weighs 2c - 1 and the escape as much
as there are distinct symbols; after an escape the next shorter context decides, from which the symbols of the longer
one are excluded; below order 0 all symbols left are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import stored, table, text_batches
from gameline.llm.words import HASH_BYTES, word_hashes

#: Bytes of the longest context.
ORDER = 5
#: Edges of the longest contexts whose code lengths are broadcast; symbols on rarer or unseen edges are resolved by joins.
MOST_EDGES = 500_000
#: Words whose counts are broadcast; rarer words are counted by a join.
MOST_WORDS = 1_000_000
END = 255  # no byte of UTF-8
_SYMBOLS = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def _keys(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(contexts with next byte as ORDER + 1 bytes, symbols of each text, first text), in parts of bounded size."""
    pad = bytes([END]) * ORDER
    part, sizes, total, first = [], [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        part.append(pad + data + bytes([END]))
        sizes.append(len(data) + 1)
        total += len(part[-1])
        if total > HASH_BYTES or i + 1 == len(texts):
            x = np.frombuffer(b"".join(part), dtype=np.uint8).astype(np.uint64)
            key = np.zeros(len(x) - ORDER, dtype=np.uint64)
            for j in range(ORDER + 1):
                key = (key << np.uint64(8)) | x[j : j + len(key)]
            n = np.array(sizes)
            start = np.cumsum(n + ORDER) - n - ORDER
            keep = np.ones(len(key), dtype=bool)
            for j in range(ORDER):
                keep[start[1:] - 1 - j] = False  # next bytes that are a text's leading marks
            yield key[keep], n, first
            part, sizes, total, first = [], [], 0, i + 1


class _Counter:
    """Sums counts of 64-bit keys, merging sorted runs when they grow."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.runs.append((k, n))
        self.size += len(k)
        if self.size > 3_000_000:
            self.runs = [self.total()]
            self.size = len(self.runs[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        keys, n = np.concatenate([k for k, _ in self.runs]), np.concatenate([n for _, n in self.runs])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[head], np.add.reduceat(n, head) if len(head) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, words, texts = _Counter(), _Counter(), 0
    for batch in text_batches(batches, "text"):
        rows = batch.column("text").to_pylist()
        texts += len(rows)
        for key, _, _ in _keys(rows):
            grams.add(key)
        words.add(word_hashes(rows)[0])
    for kind, (key, n) in (("gram", grams.total()), ("word", words.total())):
        for at in range(0, len(key), 100_000):
            k = key[at : at + 100_000].view(np.int64)
            yield pa.record_batch({"kind": pa.array([kind] * len(k)), "key": k, "n": n[at : at + 100_000].astype(np.int64)})
    yield pa.record_batch({"kind": pa.array(["end"]), "key": pa.array([0], pa.int64()), "n": pa.array([texts], pa.int64())})


def _hashed(keys: np.ndarray, values: np.ndarray) -> dict:
    """Open-addressed table of the keys."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.full(1 << bits, _EMPTY, dtype=np.uint64), np.zeros(1 << bits, dtype=np.result_type(values.dtype, np.float32))
    left, probe = np.arange(len(keys)), 0
    while len(left):
        at = _slot(keys[left], bits, probe)
        free = slots[at] == _EMPTY
        win = np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]
        slots[at[win]], held[at[win]] = keys[left[win]], values[left[win]]
        stay = np.ones(len(left), dtype=bool)
        stay[win] = False
        left, probe = left[stay], probe + 1
    return {"bits": bits, "slots": slots, "held": held, "probes": probe}


def _slot(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    h = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return ((h + np.uint64(probe)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _looked_up(t: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _slot(keys, t["bits"], 0)
    got, out = t["slots"][at], t["held"][at]
    found = got == keys
    left = np.flatnonzero(~found & (got != _EMPTY))
    for probe in range(1, t["probes"]):
        if not len(left):
            break
        at = _slot(keys[left], t["bits"], probe)
        got = t["slots"][at]
        hit = got == keys[left]
        out[left[hit]], found[left[hit]] = t["held"][at[hit]], True
        left = left[~hit & (got != _EMPTY)]
    return out, found


def _find(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return at, values[at] == x


def build_trie(edges: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The model from sorted (context and symbol, count) arrays of orders 0 to ORDER."""
    orders = []
    edges = [(key, 2 * n - 1) for key, n in edges]  # a symbol weighs 2c - 1 and takes one more, half of it for the escape
    for k, (key, n) in enumerate(edges):
        ctx = key >> np.uint64(8)
        head = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(n, head) if len(head) else n
        distinct = np.diff(np.append(head, len(ctx)))
        shorter = np.zeros(len(head), dtype=np.int64)  # counts that the next shorter context has for its symbols
        if k and len(head):
            at, _ = _find(edges[k - 1][0], key & _mask(k))
            shorter = np.add.reduceat(edges[k - 1][1][at], head)
        orders.append({"ctx": ctx[head], "total": total, "distinct": distinct, "shorter": shorter, "key": key, "n": n})
    top = orders[-1]
    owner = np.repeat(np.arange(len(top["ctx"])), top["distinct"])
    table_ = _hashed(top["key"], np.log10(top["n"] / (top["total"] + top["distinct"])[owner]).astype(np.float32))
    top["key"] = top["n"] = None  # the table has them
    return {"top": table_, "orders": orders}


def code_lengths(trie: dict, key: np.ndarray) -> np.ndarray:
    """log10 probability of every symbol after its context."""
    out, known = _looked_up(trie["top"], key)
    out = out.astype(np.float64)
    rest = np.flatnonzero(~known)
    out[rest] = 0
    above = np.full(len(rest), -1, dtype=np.int64)
    for k in range(ORDER, -1, -1):
        o, x = trie["orders"][k], key[rest]
        at, have = _find(o["ctx"], (x >> np.uint64(8)) & _mask(k))
        longer = trie["orders"][k + 1] if k < ORDER else None
        total, distinct = np.where(have, o["total"][at], 0) if len(o["ctx"]) else np.zeros(len(x)), np.where(have,
            o["distinct"][at], 0) if len(o["ctx"]) else np.zeros(len(x))
        if longer is not None and len(longer["ctx"]):
            total, distinct = (v - np.where(above >= 0, w, 0) for v, w in ((total, longer["shorter"][above]), (distinct, longer["distinct"][above])))
        hit = np.zeros(len(x), dtype=bool)
        if k < ORDER:
            edge, hit = _find(o["key"], x & _mask(k + 1))
            out[rest[hit]] += np.log10(o["n"][edge[hit]] / (total + distinct)[hit])
        escape = have & ~hit & (distinct > 0)
        out[rest[escape]] += np.log10(distinct[escape] / (total + distinct)[escape])
        above = np.where(have, at, -1)[~hit]
        rest = rest[~hit]
    root = trie["orders"][0]
    out[rest] -= np.log10(_SYMBOLS - (int(root["distinct"][0]) if len(root["ctx"]) else 0))
    return out


def _repeats(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times) of the distinct keys of each text."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    text, key = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
    return text[head], key[head], np.diff(np.append(head, len(key)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, words = model.value["edges"], model.value["words"]
        row = TaskContext.get().partitionId() << 33
        for batch in text_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            score, left = np.zeros(len(texts)), []
            for key, n, first in _keys(texts):
                logs, known = _looked_up(edges, key)
                logs[~known] = 0
                score[first : first + len(n)] = np.add.reduceat(logs, np.cumsum(n) - n)
                left.append((np.repeat(np.arange(first, first + len(n)), n)[~known], key[~known]))
            edge_of, edge, times = _repeats(left)
            edge_cuts = np.searchsorted(edge_of, np.arange(len(texts) + 1))
            h, counts = word_hashes(texts)
            c, known = _looked_up(words, h)
            owner = np.repeat(np.arange(len(texts)), counts)
            logs = np.bincount(owner[known], weights=np.log10(c[known].astype(np.float64) + 0.5), minlength=len(texts)).astype(np.float64)
            rare, where = h[~known].view(np.int64), owner[~known]
            cuts = np.searchsorted(where, np.arange(len(texts) + 1))
            keep = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.record_batch({**keep, "row": row + np.arange(len(texts)), "n_tokens": counts + 1,
                "known": np.bincount(owner[known], minlength=len(texts)).astype(np.int64), "logs": logs,
                "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare)),
                "edges": pa.ListArray.from_arrays(pa.array(edge_cuts, pa.int32()), pa.array(edge.view(np.int64))),
                "times": pa.ListArray.from_arrays(pa.array(edge_cuts, pa.int32()), pa.array(times)),
                "score": score})
            row += len(texts)

    return run


def _least(counts: DataFrame, kind: str, most: int) -> int:
    """Smallest power of two that at most `most` keys of the kind reach."""
    found = counts.where(F.col("kind") == kind).groupBy(F.floor(F.log2("n")).alias("b")).count().collect()
    total, least = 0, 0
    for r in sorted(found, key=lambda r: -r["b"]):
        total += r["count"]
        if total > most:
            return 1 << (r["b"] + 1)
    return 1 << least


def _suffix(column: str, size: int):
    """The last bytes of a key."""
    return F.col(column).bitwiseAND(F.lit(int(_mask(size))))


def _edges(grams: DataFrame) -> list[DataFrame]:
    """All edges (key, n) of orders 0 to ORDER."""
    orders = [grams.select("key", "n")]
    for k in range(ORDER, 0, -1):
        orders.insert(0, stored(orders[0].groupBy(_suffix("key", k).alias("key")).agg(F.sum("n").alias("n"))))
    return orders


def _contexts(edges: DataFrame, k: int) -> DataFrame:
    """The contexts of an order, with the weight and number of their symbols, and what the next shorter context has for these."""
    below = 2 * F.sum("n").over(Window.partitionBy(_suffix("key", k))) - 1 if k else F.lit(0)
    edges = edges.select(F.shiftright("key", 8).alias("ctx"), (2 * F.col("n") - 1).alias("w"), below.alias("below"))
    return edges.groupBy("ctx").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("below").alias("shorter"))


def _escaped(keys: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """(key, log) of keys that are no edges of the longest contexts, as code_lengths has them."""
    x = keys.select("key", F.lit(0.0).alias("log"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("less"),
        F.lit(0).cast("long").alias("fewer"))
    done = None
    for k in range(ORDER, -1, -1):
        near = F.broadcast if k < 2 else lambda t: t  # at most 256 ** 2 edges, and few contexts have most of the keys
        x = x.withColumn("ctx", _suffix("key", k + 1)).withColumn("ctx", F.shiftright("ctx", 8)).join(near(_contexts(orders[k], k)), "ctx", "left")
        if k < ORDER:
            x = x.withColumn("edge", _suffix("key", k + 1)).join(near(orders[k].select(F.col("key").alias("edge"),
                (2 * F.col("n") - 1).alias("w"))), "edge", "left")
        else:
            x = x.withColumn("w", F.lit(None).cast("long"))
        distinct = F.coalesce("distinct", F.lit(0)) - F.col("fewer")
        total = F.coalesce("total", F.lit(0)) - F.col("less")
        step = F.when(F.col("done"), 0.0).when(F.col("w").isNotNull(), F.log10(F.col("w") / (total + distinct))).when(F.col("total").isNotNull() & (distinct > 0),
            
            F.log10(distinct / (total + distinct))).otherwise(0.0)
        if not k:
            step = step - F.when(F.col("done") | F.col("w").isNotNull(), 0.0).otherwise(F.log10(_SYMBOLS - F.coalesce("distinct", F.lit(0))))
        x = x.select("key", (F.col("log") + step).alias("log"), (F.col("done") | F.col("w").isNotNull()).alias("done"),
            F.coalesce("shorter", F.lit(0)).alias("less"), F.coalesce("distinct", F.lit(0)).alias("fewer"))
        if k == ORDER - 1:  # most keys end here
            x = stored(x)
            done, x = x.where("done").select("key", "log"), x.where("not done")
    return done.unionByName(x.select("key", "log"))


def _collected(pairs: DataFrame) -> dict:
    """Open-addressed table of (key, value) rows."""
    found = pairs.toArrow()
    key, value = (np.asarray(c) for c in found.columns)
    return _hashed(key.view(np.uint64), value)


def ppm_scores(docs: DataFrame, learn) -> DataFrame:
    """The columns of docs but text, with n_tokens, n_known, train_tokens, base_score and score.

    learn is a boolean column: rows where it is true (and not null) train the model and the base. Null and empty texts
    have one token, the end. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over a text's words and its end;
    score is the log10 probability of the text's bytes (A-Z lower-cased) and its end under the byte model. With nothing
    to learn from, every byte is as likely as any other. Words are told apart by 64-bit hashes. Rows that repeat count
    each; an empty table gives no rows. Columns of docs named like a result column are replaced.
    """
    spark = docs.sparkSession
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "row", "known", "logs",
        "rare", "edges", "times", "more_known", "more_logs", "more_score")
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(*made)
    counted = docs.where(learn).select("text").mapInArrow(_count, "kind string, key long, n long")
    counts = stored(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"))
    grams = counts.where("kind = 'gram'")
    orders = _edges(grams)
    context = Window.partitionBy(F.shiftright("key", 8))
    weight = 2 * F.col("n") - 1
    longest = stored(orders[ORDER].select("key", "n", F.log10(weight / (F.sum(weight).over(context) + F.count(F.lit(1)).over(context))).alias("log")))
    edges = _collected(longest.where(F.col("n") >= _least(counts, "gram", MOST_EDGES)).select("key", "log"))
    common = _least(counts, "word", MOST_WORDS)
    words = _collected(counts.where((F.col("kind") == "word") & (F.col("n") >= common)).select("key", "n"))
    tokens = counts.where("kind <> 'gram'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.coalesce(F.max(F.when(F.col("kind") == "end", F.col("n"))), F.lit(0)).alias("ends")).first()
    model = spark.sparkContext.broadcast({"edges": edges, "words": words})
    del edges, words
    kept = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (", row long, n_tokens long, known long, logs "
        "double, rare array<bigint>, edges array<bigint>, times array<bigint>, score double")
    scored = stored(docs.mapInArrow(_score(model), schema))
    model.destroy()  # the texts are scored; the driver need not hold the tables during the joins
    del model
    pa.default_memory_pool().release_unused()
    if common > 1:
        rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").count()
        seen = rare.join(counts.where((F.col("kind") == "word") & (F.col("n") < common)), "key", "left")
        more = seen.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("count")).otherwise(0)).alias("more_known"),
            F.sum(F.col("count") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_logs"))
        scored = scored.join(more, "row", "left").withColumns({"more_known": F.coalesce("more_known",
            F.lit(0)), "more_logs": F.coalesce("more_logs", F.lit(0.0))})
    else:
        scored = scored.withColumns({"more_known": F.lit(0), "more_logs": F.size("rare") * float(np.log10(0.5))})
    pairs = scored.select("row", F.explode(F.arrays_zip("edges", "times")).alias("e")).select("row",
        F.col("e.edges").alias("key"), F.col("e.times").alias("times"))
    keys = pairs.select("key").distinct().join(longest.select("key", "log"), "key", "left")
    keys = stored(keys)
    lengths = keys.where("log is not null").unionByName(_escaped(keys.where("log is null"), orders))
    more = pairs.join(lengths, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    scored = scored.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    end, each = float(np.log10(tokens["ends"] + 0.5)), float(np.log10(tokens["n"] + 0.5 * (tokens["v"] + 1)))
    return scored.select(
        *[F.col(f"`{f.name}`") for f in kept],
        "n_tokens",
        (F.col("known") + F.col("more_known") + int(tokens["ends"] > 0)).cast("long").alias("n_known"),
        F.lit(tokens["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") + end - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held, F.lit(True)))
    return ppm_scores(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
