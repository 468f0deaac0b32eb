"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm import trees
from gameline.llm.common import table, text_batches
from gameline.llm.words import word_hashes

#: Labelled documents that the trees are fitted on; of more, those with the smallest hash of their id.
SAMPLE = 12_000
_CLASSES = 12
_CLASS = np.zeros(256, dtype=np.uint8)
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" ", 4), (b"\n\r\t\x0b\x0c",
    5), (b".,;:'\"-?()", 6), (b"!", 7), (b"#$%&*@^~=+<>\\/_", 8), (b"|", 9), (b"[]{}`", 10), (range(128,
    256), 11)):
    for _c in _chars:
        _CLASS[_c] = _k


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text: sizes, shares of byte classes, word lengths, repetition of words, bigrams
    and lines. Null and empty texts have zeros."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    size = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    count = np.stack([np.bincount(_CLASS[flat[a:b]], minlength=_CLASSES) for a, b in zip((np.cumsum(size) - size).tolist(),
        np.cumsum(size).tolist(), strict=True)]) if len(texts) else np.zeros((0, _CLASSES))
    h, n_words = word_hashes(texts)
    rows, at = [], 0
    for i, n in enumerate(n_words.tolist()):
        own = h[at : at + n]
        at += n
        distinct = top = pairs = again = 0.0
        if n:
            same = np.sort(own)
            cuts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1], [True]]))
            runs = np.diff(cuts)
            distinct, top = len(runs) / n, runs.max() / n
            two = np.sort(own[1:] * np.uint64(31) + own[:-1])
            pairs = (1 + np.count_nonzero(two[1:] != two[:-1])) / max(len(two), 1)
            again = np.count_nonzero(own[1:] == own[:-1]) / n
        lines = data[i].split(b"\n")
        rows.append((distinct, top, pairs, again, len(lines), len(set(lines)) / len(lines), len(data[i]) / len(lines)))
    rows = np.array(rows, dtype=np.float64).reshape(len(texts), 7)
    each = np.maximum(size, 1)[:, None]
    words = np.maximum(n_words, 1)
    return np.column_stack([np.log1p(size), np.log1p(n_words), (size - count[:, 4] - count[:, 5]) / words,
        count / each, count[:, 2] / np.maximum(count[:, 1] + count[:, 2], 1), count[:, 7] / words,
        count[:, 8] / words, count[:, 9] / words, rows])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        x = statistics(batch.column("text").to_pylist())
        yield pa.record_batch({"label": batch.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            score = trees.predict(model.value, statistics(batch.column("text").to_pylist()))
            yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names if c != "text"}, "score": score})

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, size: int) -> DataFrame:
    """(label, text) of at most size documents with a 0/1 label that may be learned, half of each label where there
    are enough. The ids are chosen first, so texts of other documents are not moved."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = ids.where("label = 1").orderBy(order, "doc_id").limit(size // 2).unionByName(ids.where("label = 0").orderBy(order,
        "doc_id").limit(size - size // 2))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen),
        "doc_id").select("doc_id", "label", "text")  # size ids at most


def quality_scores(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The columns of docs but text, with score (0 to 1) and predicted (1 if score >= threshold).

    learn is a boolean column over doc_id: labels of other documents are not looked at. Null and empty texts have
    statistics of zero and get a score too. Without labels every score is 0.5. Rows that repeat count each; an empty
    table gives no rows. Columns of docs named score or predicted are replaced.
    """
    rows = labelled_sample(docs, labels, label, learn, sample).select("label", "text").mapInArrow(_features, "label int, x array<double>").toArrow()
    x, y = np.array(rows.column("x").to_pylist(), dtype=np.float64), np.array(rows.column("label").to_pylist(), dtype=np.float64)
    share = labels.where(F.col(label).isin(0, 1)).where(learn).agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    model = trees.fit(x.reshape(len(y), -1) if len(y) else np.zeros((0, statistics([]).shape[1])), y)
    if len(y) and share is not None and 0 < share < 1 and 0 < y.mean() < 1:  # the sample is balanced, the corpus is not
        model["base"] += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held)
    return quality_scores(docs, table(spark, sf_dir, "labels"), ~held).select("doc_id", "held_out", "score", "predicted")
