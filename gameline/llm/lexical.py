"""Ranked lexical search, reversed: the items' terms are an inverted index that every task has, the documents' term
counts stream through it, and each task keeps a bounded heap an item; the heaps are merged at the end."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import array_of, arrow_bounds, parts, stored, table, text_batches, trim

#: Bytes of the items' distinct terms that are broadcast at once (the index in a worker is about ten times that); a
#: larger set of items takes several passes over the documents, a block of items each.
BLOCK_BYTES = 4 << 20
#: Bytes of text that are split into terms at once.
SPLIT_BYTES = 1 << 20
#: Fixed values of the score: weights in thousandths, parts of 100 for the length, and the scales of the quotient.
WEIGHT, LENGTH, SCALE, TERM, NORM = 1000, 90, 1_000_000_000, 1000, 8
#: Terms are maximal runs of bytes other than these, A-Z lower-cased; the others become spaces.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_counts(text: str | None) -> Counter:
    """Each term of the whole text with its occurrences."""
    data, found, at = (text or "").encode().translate(_FOLD), Counter(), 0
    while at < len(data):
        stop = data.find(b" ", at + SPLIT_BYTES)
        stop = len(data) if stop < 0 else stop
        found.update(data[at:stop].split())
        at = stop
    return found


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text"):
        terms = [sorted(term_counts(t)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"item": batch.column("item"), "terms": pa.array(terms, pa.list_(pa.binary()))})


def _counts(vocabulary):
    """Map: each document's length in terms, and the vocabulary's terms in it, packed as 32-bit numbers and 64-bit
    counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in text_batches(batches, "text"):
            length, terms, counts = [], [], []
            for text in batch.column("text"):
                found = term_counts(text.as_py())
                length.append(found.total())
                known = sorted((number[t], n) for t, n in found.items() if t in number)
                terms.append(np.array([t for t, _ in known], dtype=np.int32).tobytes())
                counts.append(np.array([n for _, n in known], dtype=np.int64).tobytes())
            out = {"doc_id": batch.column("doc_id"), "n": pa.array(length, pa.int64()), "terms": pa.array(terms, pa.binary()), "counts": pa.array(counts, pa.binary())}
            yield pa.record_batch(out).filter(pa.array([n > 0 for n in length]))

    return run


def _documents_of(size: int):
    """Map: how many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                total[array_of(terms, "i4")] += 1
        seen = np.flatnonzero(total)
        yield pa.record_batch({"term": seen.astype(np.int32), "df": total[seen]})

    return run


def _best(index, k: int):
    """Map: the k best documents of every item among a task's documents, equal scores by the smaller doc_id, nulls
    last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        first, held, weight, n_docs, n_terms = x["first"], x["held"], x["weight"], x["n_docs"], x["n_terms"]
        heaps: list[list[tuple[int, float]]] = [[] for _ in range(len(x["items"]))]
        least = np.ones(len(heaps), dtype=np.int64)
        for batch in batches:
            for doc, n, t, c in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                terms, tf = array_of(t, "i4"), array_of(c, "i8")
                if not len(terms):
                    continue
                m = 100 - LENGTH + LENGTH * n * n_docs // n_terms
                gain = weight[terms] * (SCALE * tf // (TERM * tf + NORM * m))
                many = first[terms + 1] - first[terms]
                begin = np.cumsum(many) - many
                at = np.arange(many.sum()) + np.repeat(first[terms] - begin, many)
                if gain.sum() < 1 << 53:  # sums in doubles are exact
                    scores = np.bincount(held[at], weights=np.repeat(gain, many), minlength=len(heaps)).astype(np.int64)
                else:
                    scores = np.zeros(len(heaps), dtype=np.int64)
                    np.add.at(scores, held[at], np.repeat(gain, many))
                for item in np.flatnonzero(scores >= least).tolist():
                    heap, entry = heaps[item], (int(scores[item]), -math.inf if doc is None else -doc)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[item] = heap[0][0]
        rows = [(item, None if d == -math.inf else -d, s) for item, heap in zip(x["items"], heaps, strict=True) for s, d in heap]
        names = ("item", "doc_id", "score")
        for at in range(0, len(rows), 65_536):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 65_536], strict=True)], names=names)
        trim()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending
    doc_id, nulls last. Every row of docs is a document and every row of items an item, so repeated rows rank each
    for itself. Null and wordless texts have no terms: such documents count nowhere and such items have no rows.
    Without documents or items there are no rows. Only doc_id, text and item_id are read, other columns do not
    matter. Statistics are over all documents.

    The documents' counts of the items' terms are stored once a block of items; a task's result is at most k rows an
    item, and the last sort drops all but k rows of each item before it shuffles."""
    spark = docs.sparkSession
    arrow_bounds(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stored(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item")))
    terms = items.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>").where(F.size("terms") > 0)
    size = terms.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)), F.lit(0)).alias("n")).first()["n"]
    blocks = parts(size, block_bytes)
    found = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        number = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        counts = stored(docs.mapInArrow(_counts(spark.sparkContext.broadcast(number)), "doc_id long, n long, terms binary, counts binary"))
        total = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(number), dtype=np.int64)
        for r in counts.select("terms").mapInArrow(_documents_of(len(number)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        pairs = np.array([(number[bytes(t)], i) for i, r in enumerate(rows) for t in r["terms"]], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        weight = [math.floor(WEIGHT * math.log((2 * total["docs"] + 2) / (2 * n + 1))) for n in df.tolist()]
        index = {"items": [r["item"] for r in rows], "first": np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), "held": pairs[:, 1].copy(),
            "weight": np.array(weight, dtype=np.int64), "n_docs": total["docs"], "n_terms": max(1, total["terms"])}
        best = counts.mapInArrow(_best(spark.sparkContext.broadcast(index), k), "item long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""WITH occ AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, tot GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), tot GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0) WHERE rank <= 10"""
