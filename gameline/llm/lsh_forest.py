"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are taken in blocks of bounded size, so no bucket can grow. A block's forest is built once and stored: TREES sorted
arrays of hash strings of BITS signs of random projections. A query descends every tree to its longest matching prefixes
and takes those that together match FIRST rows; then all trees ascend together to shorter prefixes. The ascent stops where
a row as near as the query's k-th best so far would be missed by all trees with a probability of at most MISS: two vectors
at an angle a agree on a bit with 1 - a/pi, so on x bits of one of T trees with 1 - (1 - (1 - a/pi)**x)**T. Where no
prefix is that sure, the ascent goes to the root, which is an exact search. Some seed blocks are searched first; the k-th
best score that they give a query lets all other blocks stop earlier. Scores of the best are made in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import arrow_bounds, array_of, parts, stored, table

TREES, BITS, MISS = 40, 64, 0.12
#: Matches (with repeats among trees) that the descent collects before the ascent is planned.
FIRST = 600
#: Queries that meet a block of rows at once, rows of a block, and one of how many blocks is a seed.
QUERY_BLOCK, ROW_BLOCK, SEEDS = 2048, 8192, 16
#: Rows that are projected at once.
_PROJECTED = 1024


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim, TREES * BITS)).astype(np.float32)


def _hashes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[tree, row] hash strings as 64-bit numbers, the first sign on top."""
    out = np.empty((TREES, len(x)), dtype=np.uint64)
    for at in range(0, len(x), _PROJECTED):
        bits = (x[at : at + _PROJECTED] @ planes > 0).reshape(-1, TREES, BITS)
        out[:, at : at + _PROJECTED] = np.packbits(bits, axis=2).view(">u8")[:, :, 0].T
    return out


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1, and the two factors of each length: its greatest component and the rest, so that no square
    overflows or vanishes."""
    most = np.abs(v).max(axis=1, initial=0)
    most = np.where(most > 0, most, 1)
    scaled = v / most[:, None]
    rest = np.linalg.norm(scaled, axis=1)
    return scaled / np.where(rest > 0, rest, 1)[:, None], most, rest


def build(rows: np.ndarray, ids: np.ndarray) -> dict:
    """A block's forest."""
    own = _hashes(_units(rows)[0].astype(np.float32), _planes(rows.shape[1]))
    order = np.argsort(own, axis=1, kind="stable").astype(np.int32)
    return {"rows": rows, "ids": ids, "order": order, "keys": np.take_along_axis(own, order, axis=1)}


def _range(keys: np.ndarray, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the keys that share `depth` leading bits with each asked one."""
    if not depth:
        return np.zeros(len(asked), dtype=np.int64), np.full(len(asked), len(keys), dtype=np.int64)
    rest = np.uint64((1 << (BITS - depth)) - 1)
    return np.searchsorted(keys, asked & ~rest), np.searchsorted(keys, asked | rest, side="right")


def _descend(keys: np.ndarray, asked: np.ndarray, least: int) -> np.ndarray:
    """The greatest depth at which all trees together match at least `least` rows, for each query, by bisection."""
    low, high = np.zeros(asked.shape[1], dtype=np.int64), np.full(asked.shape[1], BITS, dtype=np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        matches = np.zeros(len(middle), dtype=np.int64)
        for depth in np.unique(middle).tolist():
            own = middle == depth
            for t in range(TREES):
                a, b = _range(keys[t], asked[t, own], depth)
                matches[own] += b - a
        enough = matches >= least
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low


def search(forest: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, bound: np.ndarray | None = None,
    visited: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best rows that the forest finds for every query. Rows below a query's bound
    need not be found. visited gets the number of rows that each query was compared with."""
    rows, ids, order, keys = forest["rows"], forest["ids"], forest["order"], forest["keys"]
    # float32 scores are of rows divided by the longest one's length and of queries of length 1, so from -1 to 1
    top_row = float(np.abs(rows).max(initial=0)) or 1.0
    x = rows / top_row
    longest = float(np.linalg.norm(x, axis=1).max(initial=0)) or 1.0
    x = (x / longest).astype(np.float32)
    unit, most, rest = _units(queries)
    q = unit.astype(np.float32)
    asked = _hashes(q, _planes(rows.shape[1]))
    if bound is not None:
        bound = bound / top_row / longest / most / rest
    start = _descend(keys, asked, min(FIRST, TREES * len(x)))
    out = []
    for i in range(len(q)):
        depth = int(start[i])
        while True:
            mark = np.zeros(len(x), dtype=bool)
            for t in range(TREES):
                a, b = _range(keys[t], asked[t, i : i + 1], depth)
                mark[order[t, a[0] : b[0]]] = True
                if not depth:
                    break
            mark &= ids != query_ids[i]
            found = np.flatnonzero(mark)
            score = x[found] @ q[i]
            best = min(k, len(found))
            kth = float(np.partition(score, len(found) - best)[len(found) - best]) if best else 0.0
            least = kth if best == k else -np.inf
            if bound is not None:
                least = max(least, float(bound[i]))
            # nothing of the block reaches this inner product at a wider angle than this one
            angle = np.arccos(np.clip(least, -1, 1)) if least > -np.inf else np.pi
            agree = 1 - angle / np.pi
            sure = 1 - MISS ** (1 / TREES)
            wanted = BITS if agree >= 1 else int(np.log(sure) / np.log(agree)) if agree > 0 else 0
            if depth <= wanted or depth == 0:
                break
            depth = max(min(wanted, depth - 1), 0)
        if visited is not None:
            visited.append(len(found))
        if best:
            near = found[score >= kth - 1e-5]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (rows[near] * queries[i]).sum(axis=1)
            top = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(top), query_ids[i]), ids[near][top], exact[top]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_FOREST = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "rows", "order", "keys"))])


def _built(dim: int):
    """Map: rows to the forests of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                rows = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(part.num_rows, dim)
                f = build(rows, np.asarray(part.column("vec_id"), dtype=np.int64))
                yield pa.RecordBatch.from_pylist([{"block": block, **{c: np.ascontiguousarray(f[c]).tobytes() for c in ("ids",
                    "rows", "order", "keys")}}], schema=_FOREST)
                block += 1

    return run


def _searched(k: int, dim: int):
    """Map: pairs of a block and a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].as_py() for c in ("ids", "rows", "order", "keys")}
                ids = array_of(x["ids"], "i8")
                forest = {"ids": ids, "rows": array_of(x["rows"], "f8").reshape(len(ids), dim),
                    "order": array_of(x["order"], "i4").reshape(TREES, -1), "keys": array_of(x["keys"],
                    "u8").reshape(TREES, -1)}
                asked = batch.column("asked")[i].values  # of this row only
                queries = np.asarray(asked.field("embedding").flatten(), dtype=np.float64).reshape(len(asked), dim)
                bound = np.asarray(asked.field("bound"), dtype=np.float64)
                a, b, s = search(forest, queries, np.asarray(asked.field("vec_id"), dtype=np.int64), k, bound)
                yield pa.record_batch({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows found, by inner product in double precision.

    vectors has vec_id and embedding (an array of numbers). Vectors that are null, zero or hold null or non-finite
    values take no part, nor do those of another length than the most frequent one (the longer of two), or with a null
    vec_id. A query's own rows, those of its vec_id, are no candidates; other repeated rows count each. With fewer
    candidates than k all are returned. Ties go to the smaller vec_id. A vec_id that is a query in several rows is
    asked once, by its smallest embedding.
    """
    spark = vectors.sparkSession
    arrow_bounds(spark)
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(good)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("embedding") == dim)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = stored(queries)
    forests = stored(rows.mapInArrow(_built(dim), "block long, ids binary, rows binary, order binary, keys binary"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(parts(queries.count(), QUERY_BLOCK)))

    def found(of: DataFrame, asked: DataFrame) -> DataFrame:
        """Every block of queries meets every block of rows once."""
        packed = asked.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("vec_id", "embedding", "bound")).alias("asked")).select("asked")
        return of.crossJoin(packed).select("ids", "rows", "order", "keys", "asked").mapInArrow(_searched(k,
            dim), "query_id long, vec_id long, score double")

    least = forests.agg(F.coalesce(F.min("block"), F.lit(0)).alias("block")).first()["block"]
    seed = (F.col("block") == least) | (F.pmod(F.xxhash64("block"), F.lit(SEEDS)) == 0)
    first = stored(found(forests.where(seed), queries.withColumn("bound", F.lit(float("-inf")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    bounds = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    rest = found(forests.where(~seed), bounded)
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
