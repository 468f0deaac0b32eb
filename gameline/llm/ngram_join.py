"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence under size-derived bounds.

Steps, all over whole texts:

1. Every text becomes its set of distinct word shingles (64-bit hashes). The incidence is cut into column blocks by
   shingle; a block task finds the columns that two or more batches share and counts, for every document, its shared
   columns. A document with more unshared shingles than the size bound allows, n - ceil(t*n), has no partner.
2. Equal sets are one class; one representative of each class goes on.
3. Columns of the representatives' prefixes (the n - ceil(t*n) + 1 rarest shingles) connect candidates: two sets of similarity t or more always share a prefix column. Connected candidates form a cluster.
4. A cluster's rows are cut into blocks. The sparse product of every block with the cluster's first row links the bulk of
   a group of near copies without its pairs. The rows that stay unlinked are multiplied, block by block, with all rows
   of the cluster: every link between different components has an end among them.
5. Links and classes give components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import array_of, parts, released, stored, table, text_batches, total_bytes, trim
from gameline.llm.graph import components
from gameline.llm.words import shingles

#: Rows of a block of the product.
BLOCK_ROWS = 512
#: Parts that the rows of a large cluster are dealt to where they meet its number of blocks.
SALTS = 32
_BLOCKS = pa.schema([("block", pa.int32()), ("src", pa.int64()), ("col", pa.binary()), ("row", pa.binary()),
    ("many", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()),
    ("node", pa.binary())])
_COUNTS = pa.schema([("src", pa.int64()), ("shared", pa.binary()), ("docs", pa.binary()), ("sizes",
    pa.binary()), ("digests", pa.binary()), ("node", pa.binary())])


def _bound(n: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles of a set of n that a partner may lack."""
    return n - -(-n * percent // 100)


def _cut(k: int, blocks: int):
    """Map: batches of documents to one row for each column block: column hashes and batch-local rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(text_batches(batches, "text")):
            place = f"{TaskContext.get().partitionId()} {number} ".encode()  # equal batches are two batches
            ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
            h, sizes = shingles(batch.column("text").to_pylist(), k)
            ends = np.cumsum(sizes)
            digests = [hashlib.md5(h[e - n : e].tobytes()).digest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            first: dict[bytes, int] = {}
            node = np.array([first.setdefault(d, len(first)) for d in digests], dtype=np.int32)
            fresh = np.zeros(len(ids), dtype=bool)
            fresh[np.unique(node, return_index=True)[1]] = True  # copies inside the batch are sent once
            keep = np.repeat(fresh, sizes)
            col, row = h[keep], np.repeat(node[fresh], sizes[fresh])
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            src = int.from_bytes(hashlib.md5(place + ids.tobytes() + b"".join(digests)).digest()[:8], "little", signed=True)
            step = -(-(1 << 32) // blocks)
            cuts = np.searchsorted(col >> np.uint64(32), np.arange(blocks + 1, dtype=np.uint64) * np.uint64(step))
            rows = []
            for b in range(blocks):
                c, r = col[cuts[b] : cuts[b + 1]], row[cuts[b] : cuts[b + 1]].astype(np.uint32)
                if not len(c) and b != src % blocks:
                    continue
                new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=bool)
                group = np.cumsum(new) - 1
                several = np.bincount(group) > 1 if len(c) else new
                # a column that the batch itself repeats is shared already: its rows are counted here, its hash is sent
                many = np.bincount(r[several[group]], minlength=len(first)).astype(np.uint32) if several.any() else None
                own = {"docs": ids.tobytes(), "sizes": sizes.tobytes(), "digests": b"".join(digests),
                    "node": node.tobytes()} if b == src % blocks else {}
                one = ~several[group] if len(c) else new
                rows.append({"block": b, "src": src, "col": (c[one]).tobytes() + c[new][several].tobytes() if len(c) else b"",
                    "row": r[one].tobytes(), "many": None if many is None else many.tobytes(), **own})
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column-block task: for each batch of documents, the number of shared columns of its rows."""
    whole = pa.Table.from_batches(list(batches), schema=_BLOCKS)
    for block in whole.column("block").unique().to_pylist():
        part = whole.filter(pc.equal(whole.column("block"), block)).to_pylist()
        cols = [array_of(x["col"], "u8") for x in part]
        shared = _repeated(np.concatenate(cols)) if cols else None
        at = 0
        for x, c in zip(part, cols, strict=True):
            row = array_of(x["row"], "u4")
            mine = row[shared[at : at + len(row)]]
            at += len(c)
            n = max(int(mine.max()) + 1 if len(mine) else 0, len(array_of(x["many"], "u4")))
            count = np.bincount(mine, minlength=n).astype(np.uint32)
            if x["many"]:
                count += array_of(x["many"], "u4")
            yield pa.RecordBatch.from_pylist([{"src": x["src"], "shared": count.tobytes(), **{c: x[c] for c in ("docs",
                "sizes", "digests", "node")}}], schema=_COUNTS)
    trim()


def _repeated(values: np.ndarray) -> np.ndarray:
    """True where the value occurs more than once."""
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _gather(percent: int):
    """All rows of one batch of documents: doc_id, n_shingles, digest and whether the size bound leaves it a partner."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next((x for x in rows if x["docs"] is not None), None)
        if own is None:
            raise RuntimeError("rows of a batch of documents are missing: the input changed while it was read")
        docs, sizes, node = array_of(own["docs"], "i8"), array_of(own["sizes"], "i8"), array_of(own["node"], "i4")
        shared = np.zeros(int(node.max(initial=-1)) + 1, dtype=np.int64)
        for x in rows:
            c = array_of(x["shared"], "u4")
            shared[: len(c)] += c
        alive = (sizes > 0) & (sizes - shared[node] <= _bound(sizes, percent))
        digests = [own["digests"][i : i + 16].hex() for i in range(0, len(own["digests"]), 16)]
        return pa.table({"doc_id": docs, "n_shingles": sizes, "digest": digests, "alive": alive})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            h, sizes = shingles(batch.column("text").to_pylist(), k)
            ends = np.cumsum(sizes)
            yield pa.record_batch({"node": batch.column("doc_id"), "n": sizes, "cols": pa.array([h[e - n : e].tobytes() for e,
                n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())})

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to rows (col, node, n)."""
    for batch in batches:
        data = batch.column("cols").to_pylist()
        for at in range(0, len(data), 256):
            n = np.array([len(x) // 8 for x in data[at : at + 256]], dtype=np.int64)
            node = np.asarray(batch.column("node"), dtype=np.int64)[at : at + 256]
            yield pa.record_batch({"col": array_of(b"".join(data[at : at + 256]), "i8"), "node": np.repeat(node, n), "n": np.repeat(n, n)})


def _similar(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def _product(left: list[bytes], right: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs (row of left, row of right) of similarity percent or more: a sparse product, one left row at a time over
    the columns of right, keeping the size bounds."""
    cols = [array_of(x, "u8") for x in right]
    sizes = np.array([len(c) for c in cols], dtype=np.int64)
    flat, owner = np.concatenate(cols), np.repeat(np.arange(len(cols)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, x in enumerate(left):
        c = array_of(x, "u8")
        lo, hi = np.searchsorted(flat, c, "left"), np.searchsorted(flat, c, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(owner[at], minlength=len(cols))
        bound = (100 * np.minimum(sizes, len(c)) >= percent * np.maximum(sizes, len(c))) & (overlap > 0)
        out += [(i, int(j)) for j in np.flatnonzero(bound & _similar(overlap, sizes, np.int64(len(c)), percent))]
    return out


def _first_row(percent: int):
    """Products of blocks with the first set of their cluster: which rows link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, first, rows in zip(batch.column("cluster").to_pylist(), batch.column("first").to_pylist(),
                batch.column("rows").to_pylist(), strict=True):
                linked = np.zeros(len(rows), dtype=bool)
                linked[[j for _, j in _product([first], [x["cols"] for x in rows], percent)]] = True
                yield pa.record_batch({"node": pa.array([x["node"] for x in rows], pa.int64()),
                    "cluster": pa.array([cluster] * len(rows), pa.int64()), "linked": pa.array(linked)})
        trim()

    return run


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, rows in zip(batch.column("rest").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                pairs = [(rest[i]["node"], rows[j]["node"]) for i, j in _product([x["cols"] for x in rest],
                    [x["cols"] for x in rows], percent) if rest[i]["node"] != rows[j]["node"]]
                forest = _forest(pairs)
                if forest:
                    yield pa.record_batch({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([y for _, y in forest], pa.int64())})

    return run


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that connect parts not connected before."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _pieced(rows: DataFrame) -> DataFrame:
    """rows (node, cluster) with the piece of the cluster that a row is in: about BLOCK_ROWS rows each, one in most
    clusters. The rows of a large cluster are dealt to SALTS parts, so that they do not meet in one task."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    large = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("pieces")).where("pieces > 1")
    large = large.select("cluster", "pieces", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    piece = F.coalesce(F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")), F.lit(0))
    return rows.withColumn("salt", salt).join(large, ["cluster", "salt"], "left").select("node", "cluster", piece.alias("piece"))


def _packed(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("cluster", "piece").agg(F.collect_list(F.struct("node", "cols")).alias(name)).withColumnRenamed("piece", f"{name}_piece")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (columns doc_id long, text string; others are ignored).

    A document's set holds its distinct shingles of k words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased); a text of fewer
    words has one, the whole; null, empty and blank texts have none and link with nothing. Two documents link when
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that links reach. Rows with a null
    doc_id are left out; rows that repeat a doc_id each count as a document of that id, so they share its component
    (n_shingles is the row's own). An empty table gives no rows. Reads docs twice; store it first if it is not a scan.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    blocks = parts(total_bytes(docs), 8 << 20, 4)
    cut = docs.mapInArrow(_cut(k, blocks),
        "block int, src long, col binary, row binary, many binary, docs binary, sizes binary, digests binary, node binary")
    counts = stored(cut.repartition(blocks, "block").mapInArrow(_count,
        "src long, shared binary, docs binary, sizes binary, digests binary, node binary"))
    nodes = stored(counts.groupBy("src").applyInArrow(_gather(percent), "doc_id long, n_shingles long, digest string, alive boolean"))
    released(counts)

    classes = nodes.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("alive").alias("alive"))
    classes = stored(classes)
    alive = classes.where("alive").select(F.col("rep").alias("doc_id")).distinct()
    whole = docs.join(alive, "doc_id", "left_semi")
    sets = stored(whole.mapInArrow(_sets(k), "node long, n long, cols binary").where("n > 0"))

    columns = sets.mapInArrow(_columns, "col long, node long, n long")
    often = columns.groupBy("col").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = Window.partitionBy("node")
    ranked = columns.join(often, "col").select("col", "node", "n", F.row_number().over(own.orderBy("often",
        "col")).alias("place"), F.count(F.lit(1)).over(own).alias("shared"))
    # the unshared columns come first in a prefix and take its places
    prefixes = stored(ranked.where(f"place <= n - ((n * {percent} + 99) div 100) + 1 - (n - shared)").select("col", "node"))
    firsts = prefixes.groupBy("col").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("col", "a")
    candidates = prefixes.join(firsts, "col").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    clusters = components(candidates).select("node", F.col("root").alias("cluster"))
    rows = stored(_pieced(clusters).join(sets, "node"))
    released(sets, prefixes, clusters)
    blocks = _packed(rows, "rows")
    heads = rows.where("node = cluster").select("cluster", F.col("cols").alias("first"))
    judged = stored(blocks.join(heads, "cluster").select("cluster", "first", "rows").mapInArrow(_first_row(percent),
        "node long, cluster long, linked boolean"))
    links = judged.where("linked and node <> cluster").select(F.col("cluster").alias("a"), F.col("node").alias("b"))
    unlinked = judged.where("not linked").select("node", "cluster").distinct()
    rest = _packed(_pieced(unlinked).join(rows.select("node", "cols"), "node"), "rest")
    products = rest.join(_packed(rows.join(unlinked.select("cluster").distinct(), "cluster", "left_semi"), "rows"), "cluster")
    pieces = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = products.repartition(pieces, "cluster", "rest_piece", "rows_piece").select("rest", "rows").mapInArrow(_blocks(percent), "a long, b long")
    same = nodes.where("n_shingles > 0").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"),
        F.col("rep").alias("b")).where("a <> b")
    roots = components(links.unionByName(found).unionByName(same))
    out = stored(nodes.join(roots, nodes["doc_id"] == roots["node"], "left").select("doc_id",
        "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
    released(nodes, classes, rows, judged, roots)
    return out


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=4, percent=85)
