"""Byte-level BPE encoding and decoding. Each piece of a text is merged by a segment tree over its byte positions: the
root names the leftmost pair of least rank, and a merge is three point updates, each logarithmic in the piece."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import arrow_bounds, table, text_batches, trim

#: Pieces that a Python worker remembers of each of two generations, none longer than REMEMBERED_CHARS.
REMEMBERED, REMEMBERED_CHARS = 450_000, 48
#: Characters of a text whose pieces are made at once; those of a longer one come one by one.
AT_ONCE = 1 << 18
_coders: dict[tuple[bytes, str], Coder] = {}


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a piece: the whole piece's, if it has one; else the leftmost pair whose bytes have the least rank is
    merged, until no pair has a rank. The tree's rows, from the pairs by their first byte up to the root, hold the
    least (rank, position) below each node."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, none = len(piece), ranks.get, 1 << 62
    size = 1 << max(0, (n - 2).bit_length())
    row = [none if (rank := get(piece[i : i + 2])) is None else rank * size + i for i in range(n - 1)]
    row += [none] * (size + 1 - n)
    inner = []
    while len(row) > 1:
        inner.append(row)
        row = [x if x < y else y for x, y in zip(row[::2], row[1::2], strict=True)]
    root = row

    def put(at: int, value: int) -> None:
        for nodes in inner:
            if nodes[at] == value:  # nothing above changes
                return
            nodes[at] = value
            beside = nodes[at ^ 1]
            if beside < value:
                value = beside
            at >>= 1
        root[0] = value

    end, before = list(range(1, n + 1)), list(range(-1, n))
    while root[0] < none:
        i = root[0] % size
        right = end[i]
        stop = end[i] = end[right]
        before[stop] = i
        if right < size:
            put(right, none)
        rank = get(piece[i : end[stop]]) if stop < n and end[stop] - i <= longest else None
        put(i, none if rank is None else rank * size + i)
        if i:
            left = before[i]
            rank = get(piece[left:stop]) if stop - left <= longest else None
            put(left, none if rank is None else rank * size + left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Coder(dict):
    """Ids of pieces by their text, as packed 32-bit numbers, for as many as it remembers: what was met lately, and of
    the generation before it what is met again. Rank file and pattern of one encoding."""

    def __init__(self, file: bytes, pattern: str) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file.splitlines() if line.strip())}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        tokens: list[bytes | None] = [None] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.tokens = tokens
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("i", merged(piece.encode(), self.ranks, self.longest)).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        pieces = self.pattern.findall(text) if len(text) <= AT_ONCE and not self.pattern.groups else (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(file: bytes, pattern: str) -> Coder:
    """The coder of this worker: tasks that follow one another use the same."""
    key = (hashlib.sha256(file).digest(), pattern)
    if key not in _coders:
        _coders[key] = Coder(file, pattern)
    return _coders[key]


def _without(df: DataFrame, *made: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in made]


def _fields(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encoded(docs: DataFrame, file: bytes, pattern: str, column: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids (array of int): the ids of each whole text by the ranks of file (lines of a token in base64 and its
    rank), every match of pattern merged separately, without special tokens. Null and empty texts have no ids. All
    columns and repeated rows stay; a column named ids is replaced. Texts are read match by match, so that a long one
    needs no more than its ids besides; a single match of n bytes takes n log n steps."""
    arrow_bounds(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(file)
    docs = docs.select(*[F.col(f"`{c}`") for c in _without(docs, "ids")]).withColumn(column, F.col(f"`{column}`").cast("string"))
    kept = [c for c in docs.columns if keep_text or c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(sent.value, pattern)
        for batch in text_batches(batches, column):
            ids = [own.encode(text.as_py()) if text.is_valid else b"" for text in batch.column(column)]
            cuts = np.cumsum([0, *map(len, ids)]) // 4
            found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            yield pa.record_batch({**{c: batch.column(c) for c in kept}, "ids": found})

    return docs.mapInArrow(run, f"{_fields(docs, kept)}ids array<int>")


def decoded(rows: DataFrame, file: bytes, pattern: str, column: str = "ids") -> DataFrame:
    """rows with bytes: the tokens of their ids, joined. Null ids give null, no ids no bytes; an id without a token
    raises an error. All columns and repeated rows stay; a column named bytes is replaced."""
    sent = rows.sparkSession.sparkContext.broadcast(file)
    rows = rows.select(*[F.col(f"`{c}`") for c in _without(rows, "bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(sent.value, pattern)
        for batch in batches:
            ids = batch.column(column)
            texts = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in ids]
            yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names}, "bytes": pa.array(texts, pa.binary())})
        trim()

    return rows.mapInArrow(run, f"{_fields(rows, rows.columns)}bytes binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        file = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encoded(docs, file, public_tokenizers.PATTERN, keep_text=False)
    out = decoded(ids, file, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"),
        ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
