"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items.

An item's windows are its runs of `window` words (the whole item, if it is shorter). A document contains a window only
if it has all its words, so by the prefix principle one word is a necessary prefix: the window's rarest, by counts over
all documents. Documents meet windows at those words; the word's place gives the only possible start of an occurrence,
which has to lie inside the document; what is left is compared word by word and byte by byte.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import parts, table, text_batches
from gameline.llm.words import prefix_sums, range_hashes

#: Bytes of benchmark text that are looked up at once; a larger benchmark takes several maps over the documents. The
#: index of a block, which is what is broadcast, takes about eight bytes for each byte of its text.
BLOCK_BYTES = 8 << 20
#: Places of documents and windows that are compared at once.
CANDIDATES = 1 << 20
#: A-Z to lower case, bytes of no word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Hashes of all words, number of words of each text, the words joined by spaces and the place of each."""
    joined, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = word_list(text)
        if words:
            counts[i] = len(words)
            joined.append(b" ".join(words))
    if not joined:
        return np.zeros(0, dtype=np.uint64), counts, b"", np.zeros(1, dtype=np.int64)
    text = b" ".join(joined) + b" "
    data = np.frombuffer(text, dtype=np.uint8)
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end + 1])
    return range_hashes(prefix_sums(data), start[:-1], end), counts, text, start


def _in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), max(len(sorted_values) - 1, 0))
    return at, sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), dtype=bool)


def _count_words(vocabulary):
    """Map: occurrences of the benchmark's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in text_batches(batches, "text"):
            h, _, _, _ = _hashed(batch.column("text").to_pylist())
            at, found = _in(known, h)
            total += np.bincount(at[found], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"word": known[seen].view(np.int64), "n": total[seen]})

    return run


def _index(items: list[tuple[str, str]], window: int, count: dict[int, int]) -> dict:
    """The windows of items under the hash of their rarest word, as arrays: a window is a stretch of the items' words
    joined by spaces. Windows of equal bytes are one, with all items that hold it."""
    names: dict[str, int] = {}
    known: dict[int, list[int]] = {}
    blobs, holders, prefix, offset, length, low, high, at = [], [], array("Q"), array("i"), array("i"), array("q"), array("q"), 0
    for item, text in items:
        words = word_list(text)
        if not words:
            continue
        number = names.setdefault(item, len(names))
        h, _, blob, start = _hashed([text])
        n = min(window, len(words))
        rarity = [(count.get(int(x), 0), int(x)) for x in h]
        first, end = np.arange(len(words) - n + 1), np.arange(n, len(words) + 1)
        content = range_hashes(prefix_sums(np.frombuffer(blob, dtype=np.uint8)), start[first], start[end])
        kept = False
        for s, c in enumerate(content.tolist()):
            bytes_of = blob[start[s] : start[s + n]]
            same = next((i for i in known.get(c, ()) if bytes_of == _window(blobs, low[i], high[i])), None)
            if same is not None:
                holders[same].append(number)
                continue
            o = min(range(n), key=lambda j: (*rarity[s + j], j))  # noqa: B023
            known.setdefault(c, []).append(len(prefix))
            holders.append([number])
            prefix.append(int(h[s + o]))
            offset.append(o)
            length.append(n)
            low.append(at + int(start[s]))
            high.append(at + int(start[s + n]))
            if not kept:  # at once, as windows of the same item may be equal
                blobs.append((at, blob))
                kept = True
        at += len(blob)
    text = bytearray(at)
    for lo, blob in blobs:
        text[lo : lo + len(blob)] = blob
    order = np.argsort(np.array(prefix, dtype=np.uint64), kind="stable")
    held = [sorted(set(holders[i])) for i in order]
    columns = {"prefix": (prefix, "u8"), "offset": (offset, "i4"), "length": (length, "i4"), "low": (low, "i8"), "high": (high, "i8")}
    return {c: np.array(v, dtype=t)[order] for c, (v, t) in columns.items()} | {"text": bytes(text),
        "names": list(names), "held": np.array([x for v in held for x in v], dtype=np.int32), "cuts": np.cumsum([0,
        *map(len, held)])}


def _window(blobs: list[tuple[int, bytes]], low: int, high: int) -> bytes:
    at, blob = blobs[bisect_right(blobs, low, key=lambda x: x[0]) - 1]
    return blob[low - at : high - at]


def _scan(index):
    """Map: adds the occurrences of the index' windows to n_words, items, spans and n_hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        heads, first = np.unique(x["prefix"], return_index=True)
        several = np.diff(np.append(first, len(x["prefix"])))
        for batch in text_batches(batches, "text"):
            h, counts, text, start = _hashed(batch.column("text").to_pylist())
            begin = np.concatenate([[0], np.cumsum(counts)])
            at, found = _in(heads, h)
            place = np.flatnonzero(found)
            n = several[at[place]] if len(heads) else np.zeros(0, dtype=np.int64)
            items: list[set[str]] = [set(v or ()) for v in batch.column("items").to_pylist()]
            spans = [np.frombuffer(v or b"", dtype=np.int64).reshape(-1, 2).tolist() for v in batch.column("spans").to_pylist()]
            for places in np.split(place, np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1):  # a frequent word has many candidates
                if not len(places):
                    continue
                m = several[at[places]]
                windows = np.repeat(first[at[places]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                w_place = np.repeat(places, m)
                doc = np.searchsorted(begin, w_place, side="right") - 1
                s = w_place - x["offset"][windows]
                e = s + x["length"][windows]
                inside = (s >= begin[doc]) & (e <= begin[doc + 1])
                windows, doc, s, e = windows[inside], doc[inside], s[inside], e[inside]
                like = start[e] - start[s] == x["high"][windows] - x["low"][windows]  # as many bytes
                for w, d, a, b in zip(windows[like].tolist(), doc[like].tolist(), s[like].tolist(), e[like].tolist(), strict=True):
                    if text[start[a] : start[b]] == x["text"][x["low"][w] : x["high"][w]]:
                        items[d].update(x["names"][i] for i in x["held"][x["cuts"][w] : x["cuts"][w + 1]])
                        spans[d].append([a - int(begin[d]), b - int(begin[d])])
            hit = []
            for v in spans:
                last = total = 0
                for a, b in sorted(v):
                    total += max(0, b - max(a, last))
                    last = max(last, b)
                hit.append(total)
            keep = {c: batch.column(c) for c in batch.schema.names if c not in ("n_words", "n_hit", "items", "spans")}
            yield pa.record_batch({**keep, "n_words": counts, "n_hit": pa.array(hit, pa.int64()),
                "items": pa.array([sorted(v) for v in items], pa.list_(pa.string())), "spans": pa.array([np.array(v,
                dtype=np.int64).tobytes() for v in spans], pa.binary())})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The columns of docs with n_words, n_hit, n_items, items (the items' ids as sorted strings), spans (packed 64-bit
    pairs: first word, end), items_sha256 and contaminated; one row for each row of docs.

    A document word is hit where any occurrence of a window covers it. A null or wordless text has no words and no
    hits. Items without words or with a null item_id have no windows; items that repeat an id are one item. An empty
    benchmark hits nothing. Columns of docs named like a result column are replaced.
    """
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "n_items", "items", "spans", "items_sha256", "contaminated")
    kept = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in kept])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = parts(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"], BLOCK_BYTES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
        "items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast("binary")})
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        words = np.unique(_hashed([t for _, t in rows])[0])
        vocabulary = spark.sparkContext.broadcast(words)
        counts = docs.select("text").mapInArrow(_count_words(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        count = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in counts}
        index = spark.sparkContext.broadcast(_index(rows, window, count))
        out = out.mapInArrow(_scan(index), f"{schema}, n_words long, n_hit long, items array<string>, spans binary")
    return out.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items",
        ","), 256), "contaminated": F.col("n_hit") > 0})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
