"""Suffix-array deduplication: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

1. Every text is cut at minimisers: a segment is a run of windows (strings of `length` bytes) with the same smallest
   anchor (k-gram). Equal windows have equal anchors at the same place, so a window whose anchor occurs once in the
   corpus is unique. A first pass finds repeated anchors, as bits of a table of bounded size.
2. A second pass sends the segments of repeated anchors to the bucket of their anchor. Equal segments collapse to the
   first one, in the map task and again in the bucket; all windows of the others start earlier elsewhere. Segments of
   very frequent anchors are cut to pieces and dealt out by the bytes that all windows of a piece share.
3. A bucket puts the segments left in shards, sorts each shard's suffixes, and merges the shards' transforms: the
   interleave ordered by the first h symbols follows from that by h - 1 symbols in one stable pass over the symbols,
   together with its intervals of common prefix h. After `length` passes, intervals of two or more windows are the
   repeats; all but the first are removed.
4. The removed spans return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import array_of, parts, stored, table, text_batches, total_bytes, trim
from gameline.llm.words import mix, prefix_sums, range_hashes

#: Bytes of an anchor; windows of `length` bytes hold length - ANCHOR + 1 of them.
ANCHOR = 50
#: log2 of the bits of the table of repeated anchors: at most 256 MB. Beyond it more segments travel, with the same result.
MOST_BITS = 31
#: Occurrences of an anchor from which its segments are dealt out by content; fewer are about MERGE bytes at most.
HOT = 8_000
#: Windows of a piece of such a segment.
PIECE = 8
#: Symbols of a shard and of one merge.
SHARD, MERGE = 1 << 18, 1 << 20
#: Bytes of text for each bucket; a task takes one bucket.
BUCKET_BYTES = 12 << 20
_UNIT = 1 << 19
_SLOTS = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("many", pa.binary()), ("count", pa.binary())])
_SEGMENTS = pa.schema([("bucket", pa.int32()), ("number", pa.int32()), ("rows", pa.binary()), ("salt", pa.binary()), ("data", pa.binary())])
_COLUMNS = ("doc", "part", "start", "size", "place")
_SPANS = "doc_id long, part int, start long, stop long"


def _units(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts in bytes, document row, offset in its text) for texts cut to units that overlap by length - 1."""
    rows: list[tuple[int, int, bytes]] = []
    total = 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for at in range(0, max(len(data) - length + 1, 0), _UNIT):
            piece = data[at : at + _UNIT + length - 1]
            if total and total + len(piece) >= 2 * _UNIT:
                yield _joined(rows)
                rows, total = [], 0
            rows.append((i, at, piece))
            total += len(piece)
    if rows:
        yield _joined(rows)


def _joined(rows):
    size = np.array([len(x) for _, _, x in rows], dtype=np.int64)
    return np.frombuffer(b"".join(x for _, _, x in rows), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]), np.array([i for i,
        _, _ in rows]), np.array([at for _, at, _ in rows], dtype=np.int64)


def _segments(data: np.ndarray, bounds: np.ndarray, length: int):
    """Runs of windows with the same anchor: first window, number of windows, anchor position, anchor hash, prefix sums."""
    sums = prefix_sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = range_hashes(sums, at, at + ANCHOR)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | at.astype(np.uint64)  # equal anchors in a window: the first
    span, width = length - ANCHOR + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    unit = np.diff(bounds) - length + 1
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(unit)[:-1]]), unit) + np.arange(unit.sum())
    key = key[first]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1)]))
    size = np.diff(np.append(new, len(key)))
    where = (key[new] & low).astype(np.int64)
    return first[new], size, where, h[where], sums


def _slots(length: int, bits: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (1 << bits) // blocks
        for batch in text_batches(batches, "text"):
            for data, bounds, _, _ in _units(batch, length):
                _, _, _, h, _ = _segments(data, bounds, length)
                slot, n = np.unique(h >> np.uint64(64 - bits), return_counts=True)
                cuts = np.searchsorted(slot, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(each))
                rows = []
                for b in range(blocks):
                    s, c = (slot[cuts[b] : cuts[b + 1]] - np.uint64(b * each)).astype(np.uint32), n[cuts[b] : cuts[b + 1]]
                    rows.append({"block": b, "once": s[c == 1].tobytes(), "many": s[c > 1].tobytes(), "count": c[c > 1].astype(np.uint32).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=_SLOTS)

    return run


def _repeats(each: int):
    """Block of the table: bits of the slots that occur twice or more, and the slots that occur HOT times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["block"] not in seen:
                    seen[x["block"]] = np.zeros(each, dtype=np.uint16)
                count = seen[x["block"]]
                once, many, n = array_of(x["once"], "u4"), array_of(x["many"], "u4"), array_of(x["count"], "u4")
                count[once] = np.minimum(count[once], HOT) + 1
                count[many] = np.minimum(count[many].astype(np.uint32) + np.minimum(n, HOT), HOT)  # a sum of two may not fit 16 bits
        for block, count in seen.items():
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(count > 1).tobytes()],
                pa.binary()), "hot": pa.array([np.flatnonzero(count >= HOT).astype(np.uint32).tobytes()],
                pa.binary())})

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _spans_of(doc, part, start, stop) -> pa.RecordBatch:
    """Spans, most of those that touch joined (a span inside another may leave two; their union is taken at the end)."""
    order = np.lexsort((start, part, doc))
    doc, part, start, stop = doc[order], part[order], start[order], stop[order]
    if len(doc):
        same = (doc[1:] == doc[:-1]) & (part[1:] == part[:-1])
        group = np.concatenate([[0], np.cumsum(~(same & (start[1:] <= stop[:-1])))])
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        doc, part, start, stop = doc[head], part[head], start[head], np.maximum.reduceat(stop, head)
    return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "part": pa.array(part, pa.int32()),
        "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _deal(length: int, bits: int, buckets: int, bitmap, hot):
    """Segments of repeated anchors, equal ones of a batch once, in one row for each bucket. The row of bucket -1 holds
    the spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent, pack = bitmap.value, hot.value, zstandard.ZstdCompressor(level=3).compress
        for batch in text_batches(batches, "text"):
            ids, part_of = np.asarray(batch.column("doc_id"), dtype=np.int64), np.asarray(batch.column("part"), dtype=np.int32)
            for data, bounds, rows, base in _units(batch, length):
                first, size, where, h, sums = _segments(data, bounds, length)
                slot = h >> np.uint64(64 - bits)
                keep = (known[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
                first, size, where, h, slot = first[keep], size[keep], where[keep], h[keep], slot[keep]
                salt = np.zeros(len(h), dtype=np.uint64)
                if len(frequent) and len(h):
                    many = frequent[np.minimum(np.searchsorted(frequent, slot), len(frequent) - 1)] == slot
                    cut = _pieces(first[many], size[many], where[many], h[many], sums, length)
                    first, size, where, h, salt = (np.concatenate([x[~many], y]) for x, y in zip((first, size, where, h, salt), cut, strict=True))
                if not len(h):
                    continue
                stop = first + size + length - 1
                content = range_hashes(sums, first, stop)
                unit = np.searchsorted(bounds, first, side="right") - 1
                doc, part, start = ids[rows[unit]], part_of[rows[unit]], first - bounds[unit] + base[unit]
                key = h ^ salt
                order = np.lexsort((start, part, doc, content, key))
                fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])])
                rows_of = np.stack([doc, part, start, size + length - 1, where - first], axis=0)

                def packed(bucket: int, s: np.ndarray, text: bool) -> dict:
                    s = np.sort(s)  # in the order of the texts, which packs best
                    return {"bucket": bucket, "number": len(s), "rows": pack(_packed(rows_of[:, s])),
                        "salt": salt[s].tobytes() if salt[s].any() else None, "data": pack(data[_ranges(first[s],
                        size[s] + length - 1)].tobytes()) if text else None}  # noqa: B023

                head, copies = order[fresh], order[~fresh]
                out = [packed(-1, copies, False)] if len(copies) else []
                bucket = (key[head] % np.uint64(buckets)).astype(np.int64)
                head = head[np.argsort(bucket, kind="stable")]
                cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
                out += [packed(b, head[cuts[b] : cuts[b + 1]], True) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENTS)

    return run


def _pieces(first, size, where, h, sums, length):
    """Segments cut by the place of the anchor in the window, PIECE places each; the key has the bytes all share."""
    # windows of place block q start between where - PIECE*q - PIECE + 1 and where - PIECE*q
    q0, q1 = (where - first - size + 1) // PIECE, (where - first) // PIECE
    n = q1 - q0 + 1
    seg = np.repeat(np.arange(len(first)), n)
    q = _ranges(q0, n)
    lo = np.maximum(first[seg], where[seg] - PIECE * q - PIECE + 1)
    hi = np.minimum(first[seg] + size[seg] - 1, where[seg] - PIECE * q)
    middle = where[seg] - PIECE * q
    shared = range_hashes(sums, middle, middle + length - PIECE + 1)
    return lo, hi - lo + 1, where[seg], h[seg], mix(shared + q.astype(np.uint64))


def _packed(rows: np.ndarray) -> bytes:
    """Columns of numbers as bytes, each column's differences by significance, so that they compress well."""
    step = np.ascontiguousarray(np.diff(rows, axis=1, prepend=0), dtype=np.int64)
    return step.view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1).tobytes()


def _unpacked(data: bytes, number: int) -> np.ndarray:
    step = np.frombuffer(data, dtype=np.uint8).reshape(len(_COLUMNS), 8, number).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(step).view(np.int64)[:, :, 0], axis=1)


def _suffixes(symbols: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """Suffix array of a shard of 0-ended strings; a suffix ends at its string's 0, equal ones keep their order."""
    n, at = len(symbols), np.arange(len(symbols))
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([symbols, np.zeros(8, dtype=np.uint8)])
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(at + j <= stop, padded[j : j + n], 0).astype(np.uint64)
    h = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) + 1
        if h > most or new[1:].all():
            return order
        ahead = np.minimum(at + h, n - 1)
        key = (rank * np.int64(n + 2) + np.where(at + h <= stop, rank[ahead], 0)).astype(np.uint64)
        h *= 2


def merged_repeats(data: np.ndarray, size: np.ndarray, length: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the strings (concatenated in data) that share their bytes with another window: (interval, string,
    offset), by merging the transforms of `shards` shards."""
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    bwt, string, offset, lf = [], [], [], []
    base = 0
    for s in range(shards):
        own = np.arange(s, len(size), shards)
        n = size[own] + 1
        end = np.cumsum(n) - 1
        symbols = np.zeros(n.sum(), dtype=np.uint8)
        inner = np.ones(len(symbols), dtype=bool)
        inner[end] = False
        symbols[inner] = data[_ranges(begin[own], size[own])] + 1  # UTF-8 has no byte 255
        order = _suffixes(symbols, np.repeat(end, n), int(n.max()))
        owner = np.repeat(np.arange(len(own)), n)
        off = np.arange(len(symbols)) - np.repeat(end - n + 1, n)
        last = np.where(off[order] > 0, symbols[order - 1], 0).astype(np.uint8)
        step = np.empty(len(order), dtype=np.int64)
        step[np.argsort(last, kind="stable")] = np.arange(len(order))
        bwt.append(last)
        lf.append((step + base).astype(np.int32))
        string.append(own[owner[order]].astype(np.int32))
        offset.append(off[order].astype(np.int32))
        base += len(order)
    bwt, lf, string, offset = (np.concatenate(x) for x in (bwt, lf, string, offset))
    merged, interval = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), dtype=np.int32)
    for _ in range(length):
        symbol = bwt[merged]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], interval[order]
        new = np.ones(len(order) + 1, dtype=bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])  # else the common prefix is one longer
        # what an interval of one leads to is alone too, so only rows of longer intervals go on
        more = ~(new[:-1] & new[1:])
        merged, interval = lf[merged[order[more]]], np.cumsum(new[:-1], dtype=np.int32)[more]
        if not len(merged):
            break
    whole = offset[merged] + length <= size[string[merged]]
    merged, interval = merged[whole], interval[whole]
    repeated = np.bincount(interval)[interval] > 1 if len(interval) else np.zeros(0, dtype=bool)
    merged = merged[repeated]
    return interval[repeated], string[merged], offset[merged]


def _solve(length: int):
    """Bucket task: spans of all windows that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[dict]] = {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["bucket"] == -1:
                    doc, part, start, size, _ = _unpacked(zstandard.ZstdDecompressor().decompress(x["rows"]), x["number"])
                    yield _spans_of(doc, part, start, start + size)
                else:
                    own.setdefault(x["bucket"], []).append(x)
        while own:  # one bucket, as partitions are dealt by bucket
            yield from _bucket(own.popitem()[1], length)
        trim()

    return run


def _opened(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, salts, bytes) of a bucket's rows, which are taken off the list one by one."""
    unpack = zstandard.ZstdDecompressor().decompress
    columns, salts, data = [], [], bytearray()
    while rows:
        x = rows.pop()
        columns.append(_unpacked(unpack(x["rows"]), x["number"]))
        salts.append(array_of(x["salt"], "u8") if x["salt"] else np.zeros(x["number"], dtype=np.uint64))
        data += unpack(x["data"])
    return np.concatenate(columns, axis=1), np.concatenate(salts), np.frombuffer(data, dtype=np.uint8)


def _bucket(rows: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    (doc, part, start, size, place), anchor, data = _opened(rows)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    content = np.empty(len(anchor), dtype=np.uint64)
    at = 0
    while at < len(anchor):  # in parts of bounded size
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + _UNIT)))
        # pieces of hot segments need not hold their anchor; they are told apart by their salt
        lo, own = begin[at], begin[at:to] - begin[at]
        sums = prefix_sums(data[lo : begin[to - 1] + size[to - 1]])
        content[at:to] = range_hashes(sums, own, own + size[at:to])
        plain = np.flatnonzero(anchor[at:to] == 0)
        there = own[plain] + place[at:to][plain]
        anchor[at:to][plain] = range_hashes(sums, there, there + ANCHOR)
        at = to
    order = np.lexsort((start, part, doc, content, anchor))
    a, c = anchor[order], content[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    copies = order[~fresh]
    if len(copies):
        yield _spans_of(doc[copies], part[copies], start[copies], start[copies] + size[copies])
    head = order[fresh]
    a = anchor[head]
    several = np.concatenate([[False], a[1:] == a[:-1]])
    several[:-1] |= several[1:].copy()
    head = head[several]
    a = anchor[head]
    total = np.cumsum(size[head])
    at = 0
    while at < len(head):  # whole groups of an anchor, about MERGE symbols
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + MERGE, side="right"))
        to = min(len(head), max(to, at + 1))
        while to < len(head) and a[to] == a[to - 1]:
            to += 1
        s = head[at:to]
        n = size[s]
        shards = int(min(len(s), max(2, -(-int(n.sum()) // SHARD))))
        interval, string, offset = merged_repeats(data[_ranges(begin[s], n)], n, length, shards)
        if len(interval):
            d, p, place = doc[s][string], part[s][string], start[s][string] + offset
            order = np.lexsort((place, p, d, interval))
            later = order[np.concatenate([[False], interval[order][1:] == interval[order][:-1]])]
            yield _spans_of(d[later], p[later], place[later], place[later] + length)
        at = to


def _apply(keep_text: bool, keep_bytes: bool):
    """Text without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                joined: list[list[int]] = []
                for x in sorted((s["start"], s["stop"]) for s in spans or []):
                    if joined and x[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], x[1])
                    else:
                        joined.append(list(x))
                kept, at = [], 0
                for lo, hi in joined:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                rest = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(joined))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["kept"].append(rest if keep_bytes else None)
                out["kept_text"].append(rest.decode("utf-8", "ignore") if keep_text else None)
            others = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "spans", "part")}
            yield pa.record_batch({**others, **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes",
                "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                "kept": pa.array(out["kept"], pa.binary()), "kept_text": pa.array(out["kept_text"],
                pa.string())})

    return run


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, part, start, stop): byte spans, possibly overlapping, covered by strings of `length` bytes that start
    earlier too. docs has doc_id, part (0 where doc_id is unique) and text; it is read twice."""
    spark = docs.sparkSession
    size = total_bytes(docs)
    bits = min(MOST_BITS, max(16, (size // 3).bit_length()))
    blocks = 1 << max(2, bits - 23)
    slots = docs.mapInArrow(_slots(length, bits, blocks), "block int, once binary, many binary, count binary")
    found = slots.repartitionById(blocks, F.col("block")).mapInArrow(_repeats((1 << bits) // blocks), "block int, bits binary, hot binary").collect()
    bitmap, hot, each = np.zeros((1 << bits) // 8, dtype=np.uint8), [], (1 << bits) // blocks
    for r in found:
        bitmap[r["block"] * each // 8 : (r["block"] + 1) * each // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        hot.append(np.frombuffer(r["hot"], dtype=np.uint32).astype(np.uint64) + np.uint64(r["block"] * each))
    sent = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(np.sort(np.concatenate(hot)) if hot else np.zeros(0, dtype=np.uint64))
    buckets = parts(size, BUCKET_BYTES, 4)
    dealt = docs.mapInArrow(_deal(length, bits, buckets, *sent), "bucket int, number int, rows binary, salt binary, data binary")
    to = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("rows"), F.lit(buckets)).cast("int"))
    return dealt.repartitionById(buckets, to).mapInArrow(_solve(length), _SPANS)


def suffix_dedup(docs: DataFrame, length: int = 100, keep_text: bool = True, keep_bytes: bool = True) -> DataFrame:
    """The columns of docs but text, with n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless
    keep_bytes) and kept_text (those without characters cut in two; null unless keep_text), one row for each row of docs.

    A text counts as its UTF-8 bytes (null: empty). Every byte covered by a string of `length` bytes that also starts
    earlier - at a smaller doc_id, or earlier in the same text - goes; strings are judged on the input. Texts shorter
    than `length` bytes stay whole. Rows that repeat a doc_id are ordered by their text. Rows with a null doc_id stay
    as they are, n_removed 0. An empty table gives no rows. Columns of docs named like a result column are replaced;
    so are columns named spans or part.
    """
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "part", "spans",
        "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs, keys = docs.withColumn("part", F.lit(0)), ["doc_id"]
    else:
        keys = ["doc_id", "part"]
        docs = stored(docs.withColumn("part", (F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1).cast("int")))
    spans = stored(repeated_spans(docs.where("doc_id is not null").select("doc_id", "part", "text"), length))
    # both sides are dealt alike, about 8 MB of text to a task at any size, so that the join adds no exchange
    each = parts(total_bytes(docs), 8 << 20, 4)
    gathered = spans.repartition(each, *keys).groupBy(*keys).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = docs.repartition(each, *keys).join(gathered, keys, "left").select(*docs.columns, "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("text", "part"))
    return joined.mapInArrow(_apply(keep_text, keep_bytes),
        f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, 100, keep_text=False, keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
