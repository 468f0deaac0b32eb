"""Alignment of two tokenizers' tokens. Fragments of byte ranges form a monoid: an open prefix before a fragment's first
common boundary, closed groups, and an open suffix after its last one. A short document is one fragment; the byte
ranges of a long one are aligned by different tasks and composed by a tree."""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import array_of, arrow_bounds, parts, stored, table, text_batches, trim

#: Bytes of a range; documents up to this are one fragment.
RANGE_BYTES = 256 << 10
#: Fragments that are composed at once on each level of the tree.
FAN = 8
#: Id pairs, the most frequent ones, whose counts every task has (17 bytes each); all others are joined.
SENT_PAIRS = 1_000_000
#: Stretches between spaces whose ids a Python worker remembers of each of two generations, none longer than
#: REMEMBERED_BYTES.
REMEMBERED, REMEMBERED_BYTES = 350_000, 48
#: Links of a group beyond which its ids are counted before they are paired.
LARGE_GROUP = 1 << 14
#: Links that are made at once.
LINKS = 1 << 21
#: Last bytes of characters that are surely no white space: printable ASCII, and what ends no white-space character.
_SOLID = np.array([0x21 <= b <= 0x7E or (0x8B <= b <= 0xBF and b not in (0x9F, 0xA0, 0xA8, 0xA9, 0xAF)) for b in range(256)])
_pairs: dict[bytes, Pair] = {}


def safe_cuts(data: bytes) -> np.ndarray:
    """0, the end, and the places before a space that follows no white space: no token of either kind crosses them, as
    spaces only begin words, so both sides can be encoded apart."""
    d = np.frombuffer(data, dtype=np.uint8)
    inner = np.flatnonzero((d[1:] == 0x20) & _SOLID[d[:-1]]) + 1
    return np.concatenate([[0], inner, [len(d)]])


class Pair:
    """Both tokenizers in a worker: A reads a stretch that begins with a space, B what follows that space, which it adds
    itself. Stretches are remembered; those of a text that are not known are encoded as one text, and long ones anew."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.n_b = self.b.get_piece_size()
        self.space = self.b.piece_to_id("▁")
        letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in letters]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.n_a = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in t) if t and all(c in byte_of for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(self.n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.known: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.before: dict[bytes, tuple[bytes, bytes, bool]] = {}
        n = max(self.n_a, self.n_b)
        self.names = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)]
        self.n_names = n

    def alone(self, data: bytes) -> tuple[bytes, bytes, bool]:
        """Ids of both for a stretch, as packed 32-bit numbers, and whether both have its bytes."""
        text = data.decode()
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space]
        good = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
        return array("i", a).tobytes(), array("i", b).tobytes(), good

    def together(self, new: list[bytes]) -> dict[bytes, tuple[bytes, bytes, bool]] | None:
        """The same for stretches that end in no white space, encoded as one text and cut at their ends; None if that is
        not possible."""
        cuts, data = [], b"".join(new)
        ends = np.cumsum([len(x) for x in new])
        a, b, good = self.alone(data)
        if not good:
            return None
        for side, size in ((a, self.a_len), (b, self.b_len)):
            at = np.cumsum(size[array_of(side, "i4")])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return None
            cuts.append([0, *(4 * last + 4).tolist()])
        return {x: (a[i:j], b[k:m], True) for x, i, j, k, m in zip(new, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)}

    def tokens(self, data: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both for a text that begins with a space, and whether both have its bytes."""
        cuts = safe_cuts(data).tolist()
        stretches = [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, new = self.known, []
        for x in dict.fromkeys(stretches):
            if x not in known:
                ids = self.before.get(x)
                if ids is None:
                    new.append(x)
                else:
                    known[x] = ids
        found: dict[bytes, tuple[bytes, bytes, bool]] = {}
        if new:
            solid = [x for x in new if _SOLID[x[-1]]]
            found = (self.together(solid) if solid else {}) or {}
            found.update((x, self.alone(x)) for x in new if x not in found)
            known.update((x, ids) for x, ids in found.items() if len(x) <= REMEMBERED_BYTES)
        long = any(len(x) > REMEMBERED_BYTES for x in new)
        ids = [known.get(x) or found[x] for x in stretches] if long else list(map(known.__getitem__, stretches))
        a, b = (array_of(b"".join(map(itemgetter(side), ids)), "i4").astype(np.int64) for side in (0, 1))
        return a, b, all(map(itemgetter(2), ids))

    def text(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> bytes:
        """Groups as text, a1,a2|b1;a3|b2: of_a and of_b are the tokens' group numbers, 0 to n - 1, ascending."""
        many_a, many_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        names = np.empty(len(a) + len(b), dtype=np.int64)
        at_a, at_b = np.arange(len(a)) + (upto_b - many_b)[of_a], np.arange(len(b)) + upto_a[of_b]
        names[at_a], names[at_b] = a, b
        names[at_a[upto_a - 1]] += self.n_names  # the group's last token of A
        names[at_b[upto_b - 1]] += 2 * self.n_names  # and of B
        return b"".join(map(self.names.__getitem__, names.tolist()))[:-1]


def pair_of(a_json: bytes, b_model: bytes) -> Pair:
    """The tokenizers of this worker: tasks that follow one another use the same."""
    key = hashlib.sha256(a_json + b_model).digest()
    if key not in _pairs:
        _pairs[key] = Pair(a_json, b_model)
    return _pairs[key]


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.concatenate([np.zeros(0, dtype=np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int, n_b: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of links of the groups, and their distinct id pairs (a * n_b + b) with the links of each. Links are made
    LINKS at a time; in a large group each distinct pair of ids is made once."""
    many_a, many_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    size = many_a * many_b
    start_a, start_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    small = np.flatnonzero(size <= LARGE_GROUP)
    for groups in np.split(small, np.flatnonzero(np.diff(np.cumsum(size[small]) // LINKS)) + 1):
        m = many_a[groups]
        tokens = np.repeat(start_a[groups] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        wide = np.repeat(many_b[groups], m)
        begin = np.repeat(start_b[groups], m) - (np.cumsum(wide) - wide)
        key, count = np.unique(np.repeat(a[tokens], wide) * n_b + b[np.repeat(begin, wide) + np.arange(wide.sum())], return_counts=True)
        keys.append(key)
        counts.append(count)
    for g in np.flatnonzero(size > LARGE_GROUP).tolist():
        ua, ca = np.unique(a[start_a[g] : start_a[g] + many_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + many_b[g]], return_counts=True)
        keys.append((ua[:, None] * n_b + ub).ravel())
        counts.append((ca[:, None] * cb).ravel())
    return int(size.sum()), *_sum_by_key(keys, counts)


@dataclass
class Fragment:
    """Tokens that end in a byte range. Where no boundary is in it, all are in the open prefix. text: its closed groups,
    as compressed pieces; keys and counts: id pairs of the groups that composing has closed."""

    closed: bool = False
    ok: bool = True
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    text: list[bytes] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)


def composed(left: Fragment, right: Fragment, pair: Pair) -> Fragment:
    """The fragment of both ranges, the right one following the left. Associative; an empty fragment changes nothing."""
    join = lambda x, y: (x[0] + y[0], x[1] + y[1])
    out = Fragment(left.closed or right.closed, left.ok and right.ok, left.prefix, right.suffix, left.text + right.text, left.n_a + right.n_a, left.n_b + right.n_b,
        left.n_groups + right.n_groups, left.n_links + right.n_links, left.keys + right.keys, left.counts + right.counts)
    if not left.closed:
        out.prefix = join(left.prefix, right.prefix)
    elif not right.closed:
        out.suffix = join(left.suffix, right.prefix)
    else:
        a, b = (np.array(x, dtype=np.int64) for x in join(left.suffix, right.prefix))
        if len(a) and len(b):
            zero_a, zero_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            n, keys, counts = links(a, b, zero_a, zero_b, 1, pair.n_b)
            out.text = [*left.text, _packed(pair.text(a, b, zero_a, zero_b, 1)), *right.text]
            out.n_groups, out.n_links = out.n_groups + 1, out.n_links + n
            out.keys, out.counts = [*out.keys, keys], [*out.counts, counts]
    return out


def _packed(text: bytes) -> bytes:
    return zstandard.compress(text, 1)


def _fragment(pair: Pair, data: bytes, low: int, high: int, at: int, whole: bool) -> tuple[Fragment, bytes]:
    """The fragment of the bytes (low, high] of a document whose bytes from `at` on are data, and its closed groups as
    text. The place 0 is a boundary."""
    a, b, ok = pair.tokens(data)
    end_a, end_b = at + np.cumsum(pair.a_len[a]), at + np.cumsum(pair.b_len[b])
    if not whole:
        in_a, in_b = (end_a > low) & (end_a <= high), (end_b > low) & (end_b <= high)
        a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
    bounds = np.intersect1d(end_a, end_b, assume_unique=True)
    of_a, of_b = np.searchsorted(bounds, end_a), np.searchsorted(bounds, end_b)
    n, skip = len(bounds), int(low > 0)
    if not n:
        out = Fragment(closed=low == 0, ok=ok)
        out.prefix, out.suffix = (([], []), (a.tolist(), b.tolist())) if low == 0 else ((a.tolist(), b.tolist()), ([], []))
    else:
        out = Fragment(closed=True, ok=ok, prefix=(a[of_a < skip].tolist(), b[of_b < skip].tolist()), suffix=(a[of_a == n].tolist(), b[of_b == n].tolist()))
    out.n_a, out.n_b, text = len(a), len(b), b""
    if n > skip:
        keep_a, keep_b = (of_a >= skip) & (of_a < n), (of_b >= skip) & (of_b < n)
        inner = (a[keep_a], b[keep_b], of_a[keep_a] - skip, of_b[keep_b] - skip, n - skip)
        out.n_groups = n - skip
        out.n_links, keys, counts = links(*inner, pair.n_b)
        out.keys, out.counts, text = [keys], [counts], pair.text(*inner)
    return out, text


def _ranges(each: int):
    """Map: byte ranges of long documents with the bytes that their tokens need. A range ends at a multiple of each
    bytes, unless that is in a stretch without a safe cut that is longer than a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            for uid, doc, text in zip(*(batch.column(c) for c in ("uid", "doc_id", "text")), strict=True):
                data = b" " + text.as_py().encode()
                cuts = safe_cuts(data)
                inner = np.arange(each, len(data), each)
                after = np.searchsorted(cuts, inner)
                before = np.where(cuts[after] == inner, after, after - 1)
                inner = inner[cuts[after] - cuts[before] <= each]
                bounds = [0, *inner.tolist(), len(data)]
                for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    begin = int(cuts[np.searchsorted(cuts, low, side="right") - 1])
                    stop = int(cuts[np.searchsorted(cuts, high)])
                    yield pa.RecordBatch.from_pylist([{"uid": uid.as_py(), "doc_id": doc.as_py(), "k": k, "low": low, "high": high, "at": begin,
                        "data": data[begin:stop]}], schema=_RANGE)
        trim()

    return run


_RANGE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
_COUNTS = "ok boolean, n_a long, n_b long, n_groups long, n_links long"
_WHOLE = f"uid long, doc_id long, {_COUNTS}, groups_sha256 string, text binary, pairs array<long>, times array<long>"
_OPEN = "closed boolean, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary, pieces array<binary>"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    cuts = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def _whole(a_json, b_model, keep_text: bool):
    """Map: documents of one fragment, aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_json.value, b_model.value)
        for batch in text_batches(batches, "text", 1 << 20):
            rows, pairs, times = [], [], []
            for uid, doc, text in zip(*(batch.column(c) for c in ("uid", "doc_id", "text")), strict=True):
                data = (text.as_py() or "").encode()
                f, out = _fragment(pair, b" " + data, 0, len(data) + 1, 0, True) if data else (Fragment(), b"")
                good = bool(data) and f.ok
                numbers = (f.n_a, f.n_b, f.n_groups, f.n_links) if good else (0, 0, 0, 0)
                rows.append((uid.as_py(), doc.as_py(), good, *numbers, hashlib.sha256(out).hexdigest() if good else "", out if good and keep_text else None))
                pairs.append(f.keys[0] if good else np.zeros(0, dtype=np.int64))
                times.append(f.counts[0] if good else np.zeros(0, dtype=np.int64))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), _lists(pairs), _lists(times)],
                names=["uid", "doc_id", "ok", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "text", "pairs", "times"])

    return run


def _as_row(f: Fragment) -> dict:
    keys, counts = _sum_by_key(f.keys, f.counts)
    ids = {f"{name}_{side}": np.array(x, dtype=np.int32).tobytes() for name, both in (("prefix", f.prefix), ("suffix", f.suffix)) for side, x in zip("ab", both, strict=True)}
    return {"ok": f.ok, "n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "n_links": f.n_links, "closed": f.closed, **ids, "pieces": f.text,
        "pairs": keys.tolist(), "times": counts.tolist()}


def _from_row(r: dict) -> Fragment:
    both = lambda name: tuple(array_of(r[f"{name}_{s}"], "i4").tolist() for s in "ab")
    return Fragment(r["closed"], r["ok"], both("prefix"), both("suffix"), list(r["pieces"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"],
        [np.array(r["pairs"], dtype=np.int64)], [np.array(r["times"], dtype=np.int64)])


_FRAGMENT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("ok", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
    ("closed", pa.bool_()), *((f"{n}_{s}", pa.binary()) for n in ("prefix", "suffix") for s in "ab"), ("pieces", pa.list_(pa.binary())), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _fragments(a_json, b_model):
    """Map: each byte range as a fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_json.value, b_model.value)
        for batch in text_batches(batches, "data", 1):
            for r in batch.to_pylist():
                f, text = _fragment(pair, r["data"], r["low"], r["high"], r["at"], False)
                f.text = [_packed(text)] if text else []
                yield pa.RecordBatch.from_pylist([{"uid": r["uid"], "doc_id": r["doc_id"], "k": r["k"], **_as_row(f)}], schema=_FRAGMENT)
        trim()

    return run


def _compose(a_json, b_model):
    """Map: the neighbouring fragments of a row as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_json.value, b_model.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                out = Fragment()
                for x in r["several"]:
                    out = composed(out, _from_row(x), pair)
                yield pa.RecordBatch.from_pylist([{"uid": r["uid"], "doc_id": r["doc_id"], "k": r["k"], **_as_row(out)}], schema=_FRAGMENT)
        trim()

    return run


def _digests(keep_text: bool):
    """Map: the composed fragments of whole documents, as rows like those of short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                sha, text = hashlib.sha256(), []
                for j, piece in enumerate(r["pieces"]):
                    data = (b";" if j else b"") + zstandard.decompress(piece)
                    sha.update(data)
                    text += [data] if keep_text else []
                good = r["ok"] and not any(r[f"{n}_{s}"] for n in ("prefix", "suffix") for s in "ab")
                row = {"uid": r["uid"], "doc_id": r["doc_id"], "ok": good, **{c: r[c] if good else 0 for c in ("n_a", "n_b", "n_groups", "n_links")},
                    "groups_sha256": sha.hexdigest() if good else "", "text": b"".join(text) if good and keep_text else None,
                    "pairs": r["pairs"] if good else [], "times": r["times"] if good else []}
                yield pa.RecordBatch.from_pylist([row], schema=_ROW)

    return run


_ROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("ok", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
    ("text", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def alignments(docs: DataFrame, a_json: bytes, b_model: bytes, keep_text: bool = False, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two stored tables. Documents: uid, doc_id, ok, n_a, n_b, n_groups, n_links, groups_sha256, and text (the groups,
    as a1,a2|b1;a3|b2) if wanted. Links: (uid, long, pairs, times), the id pairs of a stretch of a document with the
    number of links of each; a document that is long has several such rows."""
    spark = docs.sparkSession
    arrow_bounds(spark)
    a, b = (spark.sparkContext.broadcast(x) for x in (a_json, b_model))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") >= range_bytes, F.lit(False))
    uid = F.monotonically_increasing_id()
    short = stored(docs.where(~long).select(uid.alias("uid"), "doc_id", "text").mapInArrow(_whole(a, b, keep_text), _WHOLE))
    many = docs.where(long).select((-1 - uid).alias("uid"), "doc_id", "text").mapInArrow(_ranges(range_bytes), "uid long, doc_id long, k long, low long, high long, at long, data binary")
    size = docs.where(long).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    schema = f"uid long, doc_id long, k long, {_COUNTS}, {_OPEN}, pairs array<long>, times array<long>"
    ranges = stored(many.repartition(parts(size, 8 * max(range_bytes, RANGE_BYTES)), "uid", "k").mapInArrow(_fragments(a, b), schema))
    nothing = F.array().cast("array<long>")
    tree = ranges.withColumns({"pairs": nothing, "times": nothing})
    last = ranges.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k")).first()["k"]
    values = [c for c in tree.columns if c not in ("uid", "doc_id")]
    while last:
        last //= FAN
        grouped = tree.groupBy("uid", "doc_id", F.floor(F.col("k") / FAN).alias("next")).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("several"))
        tree = grouped.select("uid", "doc_id", F.col("next").alias("k"), "several").mapInArrow(_compose(a, b), schema)
    tops = stored(tree.mapInArrow(_digests(keep_text), _WHOLE))
    own = ranges.join(tops.where("ok").select("uid"), "uid", "left_semi")
    pairs = short.select("uid", F.lit(False).alias("long"), "pairs", "times")
    for df in (own, tops):
        pairs = pairs.unionByName(df.select("uid", F.lit(True).alias("long"), "pairs", "times"))
    return short.unionByName(tops).drop("pairs", "times"), pairs.where(F.size("pairs") > 0)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best): the number of documents that hold each pair, and whether no other pair of its A id is in
    more. Pairs are summed in the tasks that read them; those of a long document are made distinct first."""
    once = links.where("not long").select(F.explode("pairs").alias("pair"))
    several = links.where("long").select("uid", F.explode("pairs").alias("pair")).distinct().select("pair")
    counts = stored(once.unionByName(several).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    a = F.floor(F.col("pair") / n_b)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _sums(sent):
    """Map: sums over a row's links of known pairs; the others stay as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            size = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            key, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
            total, top = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, row[hit], n[hit] * docs[at[hit]])
            np.add.at(top, row[hit], n[hit] * best[at[hit]])
            left = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows)))
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit])) for x in (key, n)]
            yield pa.record_batch([batch.column("uid"), pa.array(total), pa.array(top), *rest], names=["uid", "count_sum", "n_best", "pairs", "times"])
        trim()

    return run


def aligned(docs: DataFrame, a_json: bytes, b_model: bytes, keep_text: bool = False, range_bytes: int = RANGE_BYTES, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and text, the
    groups themselves, if wanted). A is a byte-level tokenizer without its special tokens, B a piece tokenizer that adds
    a space; both encode the space and the text. Texts that are null, empty or not reproduced by both have no tokens:
    zeros and ''. Repeated rows are documents each for itself; null ids stay; other columns do not matter; no documents
    give no rows.

    Tokens never cross a space that follows no white space, so stretches between such spaces are encoded apart; a
    stretch without one is encoded whole by one task, however long. The id pairs of a group are as many as its distinct
    ids of A times those of B."""
    spark = docs.sparkSession
    n_b = Pair(a_json, b_model).n_b
    rows, pairs = alignments(docs, a_json, b_model, keep_text, range_bytes)
    counts = stored(pair_counts(pairs, n_b))
    level = F.floor(F.log2("docs"))
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 at most
    least, total = 64, 0
    for x in sorted(sizes, reverse=True):
        total += sizes[x]
        if total > sent_pairs:
            break
        least = x
    sent = counts.where(level >= least).toPandas().sort_values("pair")  # sent_pairs at most
    known = spark.sparkContext.broadcast((sent["pair"].to_numpy(dtype=np.int64), sent["docs"].to_numpy(dtype=np.int64), sent["best"].to_numpy(dtype=bool)))
    summed = pairs.select("uid", "pairs", "times").mapInArrow(_sums(known), "uid long, count_sum long, n_best long, pairs array<long>, times array<long>")
    rest = summed.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    joined = rest.join(counts.where(level < least), "pair").select("uid", (F.col("n") * F.col("docs")).alias("count_sum"), F.when(F.col("best"),
        F.col("n")).otherwise(0).alias("n_best"))
    sums = summed.select("uid", "count_sum", "n_best").unionByName(joined).groupBy("uid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256",
        *["text"] * keep_text)


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    return aligned(table(spark, sf_dir, "documents"), *files)
