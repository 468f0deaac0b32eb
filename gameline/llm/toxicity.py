"""Toxicity by compression distance: windows of words compressed with a toxic and an ordinary zstandard dictionary.

One dictionary is trained on windows of ordinary text. The other is trained on toxic text, on the stretches of words that
are much likelier there and that recur after different words (copies of a text repeat its words after the same ones).
Before compression each word is followed by eight bytes of its digest, which nothing but the same word repeats: so a match
that takes in a whole word is longer than one that only shares syllables with it. Both dictionaries hold the same ordinary content, so an ordinary window compresses alike with either, and the difference of its two
lengths comes from what the toxic dictionary knows. For each threshold of that difference, a document has a number and a
share of windows beyond it; a logistic curve over these, fitted on held-in labels, calibrates the thresholds to a score.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import released, stored, table, text_batches
from gameline.llm.quality import labelled_sample

#: Labelled documents that dictionaries and calibration are fitted on, half of them toxic where there are enough, and
#: bytes of all their texts: of documents in the order of their ids' hashes, those that still fit. They are used whole.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Words of a window and from one window to the next.
WINDOW, STEP = 6, 3
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 60_000, 8_192, 3
#: Windows that a dictionary is trained on at most.
TRAINED = 100_000
#: Differences of compressed lengths, in bytes, that are calibrated: from a digest and two bytes on.
THRESHOLDS = tuple(range(10, 22))
#: What makes a word telling: toxic sample texts that have it, different words before it there, and how much likelier a
#: toxic text is to have it than an ordinary one.
RECURS, CONTEXTS, RATIO = 3, 6, 20.0
#: A constant end of every window: a match that starts in the last bytes of the input is not searched for.
_TAIL = bytes(range(1, 9)) + bytes(range(14, 32))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tagged(own: list[bytes]) -> list[bytes]:
    """Words with their digests."""
    return [w + xxhash.xxh3_64_digest(w) for w in own]


def windows(text: str | None) -> list[bytes]:
    """Runs of WINDOW words, with digests, of the A-Z-lower-cased text, each STEP words after the one before; a shorter text
    is one."""
    own = tagged(words(text))
    return [b" " + b" ".join(own[i : i + WINDOW]) + b" " for i in range(0, max(1, len(own) - WINDOW + STEP), STEP)] if own else []


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: their text is the dictionary
        return b"".join(dict.fromkeys(samples))[:size]


def telling_stretches(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Runs of telling words, with digests, in the toxic texts."""
    often, plain, before = Counter(), Counter(), {}
    for text in toxic:
        own = words(text)
        often.update(set(own))
        for previous, word in zip([b"", *own], own):
            seen = before.setdefault(word, set())
            if len(seen) < CONTEXTS:
                seen.add(previous)
    for text in ordinary:
        plain.update(set(words(text)))
    telling = {w for w, n in often.items() if n >= RECURS and len(before[w]) >= CONTEXTS and n / len(toxic) >= RATIO * (plain[w] + 0.5) / (len(ordinary) + 1)}
    out = []
    for text in toxic:
        run: list[bytes] = []
        for word in [*words(text), b""]:
            if word in telling:
                run.append(word)
            elif run:
                out.append(b" " + b" ".join(tagged(run)) + b" ")
                run = []
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str], seed: int = 7) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents of equal length; what they share stands at the same distance in both."""
    rng = random.Random(seed)
    own = telling_stretches(toxic, ordinary) or [w for t in toxic for w in windows(t)]
    plain = [w for t in ordinary for w in windows(t)]
    base = _trained(ORDINARY_BYTES, rng.sample(plain, min(len(plain), TRAINED)))
    bad = _trained(TOXIC_BYTES, rng.sample(own, min(len(own), TRAINED)))
    return base + bad + _TAIL, base + bytes(len(bad)) + _TAIL


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Differ:
    """Compressed lengths of windows, ordinary less toxic."""

    def __init__(self, pair: tuple[bytes, bytes]) -> None:
        self.toxic, self.ordinary = _compressor(pair[0]), _compressor(pair[1])

    def __call__(self, text: str | None) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in (w + _TAIL for w in windows(text))], dtype=np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """1, and for each threshold the logarithms of the number and the percentage of windows beyond it."""
        d = self(text)
        beyond = (d[:, None] >= np.array(THRESHOLDS)).sum(axis=0)
        return np.concatenate([[1.0], np.log1p(beyond), np.log1p(100 * beyond / max(len(d), 1))])


def calibrate(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 30) -> np.ndarray:
    """Weights of the logistic curve, the first one's size not penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def _sampled_features(pairs):
    """Features of sample texts through the dictionaries of the half of the sample that they are not in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differs = [Differ(pair) for pair in pairs.value]
        for batch in text_batches(batches, "text"):
            rows = zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield pa.record_batch({"label": batch.column("label"), "x": pa.array([differs[1 - half].features(t) for half,
                t in rows], pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn, label: str, sample: int) -> dict | None:
    """Dictionaries and calibration from the labelled sample; None without both labels. The calibration sees each half
    of the sample through dictionaries of the other half, so that it learns from text that is new to them."""
    sc = docs.sparkSession.sparkContext
    found = labelled_sample(docs, labels, label, learn, sample).withColumn("half", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int"))
    rows = stored(found)
    fits, total = [], 0
    for r in sorted(rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect(),
        key=lambda r: (r["h"], r["doc_id"])):  # numbers of `sample` documents
        if total + (r["n"] or 0) <= SAMPLE_BYTES:
            total += r["n"] or 0
            fits.append(r["doc_id"])
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in set(fits)], "doc_id long")), "doc_id") if fits else rows.limit(0)
    own = [(r["half"], r["label"], r["text"]) for r in rows.orderBy("doc_id", "text").select("half", "label", "text").toLocalIterator()]
    if {y for _, y, _ in own} != {0, 1}:
        return None
    of = lambda y, half=None: [t for h, v, t in own if v == y and half in (None, h) and t]
    pairs = sc.broadcast([train_dictionaries(of(1, half), of(0, half)) for half in (0, 1)])
    seen = rows.select("half", "label", "text").mapInArrow(_sampled_features(pairs), "label int, x array<double>").toArrow()
    released(rows)
    x, y = np.array(seen.column("x").to_pylist(), dtype=np.float64), np.asarray(seen.column("label"), dtype=np.float64)
    order = np.lexsort((*x.T, y))  # so that the sums do not depend on the order of the rows
    weights = calibrate(x[order], y[order])
    share = labels.where(F.col(label).isin(0, 1)).where(learn).agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    weights[0] += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))  # the sample has more toxic texts than the corpus
    return {"pair": train_dictionaries(of(1), of(0)), "weights": weights}


def _score(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ, weights = Differ(model.value["pair"]), model.value["weights"]
        for batch in text_batches(batches, "text"):
            z = np.array([differ.features(t) @ weights for t in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.record_batch({**{c: batch.column(c) for c in keep}, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", threshold: float = 0.3,
    sample: int = SAMPLE, keep_text: bool = False) -> DataFrame:
    """The columns of docs but text (with it, if keep_text), with score (0 to 1) and predicted (1 if score >= threshold).

    learn is a boolean column over doc_id: labels of other documents are not looked at. Null, empty and blank texts
    have no windows; they get the score of a document without toxic windows. Without labels of both kinds every score
    is 0.5. Rows that repeat count each; an empty table gives no rows. Columns of docs named score or predicted are
    replaced.
    """
    model = fit(docs, labels, learn, label, sample)
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    if model is None:
        scored = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.lit(0.5).alias("score"))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), [f.name for f in kept]), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held)
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), ~held).select("doc_id", "held_out", "score", "predicted")
