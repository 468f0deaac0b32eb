"""Boosted trees for counts, with a Tweedie loss and a log link. Features are binned once; every level of a tree is one
pass over the stored bins, in which each task sums gradients by node, feature and bin, and Spark adds the tasks' sums.
Several targets are learned in the same passes, each with its own trees and its own early stopping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gameline.sources.tables import stored


@dataclass
class Tree:
    """A complete tree as heap-ordered arrays: node i has the children 2i + 1 and 2i + 2. A node without a split (feature
    -1) sends all rows left; value holds the last level's steps."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, columns: Sequence[np.ndarray], depth: int) -> np.ndarray:
        """The place, from 0, of each row among the level's nodes. columns has the bins of each feature: a node is one
        comparison of a whole column, which is cheaper than a look at every row's own feature."""
        at = np.zeros(len(columns[0]), dtype=np.uint8 if depth <= 8 else np.int64)
        for level in range(depth):
            right = np.zeros(len(at), dtype=bool)
            for node in range(2**level):
                f = self.feature[2**level - 1 + node]
                if f >= 0:
                    right |= (at == node) & (columns[f] > self.bin[2**level - 1 + node])
            at = 2 * at + right
        return at

    def step(self, columns: Sequence[np.ndarray], depth: int) -> np.ndarray:
        return self.value[self.leaves(columns, depth)]


@dataclass
class Boosted:
    """predict(array) gives the expected count. Bin 0 is for missing numbers, bin b for those above b - 1 cuts."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.cuts)

    def gains(self) -> dict[str, float]:
        """Each feature's share of the gain of all splits; zeros without any."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            split = t.feature >= 0
            np.add.at(total, t.feature[split], t.gain[split])
        return dict(zip(self.features, (total / (total.sum() or 1)).tolist(), strict=True))

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(np.asarray(x, dtype=float))
        columns = np.ascontiguousarray(bins.T)
        return np.exp(self.base + sum((t.step(columns, self.depth) for t in self.trees), np.zeros(len(bins))))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(c, x[:, j], side="left"))
    return out


def gradients(y: np.ndarray, score: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the Tweedie loss at the log of the prediction."""
    low, high = y * np.exp((1 - power) * score), np.exp((2 - power) * score)
    return high - low, (2 - power) * high - (1 - power) * low


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l1: float, l2: float, least: int, allowed: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's sums by feature and bin; rows up to the bin go left. Of equal gains the first
    feature's and the lowest bin's. Without a gain the feature is -1."""
    gl, hl, nl = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    one = int(np.argmax(allowed))  # every allowed feature's sums are the node's
    gt, ht, nt = g[one].sum(), h[one].sum(), n[one].sum()
    gain = shrunk(gl, l1) ** 2 / (hl + l2) + shrunk(gt - gl, l1) ** 2 / (ht - hl + l2) - shrunk(gt, l1) ** 2 / (ht + l2)
    gain = np.where((nl >= least) & (nt - nl >= least) & allowed[:, None], gain, 0.0)
    at = int(np.argmax(gain > gain.max() - 1e-9 * max(1.0, abs(gain.max()))))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain.max() > 1e-9 else (0.0, -1, 0)


def _schema(n_features: int, n_targets: int) -> str:
    """A row's key and split, its bins, targets and scores: plain columns, which numpy reads as they are."""
    return ", ".join(["key long", "val boolean", *[f"x{i} short" for i in range(n_features)], *[f"{c}{i} double" for c in "ys" for i in range(n_targets)]])


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bins(features: list[str], targets: list[str], cuts: list[np.ndarray], base: list[float]):
    """Map: rows as bins, targets and scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = binned(np.column_stack([_numpy(batch, c).astype(float) for c in features]), cuts)
            out = {c: batch.column(c) for c in ("key", "val")} | {f"x{i}": pa.array(rows[:, i].astype(np.int16)) for i in range(len(features))}
            out |= {f"y{i}": pa.array(_numpy(batch, c).astype(float)) for i, c in enumerate(targets)}
            yield pa.record_batch(out | {f"s{i}": pa.array(np.full(batch.num_rows, b)) for i, b in enumerate(base)})

    return run


def _advanced(trees: list[list[Tree]], depth: int, n_features: int):
    """Map: scores with the steps of trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_numpy(batch, f"x{i}") for i in range(n_features)]
            steps = {f"s{i}": pa.array(_numpy(batch, f"s{i}") + sum((t.step(x, depth) for t in ts), np.zeros(batch.num_rows))) for i, ts in enumerate(trees)}
            yield pa.record_batch({c: steps.get(c, batch.column(c)) for c in batch.schema.names})

    return run


def in_bag(keys: np.ndarray, n: int, fraction: float) -> np.ndarray:
    """Rows that round n learns from: chosen by their keys, so that a task that runs again chooses the same."""
    if fraction >= 1:
        return np.ones(len(keys), dtype=bool)
    x = keys.view(np.uint64) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < fraction


def _sums(trees: list[list[Tree]], growing: list[Tree | None], chosen: list[np.ndarray], n: int, level: int, depth: int, n_bins: int, power: float, row_fraction: float):
    """Map: a task's sums for each target: by node of the level, chosen feature and bin over the rows that round n learns
    from, and at the root the squared error over the rows held out (node -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, k, n_features = 2**level, len(trees), len(chosen[0])
        sums = np.zeros((k, 3, nodes, n_features, n_bins))
        error = np.zeros((k, 3))
        for batch in batches:
            val = _numpy(batch, "val").astype(bool)
            used = ~val & in_bag(_numpy(batch, "key"), n, row_fraction)
            columns = [_numpy(batch, f"x{j}") for j in range(n_features)]
            x, held = [c[used] for c in columns], [c[val] for c in columns] if not level else []
            for i, (ts, tree) in enumerate(zip(trees, growing, strict=True)):
                if tree is None:
                    continue
                y, score = _numpy(batch, f"y{i}"), _numpy(batch, f"s{i}")
                g, h = gradients(y[used], score[used] + sum((t.step(x, depth) for t in ts), np.zeros(len(x[0]))), power)
                node = tree.leaves(x, level).astype(np.int64) * n_bins
                for j in np.flatnonzero(chosen[i]):
                    place = node + x[j]
                    for q, w in enumerate((g, h, None)):
                        sums[i, q, :, j] += np.bincount(place, weights=w, minlength=nodes * n_bins).reshape(nodes, n_bins)
                if not level:
                    d = y[val] - np.exp(score[val] + sum((t.step(held, depth) for t in ts), np.zeros(len(held[0]))))
                    error[i] += (d @ d, 0.0, len(d))
        total = sums.reshape(k, 3, -1)
        t, place = np.nonzero(total[:, 2])
        node, rest = np.divmod(place, n_features * n_bins)
        columns = [np.append(t, np.arange(k)), np.append(node, np.full(k, -1)), np.append(rest, np.zeros(k, dtype=np.int64))]
        numbers = [np.append(total[t, j, place], error[:, j]) for j in range(3)]
        yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in columns), *(pa.array(c) for c in numbers)], names=["target", "node", "place", "g", "h", "n"])

    return run


def fit_boosted(rows: DataFrame, features: list[str], targets: list[str], validation: str, power: float = 1.2, rounds: int = 60, rate: float = 0.1, depth: int = 4,
    bins: int = 63, l1: float = 0.0, l2: float = 10.0, least: int = 20, patience: int = 10, row_fraction: float = 1.0, feature_fraction: float = 1.0,
    seed: int = 42, rewrite: int = 12) -> dict[str, Boosted]:
    """A model for each target. Rows where the boolean column validation is true choose the number of trees: a target
    stops after patience rounds without a lower squared error there and keeps its best round's trees. Rows without any
    of the targets are left out; missing features have a bin of their own. row_fraction and feature_fraction are the
    shares of rows (by their values) and of features (of each target) that a tree learns from.

    What reaches the driver is bounded by targets x nodes x features x bins. Scores are stored anew every rewrite
    rounds, so that a pass adds the steps of fewer trees than that."""
    spark = rows.sparkSession
    # sums differ in their last digits with the order of tasks; numbers are doubles throughout
    d = rows.dropna(subset=targets).select(F.coalesce(F.col(validation), F.lit(False)).alias("val"), *[F.col(c).cast("double").alias(c) for c in (*features, *targets)])
    d = d.withColumn("key", F.xxhash64(F.lit(seed), *features, *targets))
    learned = d.where("not val")
    at = [i / bins for i in range(1, bins)]
    one = learned.agg(*[F.percentile_approx(c, at, 10_000).alias(f"c{i}") for i, c in enumerate(features)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(targets)]).first()
    cuts = [np.unique(np.array([v for v in one[f"c{i}"] or [] if v is not None and np.isfinite(v)], dtype=float)) for i in range(len(features))]
    base = [float(np.log(max(one[f"m{i}"] or 0.0, 1e-6))) for i in range(len(targets))]
    n_bins = 2 + max(map(len, cuts))
    schema = _schema(len(features), len(targets))
    table = stored(d.mapInArrow(_bins(features, targets, cuts, base), schema), "bins")
    models = [Boosted(features, cuts, b, depth) for b in base]
    recent: list[list[Tree]] = [[] for _ in targets]
    best: list[tuple[float, int]] = [(np.inf, 0) for _ in targets]
    open_ = set(range(len(targets)))
    for n in range(rounds + 1):
        inner = 2**depth - 1
        growing = [Tree(np.full(inner, -1), np.zeros(inner, dtype=np.int64), np.zeros(2**depth), np.zeros(inner)) if i in open_ else None for i in range(len(targets))]
        chosen = [np.isin(np.arange(len(features)), np.random.default_rng((seed, n, i)).permutation(len(features))[: max(1, round(feature_fraction * len(features)))])
            for i in range(len(targets))]
        for level in range(depth):
            found = table.mapInArrow(_sums(recent, growing, chosen, n, level, depth, n_bins, power, row_fraction), "target long, node long, place long, g double, h double, n double")
            # the tasks' sums are few and small: few partitions, whatever the table's size
            summed = found.repartition(8, "target", "node", "place").groupBy("target", "node", "place").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
            if not level:
                for r in summed[summed.node < 0].itertuples():
                    if r.target in open_ and r.n:
                        models[r.target].losses.append(r.g / r.n)
                        best[r.target] = min(best[r.target], (r.g / r.n, n))
                        if n - best[r.target][1] >= patience:
                            open_.discard(r.target)
                if n == rounds or not open_:
                    break
            for i in open_:
                s = summed[(summed.target == i) & (summed.node >= 0)]
                total = np.zeros((3, 2**level, len(features) * n_bins))
                total[:, s.node.to_numpy(), s.place.to_numpy()] = s[list("ghn")].to_numpy().T
                _grow(growing[i], total.reshape(3, 2**level, len(features), n_bins), level, depth, l1, l2, least, rate, chosen[i])
        if n == rounds or not open_:
            break
        for i, tree in enumerate(growing):
            if i in open_:
                models[i].trees.append(tree)
                recent[i].append(tree)
        if max(map(len, recent)) >= rewrite:
            table = stored(table.mapInArrow(_advanced(recent, depth, len(features)), schema), "bins")
            recent = [[] for _ in targets]
    for m, (_, n) in zip(models, best, strict=True):
        if m.losses:
            del m.trees[n:]
    return dict(zip(targets, models, strict=True))


def _grow(tree: Tree, sums: np.ndarray, level: int, depth: int, l1: float, l2: float, least: int, rate: float, allowed: np.ndarray) -> None:
    """Splits the level's nodes; on the last level the children's steps follow from the same sums."""
    first = 2**level - 1
    for node in range(2**level):
        g, h, n = sums[:, node]
        gain, f, b = best_split(g, h, n, l1, l2, least, allowed)
        tree.feature[first + node], tree.bin[first + node], tree.gain[first + node] = f, b, gain
        if level == depth - 1:
            one = int(np.argmax(allowed))
            gt, ht = g[one].sum(), h[one].sum()
            gl, hl = (g[f, : b + 1].sum(), h[f, : b + 1].sum()) if f >= 0 else (gt, ht)
            tree.value[2 * node] = -rate * shrunk(gl, l1) / (hl + l2)
            tree.value[2 * node + 1] = -rate * shrunk(gt - gl, l1) / (ht - hl + l2) if f >= 0 else 0.0
