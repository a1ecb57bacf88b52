"""Gradient-boosted trees over histograms: ranking by lambdas or pairs, and classes.

Features are binned once.  Each round sends gradient sums per (node, feature,
bin) through one aggregation; the driver sees the best split of each node.
Gradients are rounded to whole multiples of ``1 / UNIT`` and added as integers,
so a tree depends neither on how rows are dealt out nor on a task that ran
twice.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import uniform
from ..operators.ordered import order_statistics, running
from ..sources.ledger import ContractError
from ..sources.stored import written

#: Gradients are counted in steps of ``1 / UNIT``; ten billion rows of gradient 100 fit a long.
UNIT = 1 << 20
#: Trees that tasks add to the stored scores before the scores are stored anew.
PENDING = 8


@dataclass(frozen=True)
class Boosting:
    """What is learnt and how far trees may grow."""

    objective: str = "lambdarank"
    rounds: int = 500
    leaves: int = 15
    depth: int | None = None
    learning_rate: float = 0.035
    min_rows: int = 120
    min_hessian: float = 1e-3
    l2: float = 10.0
    columns: float = 0.95
    rows: float = 1.0
    bins: int = 63
    pairs: int = 4
    classes: int = 1
    seed: int = 42


# The settings of the rankers that recipes are made of.
LISTWISE = Boosting()
LEGACY = Boosting(rounds=450, min_rows=105, l2=5.0, columns=0.9)
PAIRWISE = Boosting("pairwise", leaves=16, depth=4, learning_rate=0.04, min_rows=1, min_hessian=10.0, columns=0.9, rows=0.85)
SYMMETRIC = Boosting("softmax", rounds=600, leaves=32, depth=5, learning_rate=0.05, min_rows=1, min_hessian=0.0, l2=3.0, columns=1.0, classes=8)


class Tree(NamedTuple):
    """Splits by node (children of ``k`` are ``2k`` and ``2k + 1``) and leaf values per output."""

    splits: dict[int, tuple[int, int]]
    values: dict[int, list[float]]


@dataclass
class Model:
    """Cuts per feature and the trees over their bins."""

    settings: Boosting
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    start: list[float] = field(default_factory=lambda: [0.0])
    gains: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"trees": [(list(t.splits.items()), list(t.values.items())) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        x = json.loads(text)
        trees = [Tree({k: tuple(s) for k, s in splits}, dict(map(tuple, values))) for splits, values in x.pop("trees")]
        return cls(Boosting(**x.pop("settings")), trees=trees, **x)


# --- bins


def fit_cuts(x: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Cut points of each column: the values at ranks ``k n / bins``, exact and without repeats.

    A value's bin is the number of cuts below it, plus one; bin 0 is for nulls.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])).alias("e")
    long_ = x.select(each).select("e.*").where("value IS NOT NULL")
    ranks = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.floor(k * F.col("n") / bins).cast("long"))
    sizes = written(long_.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    wanted = sizes.select("g", F.explode(F.array_distinct(ranks)).alias("rank"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    cuts: list[list[float]] = [[] for _ in columns]
    for r in order_statistics(long_, wanted, largest=largest).groupBy("g").agg(F.array_sort(F.collect_set("value")).alias("c")).collect():
        cuts[r["g"]] = list(r["c"])
    return cuts


def bin_expression(column: str, cuts: list[float]) -> Column:
    """The bin of a column as an expression, for few cuts; tasks use ``numpy``."""
    known = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) + 1 if cuts else F.lit(1)
    return F.when(F.col(column).isNull(), 0).otherwise(known)


def _binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for k, c in enumerate(cuts):
        v = values[:, k]
        out[:, k] = np.where(np.isnan(v), 0, np.searchsorted(np.array(c), v, "left") + 1)
    return out


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The columns as doubles, nulls as NaN."""
    return np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], axis=1) if names else np.zeros((batch.num_rows, 0))


def group_key(group: list[str]) -> Column:
    """Sixty bits of a group's MD5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *group)), 1, 15), 16, 10).cast("long")


def unscored(rows: DataFrame, s: Boosting) -> DataFrame:
    """Training rows with scores of zero, one per member and output."""
    return rows.withColumn("scores", F.flatten(F.transform("labels", lambda _: F.array(*[F.lit(0.0)] * s.classes))))


def training_rows(x: DataFrame, columns: list[str], cuts: list[list[float]], label: str, group: list[str], order: str, weight: str | None = None) -> DataFrame:
    """A row per group: ``(key, bins, labels, weight)``, stored; members in ``order``.

    ``bins`` holds a byte per member and feature.  Groups are the clients of a
    view, eight members each; all groups must have the same size.
    """
    names = ["key", "place", "label", "weight"]
    rows = x.select(
        group_key(group).alias("key"), F.col(order).cast("long").alias("place"), F.col(label).cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(columns)],
    )

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _binned(_matrix(b, [f"f{k}" for k in range(len(columns))]), cuts)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([r.tobytes() for r in made], pa.binary())], [*names, "bins"])

    one = rows.mapInArrow(binned, "key long, place long, label double, weight double, bins binary")
    made = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "label", "bins", "weight"))).alias("m"))
    packed = made.select("key", F.col("m.label").alias("labels"), F.col("m.bins").alias("bins"), F.get("m.weight", F.lit(0)).alias("weight"))
    stored = written(packed, "boosting")
    sizes = [r[0] for r in stored.select(F.size("labels")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ContractError("groups of different sizes")
    return stored


# --- gradients; scores and labels are (groups, members), results (groups, members, outputs)


def lambdas(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LambdaRank: logistic pair gradients weighted by the change of the ranking's gain.

    For a better-labelled ``i`` and a worse ``j`` the weight is ``|2^li - 2^lj|
    |1/log2(2 + ri) - 1/log2(2 + rj)|`` over the best possible gain, divided
    by ``0.01 + |si - sj|`` where scores differ; a group's sums are scaled by
    ``log2(1 + s) / s``, ``s`` the sum of its pairs' gradients, twice.
    """
    n = scores.shape[1]
    order = np.argsort(-scores, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n), order.shape), axis=1)
    discount = 1 / np.log2(2.0 + rank)
    gain = np.exp2(labels) - 1
    best = (np.sort(gain, axis=1)[:, ::-1] / np.log2(2.0 + np.arange(n))).sum(axis=1)
    better = labels[:, :, None] > labels[:, None, :]
    apart = scores[:, :, None] - scores[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        weight = np.abs(gain[:, :, None] - gain[:, None, :]) * np.abs(discount[:, :, None] - discount[:, None, :]) / best[:, None, None]
        spread = (scores.max(axis=1) != scores.min(axis=1))[:, None, None]
        weight = np.where(better, np.where(spread, weight / (0.01 + np.abs(apart)), weight), 0.0)
        p = 1 / (1 + np.exp(apart))
    g, h = weight * p, weight * p * (1 - p)
    total = 2 * g.sum(axis=(1, 2))
    scale = np.where(total > 0, np.log2(1 + total) / np.where(total > 0, total, 1), 1.0)[:, None]
    return ((g.sum(axis=1) - g.sum(axis=2)) * scale)[:, :, None], ((h.sum(axis=1) + h.sum(axis=2)) * scale)[:, :, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_pairs(scores: np.ndarray, labels: np.ndarray, keys: np.ndarray, salt: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic gradients of ``pairs`` drawn partners a member, of another label each.

    Draws follow from the group's key, the member, the draw and the round, and
    are averaged over the draws.  Hessians are doubled, as both ends move.
    """
    g, h = np.zeros(scores.shape), np.zeros(scores.shape)
    rows, n = np.arange(len(scores)), scores.shape[1]
    with np.errstate(over="ignore"):
        base = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(n):
        other = labels != labels[:, i : i + 1]
        count = other.sum(axis=1)
        place = np.argsort(~other, axis=1, kind="stable")  # partners first
        for k in range(pairs):
            with np.errstate(over="ignore"):
                draw = _mixed(base + np.uint64(i * pairs + k + 1))
            j = place[rows, (draw % np.maximum(count, 1).astype(np.uint64)).astype(np.int64)]
            sign = np.where(labels[:, i] > labels[rows, j], 1.0, -1.0)
            p = 1 / (1 + np.exp(-sign * (scores[:, i] - scores[rows, j])))
            step = np.where(count > 0, sign * (p - 1), 0.0) / pairs
            curve = np.where(count > 0, 2 * np.maximum(p * (1 - p), 1e-16), 0.0) / pairs
            for at, s in ((i, step), (j, -step)):
                g[rows, at] += s
                h[rows, at] += curve
    return g[:, :, None], h[:, :, None]


def gradients(scores: np.ndarray, labels: np.ndarray, keys: np.ndarray, salt: int, s: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by objective; ``scores`` are (groups, members, outputs)."""
    if s.objective == "lambdarank":
        return lambdas(scores[:, :, 0], labels)
    if s.objective == "pairwise":
        return sampled_pairs(scores[:, :, 0], labels, keys, salt, s.pairs)
    if s.objective == "logistic":
        p = 1 / (1 + np.exp(-scores))
        return p - labels[:, :, None], p * (1 - p)
    top = np.exp(scores - scores.max(axis=2, keepdims=True))
    p = top / top.sum(axis=2, keepdims=True)
    return p - (labels[:, :, None] == np.arange(scores.shape[2])), p * (1 - p)


# --- trees


def nodes_of(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row of ``bins`` ends in."""
    node = np.ones(len(bins), np.int64)
    for k in sorted(splits):
        f, b = splits[k]
        here = node == k
        node[here] = 2 * k + (bins[here, f] > b)
    return node


def add_trees(scores: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """``scores`` (rows, outputs) plus the values of the leaves that rows fall into."""
    for t in trees:
        node = nodes_of(bins, t.splits)
        for leaf, value in t.values.items():
            scores[node == leaf] += value
    return scores


def _unpacked(b: pa.RecordBatch, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, weights, labels, bins, scores) of a batch of groups."""
    n = b.num_rows
    labels = b.column("labels").flatten().to_numpy().reshape(n, -1)
    bins = np.frombuffer(b"".join(b.column("bins").flatten().to_pylist()), np.uint8).reshape(n * labels.shape[1], -1)
    scores = b.column("scores").flatten().to_numpy().reshape(n, labels.shape[1], outputs).copy()
    return b.column("key").to_numpy(), b.column("weight").to_numpy(), labels, bins, scores


def histogram(rows: DataFrame, s: Boosting, features: int, splits: dict[int, tuple[int, int]], wanted: list[int], trees: list[Tree], salt: int) -> DataFrame:
    """``(node, output, feature, bin, g, h, n)`` of the wanted nodes, sums in units of ``1 / UNIT``.

    A task adds up in arrays of nodes x outputs x features x bins, whatever its
    rows; what it sends is bounded by that.
    """
    at = {node: k for k, node in enumerate(wanted)}
    width, kept = s.bins + 1, s.rows
    shape = (len(wanted), s.classes, features, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, int(np.prod(shape))), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys, weights, labels, bins, scores = _unpacked(b, s.classes)
            flat = add_trees(scores.reshape(-1, s.classes), bins, trees)
            g, h = gradients(flat.reshape(scores.shape), labels, keys, salt, s)
            if kept < 1:  # whole groups are drawn
                with np.errstate(over="ignore"):
                    draw = _mixed(keys.astype(np.int64).view(np.uint64) ^ _mixed(np.array([salt + 7919], np.uint64)))
                weights = weights * ((draw >> np.uint64(11)) < kept * (1 << 53))
            g, h = (np.rint(x * weights[:, None, None] * UNIT).astype(np.int64).reshape(len(bins), -1) for x in (g, h))
            counted = np.repeat(weights > 0, labels.shape[1])
            node = nodes_of(bins, splits)
            place = np.array([at.get(int(x), -1) for x in range(int(node.max()) + 1)])[node]
            use = np.flatnonzero((place >= 0) & counted)
            row = place[use] * width
            for f in range(features):
                cell = row + bins[use, f]
                for c in range(s.classes):
                    for k, v in enumerate((g[use, c], h[use, c], None)):
                        sums[k].reshape(shape)[:, c, f] += np.rint(np.bincount(cell, v, len(wanted) * width)).astype(np.int64).reshape(-1, width)
        filled = np.flatnonzero(sums[2])
        node, output, feature, bin_ = np.unravel_index(filled, shape)
        columns = [np.array(wanted, np.int64)[node], output, feature, bin_, *sums[:, filled]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "output", "feature", "bin", "g", "h", "n"])

    parts = rows.mapInArrow(add, "node long, output long, feature long, bin long, g long, h long, n long")
    return parts.groupBy("node", "output", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def split_gains(hist: DataFrame, s: Boosting, allowed: list[int] | None = None, together: bool = False) -> DataFrame:
    """``(node, feature, bin, gain, g, h, n, gl, hl, nl)`` of every split at a filled bin.

    The gain is ``sum of G^2 / (H + l2)`` of both sides less that of the node;
    with ``together`` one split serves all nodes, and gains are added over
    nodes and outputs.  Splits with fewer rows or less curvature on a side
    than the settings ask for are left out.
    """
    if allowed is not None:
        hist = hist.where(F.col("feature").isin(allowed))
    real = lambda c: F.col(c) / UNIT
    key = ["node", "output", "feature"]
    if together:  # every node and output needs a row at each bin that any has
        grid = hist.select("feature", "bin").distinct()
        full = hist.select("node", "output", "feature").distinct().join(grid, "feature")
        hist = full.join(hist, [*key, "bin"], "left").na.fill(0, ["g", "h", "n"])
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    x = hist.select(
        *key, "bin",
        *[F.sum(real(c)).over(w).alias(n) for w, names in ((upto, ("gl", "hl")), (whole, ("g", "h"))) for c, n in zip(("g", "h"), names)],
        F.sum("n").over(upto).alias("nl"), F.sum("n").over(whole).alias("n"),
    )
    part = lambda g, h: g * g / (h + s.l2)
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
    enough = (F.least("nl", F.col("n") - F.col("nl")) >= s.min_rows) & (F.least(hl, h - hl) >= s.min_hessian)
    if together:
        return x.groupBy("feature", "bin").agg(F.sum(gain).alias("gain"), F.sum("nl").alias("nl"), F.sum("n").alias("n")).where("nl > 0 AND nl < n")
    return x.where(enough).withColumn("gain", gain).drop("output")


def best_splits(gains: DataFrame) -> DataFrame:
    """The split of most gain per node; of equal ones the first feature, then the first bin."""
    best = F.max_by(F.struct(*gains.columns), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return gains.groupBy("node").agg(best.alias("s")).select("s.*")


@dataclass
class _Growth:
    """Splits that are known so far, and what best-first growth makes of them."""

    known: dict[int, tuple | None]
    totals: dict[int, tuple[float, float]]

    def grown(self, s: Boosting) -> tuple[dict[int, tuple[int, int]], list[int]]:
        """Splits in the order of their gains, and nodes to look at before going on."""
        splits: dict[int, tuple[int, int]] = {}
        heap, leaves = [(-self.known[1].gain, 1)] if self.known[1] else [], 1
        while heap and leaves < s.leaves:
            _, node = heapq.heappop(heap)
            row = self.known[node]
            splits[node] = (row.feature, row.bin)
            leaves += 1
            children = [c for c in (2 * node, 2 * node + 1) if s.depth is None or c.bit_length() <= s.depth]
            open_ = [c for c in children if c not in self.known]
            if open_ and leaves < s.leaves:
                # all that may be split next are looked at together
                nearby = [c for _, n in sorted(heap)[: s.leaves - leaves] for c in (2 * n, 2 * n + 1) if s.depth is None or c.bit_length() <= s.depth]
                return splits, open_ + [c for c in nearby if c not in self.known]
            for c in children:
                if self.known.get(c):
                    heapq.heappush(heap, (-self.known[c].gain, c))
        return splits, []


def _allowed(s: Boosting, features: int, salt: int) -> list[int]:
    """The features that a tree may use, drawn by the seed and the round."""
    count = max(1, round(features * s.columns))
    return sorted(np.random.default_rng([s.seed, salt]).permutation(features)[:count].tolist())


def _leaf(g: float, h: float, s: Boosting) -> float:
    return -g / (h + s.l2) * s.learning_rate


def grow_tree(rows: DataFrame, s: Boosting, features: int, trees: list[Tree], salt: int) -> tuple[Tree, dict[int, float]]:
    """One tree, best split first, and the gains by feature."""
    found = _Growth({}, {})
    wanted, splits = [1], {}
    allowed = _allowed(s, features, salt)
    while wanted:
        # nodes whose parents are not split yet are looked at too
        above = {n >> 1: found.known[n >> 1] for n in wanted if n > 1}
        reached = dict(splits) | {n: (r.feature, r.bin) for n, r in above.items()}
        hist = histogram(rows, s, features, reached, wanted, trees, salt)
        got = {r["node"]: r for r in best_splits(split_gains(hist, s, allowed)).collect()}
        if 1 in wanted and 1 not in got:  # no split: the root alone
            r = hist.where(f"feature = {allowed[0]}").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
            return Tree({}, {1: [_leaf((r["g"] or 0) / UNIT, (r["h"] or 0) / UNIT, s)]}), {}
        for n in wanted:
            r = got.get(n)
            found.known[n] = r if r is not None and r.gain > 0 else None
            if r is not None:
                found.totals |= {n: (r.g, r.h), 2 * n: (r.gl, r.hl), 2 * n + 1: (r.g - r.gl, r.h - r.hl)}
        splits, wanted = found.grown(s)
    leaves = [c for n in splits for c in (2 * n, 2 * n + 1) if c not in splits] or [1]
    gains: dict[int, float] = {}
    for n, (f, _) in splits.items():
        gains[f] = gains.get(f, 0.0) + found.known[n].gain
    return Tree(splits, {c: [_leaf(*found.totals[c], s)] for c in leaves}), gains


def grow_symmetric(rows: DataFrame, s: Boosting, features: int, trees: list[Tree], salt: int) -> tuple[Tree, dict[int, float]]:
    """One tree with the same split in all nodes of a level, chosen by the sum of gains."""
    splits: dict[int, tuple[int, int]] = {}
    gains: dict[int, float] = {}
    level = [1]
    allowed = _allowed(s, features, salt)
    for _ in range(s.depth or 1):
        hist = histogram(rows, s, features, splits, level, trees, salt)
        best = split_gains(hist, s, allowed, together=True).orderBy(F.desc("gain"), "feature", "bin").first()
        if best is None or best["gain"] <= 0:
            break
        splits |= {n: (best["feature"], best["bin"]) for n in level}
        gains[best["feature"]] = gains.get(best["feature"], 0.0) + best["gain"]
        level = [c for n in level for c in (2 * n, 2 * n + 1)]
    sums = histogram(rows, s, 1, splits, level, trees, salt).groupBy("node", "output").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    values = {n: [0.0] * s.classes for n in level}
    for r in sums.collect():
        values[r["node"]][r["output"]] = _leaf(r["g"] / UNIT, r["h"] / UNIT, s)
    return Tree(splits, values), gains


def fit(
    x: DataFrame, columns: list[str], label: str, group: list[str], order: str, settings: Boosting, weight: str | None = None,
    on_round: Callable[[int, Model], None] | None = None,
) -> Model:
    """A boosted model of rows ``x``; ``group`` names the columns that make a list, ``order`` its order.

    Classes (``softmax``) and ``logistic`` rows are lists of one: give their key
    as the group.  Stored are the columns in use, then their bins and, every
    ``PENDING`` rounds, the scores; a lost executor costs its tasks alone.
    Null labels are refused.
    """
    s = settings
    if s.bins > 255:
        raise ValueError("at most 255 bins")
    x = written(x.select(*dict.fromkeys([*group, order, label, *columns, *([weight] if weight else [])])), "examples")
    if x.where(F.col(label).isNull()).limit(1).count():
        raise ContractError("null labels")
    cuts = fit_cuts(x, columns, s.bins)
    model = Model(s, list(columns), cuts, [], [0.0] * s.classes)
    rows = unscored(training_rows(x, columns, cuts, label, group, order, weight), s)
    grow = grow_symmetric if s.objective == "softmax" else grow_tree
    stored = 0
    for k in range(s.rounds):
        tree, gains = grow(rows, s, len(columns), model.trees[stored:], k)
        model.trees.append(tree)
        for f, gain in gains.items():
            model.gains[columns[f]] = model.gains.get(columns[f], 0.0) + gain
        if len(model.trees) - stored == PENDING:
            rows = written(_advanced(rows, s, model.trees[stored:]), "scores")
            stored = len(model.trees)
        if on_round:
            on_round(k, model)
    return model


def _advanced(rows: DataFrame, s: Boosting, trees: list[Tree]) -> DataFrame:
    """Training rows with the trees added to their scores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                *_, bins, scores = _unpacked(b, s.classes)
                flat = add_trees(scores.reshape(-1, s.classes), bins, trees).reshape(b.num_rows, -1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-1]), made], names)

    names = rows.columns
    return rows.mapInArrow(add, rows.schema)


def predict(model: Model, x: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``x`` and ``scores``, an array with a value per output.

    Columns of the model that ``x`` lacks count as null.
    """
    names = [f"_f{k}" for k in range(len(model.features))]
    rows = x.select(*keep, *[(F.col(c) if c in x.columns else F.lit(None)).cast("double").alias(n) for c, n in zip(model.features, names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.tile(np.array(model.start), (b.num_rows, 1))
            made = add_trees(start, _binned(_matrix(b, names), model.cuts), model.trees)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(made.tolist(), pa.list_(pa.float64()))], [*keep, "scores"])

    schema = T.StructType([*(x.schema[c] for c in keep), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(score, schema)


def symmetric_scores(model: Model) -> Column:
    """The scores of symmetric trees as an expression: a tree's answers are the bits of an index
    into its array of leaves."""
    names = model.features

    def over(f: int, b: int) -> Column:
        """Whether a value's bin is beyond ``b``; nulls never are."""
        if b == 0:
            return F.col(names[f]).isNotNull()
        cuts = model.cuts[f]
        return F.coalesce(F.col(names[f]) > F.lit(cuts[b - 1]), F.lit(False)) if b <= len(cuts) else F.lit(False)

    def leaf(tree: Tree) -> Column:
        depth = max(tree.values).bit_length() - 1
        index = F.lit(0)
        for level in range(depth):
            index = index + over(*tree.splits[1 << level]).cast("int") * (1 << (depth - 1 - level))
        leaves = F.array(*[F.array(*map(F.lit, tree.values[(1 << depth) + k])) for k in range(1 << depth)])
        return F.get(leaves, index)

    outputs = [sum((F.get(leaf(t), F.lit(c)) for t in model.trees), F.lit(model.start[c])) for c in range(model.settings.classes)]
    return F.array(*outputs)


def target_statistics(
    x: DataFrame, category: str, label: str, classes: int, key: list[str], seed: int = 42, prior_weight: float = 1.0, rows: int = 1_000_000
) -> DataFrame:
    """``x`` with ``<category>_ts_<k>``: how often earlier rows of the category had class ``k``.

    Rows are put in a seeded order by the hash of ``key``, whose values must be
    unique; each sees only those before it, so a row's own label never enters.
    ``(count + prior_weight / classes) / (rows + prior_weight)``; null
    categories are one.  Running counts go over ranges of the order, so a
    category may hold any share of the rows.
    """
    counts = {f"_c{k}": (F.col(label) == k).cast("long") for k in range(classes)} | {"_n": F.lit(1).cast("long")}
    made = running(x, [uniform(*key, salt=seed), *key], (category,), counts, rows)
    share = lambda k: (F.col(f"_c{k}") + prior_weight / classes) / (F.col("_n") + prior_weight)
    return made.withColumns({f"{category}_ts_{k}": share(k) for k in range(classes)}).drop(*counts)


def category_table(x: DataFrame, category: str, label: str, classes: int, prior_weight: float = 1.0) -> DataFrame:
    """``(category, <category>_ts_<k>)`` from all rows: the encoding of rows to predict.

    A category that is not in it takes ``1 / classes``.
    """
    n = x.groupBy(category).agg(F.count("*").alias("_n"), *[F.count_if(F.col(label) == k).alias(f"_c{k}") for k in range(classes)])
    share = lambda k: ((F.col(f"_c{k}") + prior_weight / classes) / (F.col("_n") + prior_weight)).alias(f"{category}_ts_{k}")
    return n.select(category, *[share(k) for k in range(classes)])


def encoded(x: DataFrame, table: DataFrame, category: str, classes: int) -> DataFrame:
    names = [f"{category}_ts_{k}" for k in range(classes)]
    known = table.select(F.col(category).alias("_category"), *names)
    return x.join(known, F.col(category).eqNullSafe(F.col("_category")), "left").drop("_category").na.fill(1 / classes, names)
