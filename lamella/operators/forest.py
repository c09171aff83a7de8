"""Random forests over distributed features.

Trees of all runs grow level by level.  What belongs to samples (bootstrap weights, the node each sample has reached in each
tree) is broadcast; features stay where they are.  A task makes histograms of its features for the nodes that drew them and
keeps its best split of each node; the best of all tasks are merged, and a split travels as one bit for each sample.  A level is
one job whatever the number of trees, runs and features.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamella.core import checkpointed

U = np.uint64
SPLIT = "run int, tree int, node long, gain double, layer string, feature string, cut double, bits binary"
#: Different values of a feature that are tried as cuts; more are grouped into quantile bins.
BINS = 256
#: Runs x trees x samples that the state may hold.
MOST = 1 << 28
#: Trees times samples, and times samples once more, that ``small_forest`` grows at once.
TREE_SAMPLES, TREE_BITS = 1 << 19, 1 << 29


def mixed(*parts) -> np.ndarray:
    """64-bit hash of whole numbers, elementwise."""
    with np.errstate(over="ignore"):
        h = U(0x9E3779B97F4A7C15)
        for p in parts:
            h = (h ^ np.asarray(p).astype(U)) * U(0xBF58476D1CE4E5B9)
            h = h ^ h >> U(29)
            h = h * U(0x94D049BB133111EB)
            h = h ^ h >> U(32)
        return h


def feature_number(layer: str, feature: str) -> int:
    return int.from_bytes(hashlib.md5(f"{layer}\x01{feature}".encode()).digest()[:8], "little")


def bootstrap(seed: int, run: int, tree: int, train: np.ndarray, n: int) -> np.ndarray:
    """How often each sample is drawn, with replacement from ``train``."""
    rng = np.random.default_rng([seed, run, tree])
    return np.bincount(train[rng.integers(0, len(train), len(train))], minlength=n).astype(np.int32)


@dataclass
class Run:
    """One split: ``train`` indexes samples, ``y`` is 0/1 for all; arrays are trees x samples."""
    run: int
    train: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    node: np.ndarray
    next_node: np.ndarray  # by tree
    vote: dict = field(default_factory=dict)     # (tree, node) of a leaf -> class
    retry: dict = field(default_factory=dict)    # (tree, node) that found no split among the drawn features
    ask: tuple | None = None


def start(run: int, train: np.ndarray, y: np.ndarray, trees: int, seed: int, first: int = 0) -> Run:
    w = np.stack([bootstrap(seed, run, first + t, train, len(y)) for t in range(trees)])
    return Run(run, train, y.astype(np.int32), w, np.zeros(w.shape, np.int64), np.ones(trees, np.int64))


def ask(r: Run) -> tuple | None:
    """Nodes that want a split: ``(tree, node, all features?, entries: node number, sample, weight)``. Others become leaves."""
    trees, n = r.weight.shape
    tree = np.repeat(np.arange(trees), n)
    key = tree * (1 << 32) + r.node.ravel()
    live = (r.node.ravel() >= 0) & (r.weight.ravel() > 0)
    names, at = np.unique(key[live], return_inverse=True)
    sample, w = np.tile(np.arange(n), trees)[live], r.weight.ravel()[live]
    total = np.bincount(at, w, len(names))
    ones = np.bincount(at, w * r.y[sample], len(names))
    pure = (ones == 0) | (ones == total)
    node_tree, node = names >> 32, names & 0xFFFFFFFF
    tried = np.array([r.retry.get((int(t), int(k)), 0) for t, k in zip(node_tree, node)], np.int64)
    leaf = pure | (tried > 1)
    for t, k, v in zip(node_tree[leaf].tolist(), node[leaf].tolist(), (2 * ones >= total)[leaf].tolist()):
        r.vote[t, k] = int(v)
    done = np.isin(key, names[leaf]).reshape(r.node.shape)
    r.node[done & (r.node >= 0)] = -1 - r.node[done & (r.node >= 0)]  # kept as a mark of the leaf
    if leaf.all():
        r.ask = None
        return None
    number = np.cumsum(~leaf) - 1
    use = ~leaf[at]
    r.ask = (r.run, node_tree[~leaf], node[~leaf], tried[~leaf] > 0, number[at[use]], sample[use], w[use].astype(float))
    return r.ask


def cuts(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(values without gaps, bin of each sample, upper cut of each bin)``; a gap takes the mean of the training samples."""
    own = x[train]
    if np.isnan(own).all():
        return np.zeros_like(x), np.zeros(len(x), np.int64), np.empty(0)
    x = np.where(np.isnan(x), np.nanmean(own), x)
    values = np.unique(x[train])
    edge = (values[1:] + values[:-1]) / 2
    if len(edge) >= BINS:
        edge = np.unique(edge[np.linspace(0, len(edge) - 1, BINS - 1).astype(int)])
    return x, np.searchsorted(edge, x, side="left"), edge


def best_splits(rows, wanted: list[tuple], ys: dict, trains: dict, seed: int, mtry: int, features: int, first: int = 0, known: dict | None = None) -> list[tuple]:
    """The best split, among ``rows`` (layer, feature, values), of every wanted node that drew one of them: rows of ``SPLIT``.

    A feature takes part in a node with chance ``mtry / features``, drawn by hash; ties go to the first layer, feature and cut.
    ``first``: the number of the first tree, for the draws; ``known`` keeps the cuts of a feature from one call to the next.
    """
    held: dict[tuple, tuple] = {}
    for layer, feature, values in rows:
        name = feature_number(layer, feature)
        for run, tree, node, every, at, sample, w in wanted:
            drawn = every | (mixed(seed, run, tree + first, node, name) < U(int(min(1.0, mtry / features) * (2 ** 64 - 1))))
            if not drawn.any():
                continue
            at_hand = None if known is None else known.get((layer, feature, run))
            x, code, edge = at_hand or cuts(np.asarray(values, float), trains[run])
            if known is not None:
                known[layer, feature, run] = x, code, edge
            if not len(edge):
                continue
            which = np.flatnonzero(drawn)
            rank = np.cumsum(drawn) - 1
            use = drawn[at]
            cell = rank[at[use]] * (len(edge) + 1) + code[sample[use]]
            shape = (len(which), len(edge) + 1)
            n = np.bincount(cell, w[use], shape[0] * shape[1]).reshape(shape).cumsum(1)
            k = np.bincount(cell, w[use] * ys[run][sample[use]], shape[0] * shape[1]).reshape(shape).cumsum(1)
            all_n, all_k = n[:, -1:], k[:, -1:]
            nl, kl = n[:, :-1], k[:, :-1]
            nr, kr = all_n - nl, all_k - kl
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = (kl ** 2 + (nl - kl) ** 2) / nl + (kr ** 2 + (nr - kr) ** 2) / nr - (all_k ** 2 + (all_n - all_k) ** 2) / all_n
            gain = np.round(np.where((nl > 0) & (nr > 0), gain, -1.0), 9)
            cut = gain.argmax(1)
            got = gain[np.arange(len(which)), cut]
            for i in np.flatnonzero(got > 0).tolist():
                q = (run, int(tree[which[i]]), int(node[which[i]]))
                new = (-got[i], layer, feature)
                if q not in held or new < held[q][0]:
                    held[q] = (new, edge[cut[i]], np.packbits(x <= edge[cut[i]]).tobytes())
    return [(*q, -g, layer, feature, float(c), bits) for q, ((g, layer, feature), c, bits) in held.items()]


def goes_left(bits: bytes, samples: np.ndarray) -> np.ndarray:
    """The bits of some samples."""
    return (np.frombuffer(bits, np.uint8)[samples >> 3] >> (7 - (samples & 7)).astype(np.uint8) & 1).astype(bool)


def apply(r: Run, splits: pd.DataFrame) -> pd.DataFrame:
    """Sends samples on; ``splits`` with the numbers of the new nodes. Wanted nodes without a split are tried once more with every feature."""
    _, tree, node, _, _, _, _ = r.ask
    own = splits[splits["run"] == r.run].sort_values(["tree", "node"])
    got = set(zip(own["tree"].tolist(), own["node"].tolist()))
    for t, k in zip(tree.tolist(), node.tolist()):
        if (t, k) not in got:
            r.retry[t, k] = r.retry.get((t, k), 0) + 1
    left = []
    for t, these in own.groupby("tree", sort=True):
        by_node = np.argsort(r.node[t], kind="stable")
        names = r.node[t][by_node]
        nodes = these["node"].to_numpy()
        for bits, lo, hi in zip(these["bits"], np.searchsorted(names, nodes, "left"), np.searchsorted(names, nodes, "right")):
            here = by_node[lo:hi]
            first = int(r.next_node[t])
            r.next_node[t] += 2
            r.node[t, here] = np.where(goes_left(bits, here), first, first + 1)
            left.append(first)
    return own.assign(left=left)


def grown(runs: list[Run], find) -> pd.DataFrame:
    """Grows all trees to pure leaves; ``find`` maps what is wanted to a frame of splits. All splits, with ``left`` (right: + 1)."""
    out = []
    while True:
        wanted = [x for x in map(ask, runs) if x is not None]
        if not wanted:
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split()[0] for c in SPLIT.split(", ")] + ["left"])
        splits = find(wanted)
        out += [apply(r, splits) for r in runs if r.ask is not None]


def votes(r: Run) -> np.ndarray:
    """Share of trees that vote for class 1, for every sample."""
    total = np.zeros(r.node.shape[1])
    for t, leaf in enumerate(-1 - r.node):
        names, at = np.unique(leaf, return_inverse=True)
        total += np.array([r.vote[t, k] for k in names.tolist()], float)[at]
    return total / len(r.node)


def decreases(run: int, tree: int, splits: list[tuple], leaves: dict, weight: np.ndarray, train: np.ndarray, y: np.ndarray, seed: int) -> list[tuple]:
    """``(layer, feature, decrease)``: how much less of one tree's out-of-bag samples is right when a feature is shuffled among them.

    ``splits``: ``(node, layer, feature, bits, left)``.
    """
    bag = train[weight[train] == 0]
    if not len(bag) or not splits:
        return []
    at = {node: (layer, feature, bits, left) for node, layer, feature, bits, left in splits}

    def right(shuffled: tuple | None, order: np.ndarray) -> int:
        hits, todo = 0, [(0, np.arange(len(bag)))]
        while todo:
            k, here = todo.pop()
            if not len(here):
                continue
            if k in at:
                layer, feature, bits, left = at[k]
                goes = goes_left(bits, order[here] if (layer, feature) == shuffled else bag[here])
                todo += [(left, here[goes]), (left + 1, here[~goes])]
            else:
                hits += int((y[bag[here]] == leaves[k]).sum())
        return hits

    before = right(None, bag)
    out = []
    for name in sorted({v[:2] for v in at.values()}):
        order = bag[np.argsort(mixed(seed, run, tree, feature_number(*name), bag), kind="stable")]
        out.append((*name, (before - right(name, order)) / len(bag)))
    return out


def forest(vecs: DataFrame, splits: list[tuple[int, np.ndarray]], y: np.ndarray, trees: int = 500, mtry: int | None = None, seed: int = 1) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Forests of all runs: the votes of every sample by run, and ``run, layer, feature, score``.

    ``vecs``: ``layer, feature, vec`` over the samples of ``y`` (0/1); ``splits``: run and training samples.  The score is the mean
    decrease in accuracy over its standard error; features in no tree have 0.  ``mtry``: features tried in a node, about
    (default the root of their number).  The state of samples and trees must fit the driver and each task: ``MOST``.
    """
    if len(splits) * trees * len(y) > MOST:
        raise ValueError("runs x trees x samples too large: use fewer, or cap the training samples")
    spark = vecs.sparkSession
    vecs = checkpointed(vecs.select("layer", "feature", "vec"))
    features = vecs.count()
    mtry = mtry or max(1, int(np.sqrt(features)))
    runs = [start(k, train, y, trees, seed) for k, train in splits]
    ys, trains = {r.run: r.y for r in runs}, {r.run: r.train for r in runs}

    def find(wanted):
        held = spark.sparkContext.broadcast(wanted)

        def part(it):
            rows = (row for pdf in it for row in pdf[["layer", "feature", "vec"]].itertuples(index=False, name=None))
            yield pd.DataFrame(best_splits(rows, held.value, ys, trains, seed, mtry, features), columns=[c.split()[0] for c in SPLIT.split(", ")])

        best = vecs.mapInPandas(part, SPLIT).groupBy("run", "tree", "node").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "layer", "feature", "cut", "bits")).alias("b"))
        out = best.select("run", "tree", "node", (-F.col("b.g")).alias("gain"), "b.layer", "b.feature", "b.cut", "b.bits").toPandas()  # a row for each node
        held.unpersist()
        return out

    nodes = grown(runs, find)
    state = {r.run: (r.weight, r.train, {}) for r in runs}
    for r in runs:
        for (t, k), v in r.vote.items():
            state[r.run][2].setdefault(t, {})[k] = v
    shared = spark.sparkContext.broadcast(state)
    schema = "run int, layer string, feature string, d double"

    def task(key, pdf):
        run, tree = key
        weight, train, leaves = shared.value[run]
        own = list(pdf[["node", "layer", "feature", "bits", "left"]].itertuples(index=False, name=None))
        rows = decreases(run, tree, own, leaves.get(tree, {}), weight[tree], train, ys[run], seed)
        return pd.DataFrame([(run, *x) for x in rows], columns=["run", "layer", "feature", "d"])

    if len(nodes):
        one = spark.createDataFrame(nodes[["run", "tree", "node", "layer", "feature", "bits", "left"]], "run int, tree int, node long, layer string, feature string, bits binary, left long")
        falls = one.groupBy("run", "tree").applyInPandas(task, schema)
    else:
        falls = spark.createDataFrame([], schema)
    s = falls.groupBy("run", "layer", "feature").agg((F.sum("d") / trees).alias("m"), (F.sum(F.col("d") ** 2) / trees).alias("q"))
    se = F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)) / trees)
    s = s.select("run", "layer", "feature", F.when(se < 1e-15, F.col("m")).otherwise(F.col("m") / se).alias("score"))
    every = vecs.select(F.explode(F.array(*[F.lit(k) for k, _ in splits])).alias("run"), "layer", "feature")
    return {r.run: votes(r) for r in runs}, every.join(s, ["run", "layer", "feature"], "left").fillna(0.0, ["score"])


def small_forest(x: np.ndarray, y: np.ndarray, xt: np.ndarray, trees: int = 300, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The same on one small matrix: probability of class 1 for ``xt``, and each column's mean decrease in accuracy.

    Trees grow a few at a time if there are many samples, which changes no tree: their state and the bits of their splits bound a task's memory.
    """
    both, train = np.vstack([x, xt]), np.arange(len(x))
    label, n = np.r_[y, np.zeros(len(xt))], len(x) + len(xt)
    rows = [("", str(j), both[:, j]) for j in range(both.shape[1])]
    mtry = max(1, int(np.sqrt(both.shape[1])))
    fall, vote, known = np.zeros(both.shape[1]), np.zeros(len(xt)), {}
    part = max(1, min(trees, TREE_SAMPLES // n, TREE_BITS // n ** 2))
    for first in range(0, trees, part):
        own = min(part, trees - first)
        r = start(0, train, label, own, seed, first)
        nodes = grown([r], lambda wanted: pd.DataFrame(best_splits(rows, wanted, {0: r.y}, {0: train}, seed, mtry, both.shape[1], first, known),
                                                       columns=[c.split()[0] for c in SPLIT.split(", ")]))
        leaves: dict[int, dict] = {}
        for (t, k), v in r.vote.items():
            leaves.setdefault(t, {})[k] = v
        for t, tree in nodes.groupby("tree"):
            splits = list(tree[["node", "layer", "feature", "bits", "left"]].itertuples(index=False, name=None))
            for _, name, d in decreases(0, first + int(t), splits, leaves.get(t, {}), r.weight[t], train, r.y, seed):
                fall[int(name)] += d / trees
        vote += np.round(votes(r)[len(x):] * own)
    return vote / trees, fall
