"""Anchors-hierarchy metric trees over integer points, and the assignment of their points to entries of a codebook.

A tree is built middle-out: the square root of the points' number of anchors, each the point furthest from the anchors before,
attract the points nearest to them; the anchors' balls are merged pairwise, smallest first, up to the root, and each ball is
divided likewise below.  A ball caches the sum and the number of its points.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24
#: Slack for rounding wherever distances are compared in floating point; what it leaves open is settled in integers.
SLACK = 1e-9


@dataclass
class Tree:
    """Balls as arrays, the root first.  Points ``lo`` to ``hi`` of ``points`` (rows ``row`` of the input) are a ball's own."""
    points: np.ndarray
    row: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray   # -1: a leaf
    right: np.ndarray


def anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """At most ``k`` groups of indexes, each nearer to its anchor than to any other."""
    x = points.astype(np.float64)
    dist = np.sqrt(((x - x[0]) ** 2).sum(1))
    owner, centre = np.zeros(len(x), np.int64), [0]
    for a in range(1, k):
        far = int(np.argmax(dist))
        if dist[far] == 0:
            break
        # a point nearer to its anchor than half the way between the anchors stays
        apart = np.sqrt(((x[centre] - x[far]) ** 2).sum(1))
        open_ = np.flatnonzero(dist >= apart[owner] / 2)
        d = np.sqrt(((x[open_] - x[far]) ** 2).sum(1))
        nearer = d < dist[open_]
        taken = open_[nearer]
        dist[taken], owner[taken] = d[nearer], a
        centre.append(far)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.cumsum(np.bincount(owner, minlength=len(centre)))[:-1])


def build(points: np.ndarray) -> Tree:
    """The tree of ``points`` (n x d integers, n at least 1)."""
    order: list[np.ndarray] = []
    nodes: list[list] = []  # lo, hi, left, right

    def leaf(index: np.ndarray, at: int) -> int:
        order.append(index)
        nodes.append([at, at + len(index), -1, -1])
        return len(nodes) - 1

    def grow(index: np.ndarray, at: int) -> int:
        own = points[index]
        groups = anchors(own, int(np.ceil(np.sqrt(len(index))))) if len(index) > LEAF else []
        if len(groups) < 2:
            return leaf(index, at)
        pivot = np.stack([own[g].mean(0) for g in groups])
        radius = np.array([np.sqrt(((own[g] - p) ** 2).sum(1).max()) for g, p in zip(groups, pivot)])
        count = np.array([len(g) for g in groups], np.float64)
        return lay(merged(pivot, radius, count), [index[g] for g in groups], at)

    def lay(shape, groups: list[np.ndarray], at: int) -> int:
        """Balls of ``shape``, pairs of pairs of group numbers, in the order of their points."""
        if isinstance(shape, int):
            return grow(groups[shape], at)
        left = lay(shape[0], groups, at)
        right = lay(shape[1], groups, nodes[left][1])
        nodes.append([at, nodes[right][1], left, right])
        return len(nodes) - 1

    root = grow(np.arange(len(points)), 0)
    row = np.concatenate(order)
    at = np.array(nodes, np.int64)
    # the root first
    at[[0, root]] = at[[root, 0]]
    swap = np.arange(len(at))
    swap[[0, root]] = [root, 0]
    at[:, 2:] = np.where(at[:, 2:] < 0, -1, swap[at[:, 2:]])
    own = points[row]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(own, 0, dtype=np.int64)])
    total = sums[at[:, 1]] - sums[at[:, 0]]
    pivot = total / (at[:, 1] - at[:, 0])[:, None]
    radius = np.array([np.sqrt(((own[a:b] - p) ** 2).sum(1).max()) for (a, b), p in zip(at[:, :2].tolist(), pivot)]) * (1 + SLACK) + SLACK
    return Tree(own, row, pivot, radius, total, *at.T)


def merged(pivot: np.ndarray, radius: np.ndarray, count: np.ndarray):
    """Two groups or more merged pairwise, the pair of smallest common ball first, as nested pairs."""
    shape: list = list(range(len(pivot)))
    pivot, radius, count = pivot.copy(), radius.copy(), count.copy()

    def cost(i) -> np.ndarray:
        """Radius of the ball around the joint mean of ``i`` and each other."""
        gap = np.sqrt(((pivot - pivot[i]) ** 2).sum(-1))
        both = count + count[i]
        return np.maximum(radius[i] + gap * count / both, radius + gap * count[i] / both)

    with np.errstate(invalid="ignore"):
        costs = np.stack([cost(i) for i in range(len(pivot))])
        np.fill_diagonal(costs, np.inf)
        for _ in range(len(pivot) - 1):
            i, j = sorted(divmod(int(np.argmin(costs)), len(pivot)))
            shape[i] = (shape[i], shape[j])
            radius[i] = costs[i, j]
            pivot[i] = (pivot[i] * count[i] + pivot[j] * count[j]) / (count[i] + count[j])
            count[i] += count[j]
            costs[j] = costs[:, j] = np.inf
            row = np.where(np.isinf(costs[i]), np.inf, cost(i))
            costs[i] = costs[:, i] = row
    return shape[i]


def assign(tree: Tree, entries: np.ndarray):
    """Balls wholly owned by one entry, and points of other leaves: ``(balls, their entries, points, their entries)``.

    Every ball inherits the entries its parent left open and drops those that no place in the ball is nearest to; a ball with
    one left is owned, with all its points, and is not opened.
    """
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(-1).astype(np.float64))
    # of equal entries the lower one owns everything
    alone = (np.tril(apart == 0, -1).sum(1) == 0)
    ball, open_ = np.zeros(1, np.int64), alone[None].copy()
    owned, owner, leaves, left_open = [], [], [], []
    while len(ball):
        square = ((tree.pivot[ball][:, None] - entries[None]) ** 2).sum(-1)
        square[~open_] = np.inf
        best = square.argmin(1)
        least = square[np.arange(len(ball)), best][:, None]
        # over a ball the difference of two squared distances varies by twice radius times the way between the entries
        reach = 2 * tree.radius[ball][:, None] * apart[best]
        with np.errstate(invalid="ignore"):
            open_ &= square - least <= reach + SLACK * (1 + square + reach)
        whole = open_.sum(1) == 1
        owned.append(ball[whole])
        owner.append(best[whole])
        ball, open_ = ball[~whole], open_[~whole]
        leaf = tree.left[ball] < 0
        leaves.append(ball[leaf])
        left_open.append(open_[leaf])
        ball, open_ = ball[~leaf], open_[~leaf]
        ball, open_ = np.concatenate([tree.left[ball], tree.right[ball]]), np.concatenate([open_, open_])
    leaf = np.concatenate(leaves)
    size = tree.hi[leaf] - tree.lo[leaf]
    point = np.repeat(tree.lo[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())
    maybe = np.repeat(np.concatenate(left_open), size, 0)
    square = ((tree.points[point][:, None] - entries[None]) ** 2).sum(-1)
    square[~maybe] = np.iinfo(np.int64).max
    return np.concatenate(owned), np.concatenate(owner), point, square.argmin(1)
