"""PLS importance and linear support vector machines over distributed features.

Both need of a feature only its row: what joins the features, scores for PLS and the Gram matrix for the machine, lives between
samples, is summed up over the rows in tasks, and goes back with the next pass.  All runs of a resampling share the passes.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamella.operators.blocks import fold_rows

SCORES = "run int, layer string, feature string, score double"
#: Numbers of Gram matrices that one pass may hold.
MOST = 1 << 25


def centred(x: np.ndarray, train: np.ndarray, unit: bool = False) -> np.ndarray:
    """Rows of ``x`` minus the mean of the training samples; gaps become 0; with ``unit`` also divided by their deviation."""
    own = x[:, train]
    seen = ~np.isnan(own)
    n = np.maximum(seen.sum(1), 1)[:, None]
    mean = np.where(seen, own, 0).sum(1)[:, None] / n
    z = np.where(np.isnan(x), 0.0, x - mean)
    if unit:
        sd = np.sqrt((z[:, train] ** 2).sum(1) / max(1, len(train) - 1))[:, None]
        z = np.where(sd > 1e-12, z / np.where(sd > 0, sd, 1), 0.0)
    return z


def pls_importance(vecs: DataFrame, splits: list[tuple[int, np.ndarray]], y: np.ndarray, components: int = 2) -> DataFrame:
    """``run, layer, feature, score``: variable importance in projection, the mean over 1 to ``components`` components.

    A component's weights are the rows' products with what is left of the label, its scores one sum over all rows.
    """
    features = vecs.count()
    left = {run: (y[train] - y[train].mean()).astype(float) for run, train in splits}
    labels: dict = {run: [] for run, _ in splits}
    explained: dict = {run: [] for run, _ in splits}
    basis: dict = {run: [] for run, _ in splits}
    for _ in range(components):
        now = dict(left)

        def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            x = np.vstack(pdf["vec"].to_numpy())
            out = {}
            for run, train in splits:
                z = centred(x, train)[:, train]
                w = z @ now[run]
                out[f"t{run}"], out[f"n{run}"] = w @ z, np.array([w @ w])
            return out

        s = fold_rows(vecs, part) if features else {}
        for run, _ in splits:
            t = s.get(f"t{run}", np.zeros(len(left[run])))
            for b in basis[run]:
                t = t - b * (t @ b)
            size = np.linalg.norm(t)
            if size < 1e-9 * max(1.0, np.sqrt(s[f"n{run}"][0]) if s else 1.0):
                continue  # nothing is left to explain
            t = t / size
            labels[run].append((left[run], float(np.sqrt(s[f"n{run}"][0]))))
            explained[run].append(float(left[run] @ t) ** 2)
            basis[run].append(t)
            left[run] = left[run] - t * (left[run] @ t)

    def score(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = np.vstack(pdf["vec"].to_numpy())
            for run, train in splits:
                z = centred(x, train)[:, train]
                own = np.zeros(len(x))
                if labels[run]:
                    w2 = np.stack([(z @ lab / size) ** 2 for lab, size in labels[run]])
                    ss = np.array(explained[run])
                    own = np.sqrt(features * (w2 * ss[:, None]).cumsum(0) / ss.cumsum()[:, None]).mean(0)
                yield pd.DataFrame({"run": run, "layer": pdf["layer"], "feature": pdf["feature"], "score": own})

    return vecs.mapInPandas(score, SCORES)


def machine(gram: np.ndarray, y: np.ndarray, cost: float = 1.0, tol: float = 1e-9, rounds: int = 100, factor: bool = False) -> tuple[np.ndarray, float, bool]:
    """Dual weights (signed), offset and whether they converged, of a linear machine; ``y`` is 0/1.

    A primal-dual interior-point method: some twenty Newton steps, each one factorisation of the Gram matrix's size.  With ``factor``,
    ``gram`` holds the standardised features as rows instead, and a step solves a system of their number only.
    """
    s = np.where(y > 0.5, 1.0, -1.0)
    n = len(s)
    if abs(s.sum()) == n:
        return np.zeros(n), float(s[0]) if n else 0.0, True
    if factor:
        f = gram * s
        times = lambda v: f.T @ (f @ v)

        def solve(d, b):
            inner = np.eye(len(f)) + (f / d) @ f.T
            once = lambda r: (r - f.T @ np.linalg.solve(inner, f @ (r / d[:, None]))) / d[:, None]
            x = once(b)
            return x + once(b - times(x) - d[:, None] * x)  # refined once, as the two terms of a solution may be far larger than it
    else:
        q = gram * np.outer(s, s)
        times = lambda v: q @ v
        solve = lambda d, b: np.linalg.solve(q + np.diag(d), b)
    # strictly inside, on the plane where the classes' weights are equal
    a = np.where(s > 0, 0.5 * cost * min(1.0, (s < 0).sum() / (s > 0).sum()), 0.5 * cost * min(1.0, (s > 0).sum() / (s < 0).sum()))
    z, t, offset = np.ones(n), np.ones(n), 0.0
    for _ in range(rounds):
        room = cost - a
        rest = times(a) - 1 + offset * s - z + t
        gap = (a @ z + room @ t) / (2 * n)
        if gap < tol * cost and np.abs(rest).max() < 1e3 * tol and abs(s @ a) < 1e3 * tol:
            return a * s, float(offset), True
        mu = 0.1 * gap
        both = solve(z / a + t / room, np.column_stack([-rest + mu / a - z - mu / room + t, s]))
        step = (s @ both[:, 0] + s @ a) / (s @ both[:, 1])
        da = both[:, 0] - both[:, 1] * step
        dz, dt = mu / a - z - z / a * da, mu / room - t + t / room * da
        length = 1.0
        for v, d in ((a, da), (room, -da), (z, dz), (t, dt)):
            if (d < 0).any():
                length = min(length, 0.99 * float((-v[d < 0] / d[d < 0]).min()))
        a, z, t, offset = a + length * da, z + length * dz, t + length * dt, offset + length * step
    return a * s, float(offset), False


def svm_importance(vecs: DataFrame, splits: list[tuple[int, np.ndarray]], y: np.ndarray, cost: float = 1.0) -> DataFrame:
    """``run, layer, feature, score``: squared weights of a linear machine on standardised features."""
    largest = max((len(t) for _, t in splits), default=1)
    if largest ** 2 > MOST:
        raise ValueError("too many training samples for a Gram matrix: cap them in the splits")
    at_once = max(1, MOST // largest ** 2)
    dual: dict = {}
    for lo in range(0, len(splits), at_once):
        some = splits[lo:lo + at_once]

        def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            x = np.vstack(pdf["vec"].to_numpy())
            out = {}
            for run, train in some:
                z = centred(x, train, True)[:, train]
                out[f"k{run}"] = z.T @ z
            return out

        s = fold_rows(vecs, part)
        for run, train in some:
            k = s.get(f"k{run}", np.zeros((len(train), len(train))))
            a, _, ok = machine(k, y[train], cost)
            if not ok:
                raise ValueError(f"the machine of run {run} did not converge")
            dual[run] = a

    def score(it):
        for pdf in it:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy())
                for run, train in splits:
                    yield pd.DataFrame({"run": run, "layer": pdf["layer"], "feature": pdf["feature"], "score": (centred(x, train, True)[:, train] @ dual[run]) ** 2})

    return vecs.mapInPandas(score, SCORES)


def platt(decision: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn decisions into probabilities, with the usual smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([decision, np.ones(len(y))])
    b = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-9 * np.eye(2), x.T @ (target - p))
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])
