"""Logistic regression by Newton steps on sums over distributed samples: plain, and as an elastic-net path with cross-validation.

All fits of a report, the whole table and each of its folds left out, at every penalty of a path, advance together: a pass over
the samples adds up each fit's gradient and Gram matrix, the step is solved from these sums.  A pass costs one job whatever the
number of fits; sums hold (fits x penalties) matrices of the size of the features, so the features must be few.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Numbers that one pass may add up in a task.
MOST = 1 << 25
#: Samples of a matrix in memory that are added up at once.
ROWS = 1 << 14


@dataclass
class Fits:
    """``beta`` (fits, penalties, 1 + features), intercept first, on the scale of the data; fit 0 has left no fold out."""
    beta: np.ndarray
    gram: np.ndarray
    converged: np.ndarray
    lambdas: np.ndarray
    rounds: int


def batch_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, beta: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient and Gram matrix of every fit from some samples; fit k > 0 leaves fold k - 1 out."""
    a = np.column_stack([np.ones(len(x)), x])
    fits, pens, p = beta.shape
    grad, gram = np.zeros(beta.shape), np.zeros((fits, pens, p, p))
    for k in range(fits):
        use = fold != k - 1
        own, lab = a[use], y[use]
        prob = 1 / (1 + np.exp(-np.clip(own @ beta[k].T, -30, 30)))
        grad[k] = (lab[:, None] - prob).T @ own
        w = np.maximum(prob * (1 - prob), 1e-9)
        for j in range(pens):
            gram[k, j] = own.T @ (own * w[:, j:j + 1])
    return {"grad": grad, "gram": gram}


def batch_moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray, fits: int) -> dict[str, np.ndarray]:
    """Number, sums and products of features and label, for every fit."""
    a = np.column_stack([np.ones(len(x)), x, y])
    return {"m": np.stack([a[fold != k - 1].T @ a[fold != k - 1] for k in range(fits)])}


def batch_errors(x: np.ndarray, y: np.ndarray, fold: np.ndarray, beta: np.ndarray) -> dict[str, np.ndarray]:
    """For each fold and penalty how many of the fold's samples its own fit puts into the wrong class, and their number."""
    a = np.column_stack([np.ones(len(x)), x])
    wrong, n = np.zeros((len(beta) - 1, beta.shape[1])), np.zeros(len(beta) - 1)
    for k in range(1, len(beta)):
        own = fold == k - 1
        n[k - 1] = own.sum()
        wrong[k - 1] = ((a[own] @ beta[k].T > 0) != (y[own][:, None] > 0.5)).sum(0)
    return {"wrong": wrong, "n": n}


Sums = Callable[..., dict[str, np.ndarray]]


def over_frame(d: DataFrame) -> Sums:
    """Adds up a batch function over ``d`` (``x array<double>, label 0/1, fold``): in each task first, then in a few groups."""
    def total(fn, *args):
        def part(it):
            held: dict = {}
            for pdf in it:
                if len(pdf):
                    for name, v in fn(np.vstack(pdf["x"].to_numpy()), pdf["label"].to_numpy(float), pdf["fold"].to_numpy(), *args).items():
                        held[name] = held[name] + v if name in held else v
            if held:
                yield pd.DataFrame({"name": list(held), "data": [v.ravel() for v in held.values()], "shape": [list(v.shape) for v in held.values()]})

        def add(key, pdf):
            return pd.DataFrame({"name": [key[0]], "data": [np.sum(pdf["data"].to_list(), axis=0)], "shape": [pdf["shape"].iloc[0]]})

        rows = (d.select("x", "label", "fold").mapInPandas(part, "name string, data array<double>, shape array<int>")
                .groupBy("name", F.pmod(F.spark_partition_id(), F.lit(16)).alias("g")).applyInPandas(lambda key, pdf: add(key, pdf), "name string, data array<double>, shape array<int>"))
        out: dict = {}
        for r in rows.collect():
            v = np.array(r["data"]).reshape(r["shape"])
            out[r["name"]] = out[r["name"]] + v if r["name"] in out else v
        return out
    return total


def over_arrays(x: np.ndarray, y: np.ndarray, fold: np.ndarray, rows: int = ROWS) -> Sums:
    """Adds up a batch function over parts of ``rows`` samples, as it makes a number for each sample and penalty."""
    def total(fn, *args):
        out = fn(x[:rows], y[:rows], fold[:rows], *args)
        for a in range(rows, len(x), rows):
            for name, v in fn(x[a:a + rows], y[a:a + rows], fold[a:a + rows], *args).items():
                out[name] = out[name] + v
        return out
    return total


def path(sums: Sums, folds: int, alpha: float = 0.5, penalties: int = 100, least: float | None = None, rounds: int = 100, tol: float = 1e-6,
         lambdas: np.ndarray | None = None, sweeps: int = 60) -> Fits:
    """Fits at every penalty; ``lambdas`` [0] gives plain maximum likelihood.

    The path goes from the least penalty without any feature in the model down to ``least`` times it (default 0.0001, or 0.01 where
    there are fewer than ten samples for each feature, as a weaker penalty would let separable classes diverge).  Features are put on unit
    variance within each fit for the penalty only.  ``converged`` tells which fits moved less than ``tol`` in their last step.
    """
    m = sums(batch_moments, folds + 1)["m"]
    p = m.shape[1] - 2
    n = np.maximum(m[:, 0, 0], 1)  # a fit may have no sample
    mean = m[:, 0, 1:-1] / n[:, None]
    sd = np.sqrt(np.maximum(np.einsum("kii->ki", m)[:, 1:-1] / n[:, None] - mean ** 2, 0))
    still = sd < 1e-12  # a constant feature stays out
    sd = np.where(still, 1.0, sd)
    share = m[:, 0, -1] / n
    if lambdas is None:
        top = np.abs((m[0, 1:-1, -1] - mean[0] * m[0, 0, -1]) / sd[0] / n[0] * ~still[0]).max(initial=0.0) / max(alpha, 1e-3)
        least = least or (1e-4 if n[0] >= 10 * p else 1e-2)
        lambdas = top * least ** (np.arange(penalties) / max(1, penalties - 1)) if top else np.zeros(1)
    if (folds + 1) * len(lambdas) * (p + 1) ** 2 > MOST:
        raise ValueError("too many features for sums over all fits and penalties: select features first")
    # from standardised to given coefficients, and of sums the other way
    scale = np.zeros((folds + 1, p + 1, p + 1))
    scale[:, 0, 0] = 1
    scale[:, 0, 1:] = -mean / sd
    scale[:, np.arange(1, p + 1), np.arange(1, p + 1)] = ~still / sd
    b = np.zeros((folds + 1, len(lambdas), p + 1))
    b[:, :, 0] = np.log(np.clip(share, 1e-9, 1 - 1e-9) / np.clip(1 - share, 1e-9, 1))[:, None]
    l1, l2 = n[:, None] * lambdas * alpha, n[:, None] * lambdas * (1 - alpha)
    done = np.zeros(b.shape[:2], bool)
    for k in range(rounds):
        s = sums(batch_sums, np.einsum("kij,kqj->kqi", scale, b))
        grad = np.einsum("kij,kqi->kqj", scale, s["grad"])
        gram = scale.transpose(0, 2, 1)[:, None] @ s["gram"] @ scale[:, None]
        go = ~done
        new = b.copy()
        # a step may be too long far from the optimum
        new[go] += np.clip(_descent(b[go], grad[go], gram[go], l1[go], l2[go], sweeps) - b[go], -10, 10)
        done |= np.abs(new - b).max(-1) < tol * (1 + np.abs(b).max(-1))
        b = new
        if done.all():
            break
    return Fits(np.einsum("kij,kqj->kqi", scale, b), s["gram"], done, lambdas, k + 1)


def _descent(b: np.ndarray, grad: np.ndarray, gram: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int, tol: float = 1e-9) -> np.ndarray:
    """Towards the minimum of the penalised quadratic around ``b``, by coordinate descent on all fits (first axis) at once; the
    intercept is free. What ``sweeps`` leave to do the next pass does."""
    if not l1.any() and not l2.any():
        held = gram + 1e-12 * np.eye(gram.shape[-1]) * (1 + np.einsum("kii->k", gram)[:, None, None])
        return b + np.linalg.solve(held, grad[..., None])[..., 0]
    # coordinates first, so that each is one run of memory
    x, left, gram = b.T.copy(), grad.T.copy(), np.ascontiguousarray(gram.transpose(1, 2, 0))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            c = gram[j, j]
            target = c * x[j] + left[j]
            if j == 0:
                new = target / np.maximum(c, 1e-12)
            else:
                new = np.sign(target) * np.maximum(np.abs(target) - l1, 0) / np.maximum(c + l2, 1e-12)
            step = new - x[j]
            most = float(np.abs(step).max(initial=0.0))
            if most:
                x[j] = new
                left -= gram[j] * step
                moved = max(moved, most)
        if moved < tol:
            break
    return x.T


def chosen(fits: Fits, errors: dict[str, np.ndarray]) -> int:
    """The penalty of least mean error over folds that hold samples, the largest of equals."""
    held = errors["n"] > 0
    rate = errors["wrong"][held] / errors["n"][held][:, None]
    mean = (rate * (errors["n"][held] / errors["n"].sum())[:, None]).sum(0) if held.any() else np.zeros(len(fits.lambdas))
    return int(np.argmin(np.round(mean, 12)))


def elastic_net(sums: Sums, folds: int = 5, alpha: float = 0.5, penalties: int = 100, sweeps: int = 60) -> tuple[np.ndarray, float, Fits]:
    """Coefficients (intercept first) at the penalty that cross-validation chooses, that penalty, and all fits."""
    fits = path(sums, folds, alpha, penalties, sweeps=sweeps)
    k = chosen(fits, sums(batch_errors, fits.beta))
    return fits.beta[0, k], float(fits.lambdas[k]), fits


def folded(d: DataFrame, folds: int, seed: int = 1, key: str = "sample") -> DataFrame:
    """``d`` with ``fold``, by a hash of ``key``."""
    return d.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))


def probability(x, beta: list[float]):
    """The fitted probability as a column expression over ``x array<double>``."""
    eta = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in beta[1:]]), lambda a, c: a * c), F.lit(float(beta[0])), lambda a, v: a + v)
    return 1 / (1 + F.exp(-eta))
