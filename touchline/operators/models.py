"""Fitted models: numerical optimisers in numpy over sufficient statistics that Spark has aggregated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def poisson_irls(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, steps: int = 60, offset: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a weighted Poisson regression with log link by iteratively reweighted least squares with a ridge."""
    beta = np.zeros(x.shape[1])
    offset = np.zeros(len(y)) if offset is None else offset
    for _ in range(steps):
        eta = np.clip(x @ beta + offset, -30, 30)
        mu = np.exp(eta)
        w = weight * mu
        grad = x.T @ (weight * (y - mu)) - ridge * beta
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(len(beta)), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def mixture_weights(likelihoods: np.ndarray, counts: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights on the simplex that maximise the log score of a mixture, by expectation maximisation; rows of likelihoods are observations."""
    w = np.full(likelihoods.shape[1], 1 / likelihoods.shape[1])
    for _ in range(steps):
        share = likelihoods * w
        share /= share.sum(1, keepdims=True)
        new = (share * counts[:, None]).sum(0) / counts.sum()
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def platt(logits: np.ndarray, hits: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic recalibration by Newton's method on binned counts."""
    b = np.array([0.0, 1.0])
    x = np.c_[np.ones(len(logits)), logits]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (hits - counts * p)
        hess = x.T @ (x * (counts * p * (1 - p))[:, None]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return float(b[0]), float(b[1])


#: The parameters of ``vector_scaling``; the last class has no intercept.
SCALING = ("intercept_home", "intercept_draw", "scale_home", "scale_draw", "scale_away")


def vector_scaling(log_p: np.ndarray, counts: np.ndarray, strength: float = 0.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (see SCALING) and their standard errors of a softmax over intercept + scale * log probability, by Newton's method on counts per row and class.

    ``strength`` penalises the squares of the intercepts and of the scales less 1, so that without data the probabilities stay as they are.
    """
    base = np.array([0.0, 0.0, 1.0, 1.0, 1.0])
    x, n = base.copy(), counts.sum(1)
    # row x class x parameter: what a parameter adds to a class
    d = np.zeros((*log_p.shape, 5))
    d[:, 0, 0] = d[:, 1, 1] = 1
    for k in range(3):
        d[:, k, 2 + k] = log_p[:, k]

    def slopes(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = d @ x
        z -= z.max(1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = -float((counts * np.log(np.maximum(q, 1e-300))).sum()) + strength / 2 * float((x - base) @ (x - base))
        gradient = np.einsum("rk,rkp->p", n[:, None] * q - counts, d) + strength * (x - base)
        mean = np.einsum("rk,rkp->rp", q, d)
        hessian = np.einsum("r,rk,rkp,rkq->pq", n, q, d, d) - np.einsum("r,rp,rq->pq", n, mean, mean) + strength * np.eye(5)
        return loss, gradient, hessian

    for _ in range(steps):
        loss, gradient, hessian = slopes(x)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(5), gradient)
        rate = 1.0
        while rate > 1e-6 and slopes(x - rate * step)[0] > loss:
            rate /= 2
        x = x - rate * step
        if np.abs(rate * step).max() < 1e-10:
            break
    return x, np.sqrt(np.diag(np.linalg.inv(slopes(x)[2] + 1e-12 * np.eye(5))))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit_poisson(df: DataFrame, group: str, response: str, features: list[str], ridge: float = 1e-6) -> DataFrame:
    """group, term, coefficient: a Poisson regression with intercept per group, fitted on the distinct rows of its features.

    Spark first sums responses and counts per distinct combination of feature values, which are sufficient for the fit.
    """
    kind = dict(df.dtypes)[group]
    cells = df.groupBy(group, *features).agg(F.count("*").alias("n"), F.sum(response).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.c_[np.ones(len(pdf)), pdf[features].to_numpy(float)]
        beta = poisson_irls(x, (pdf["y"] / pdf["n"]).to_numpy(float), pdf["n"].to_numpy(float), ridge)
        return pd.DataFrame({group: pdf[group].iloc[0], "term": ["intercept", *features], "coefficient": beta})

    return cells.groupBy(group).applyInPandas(run, f"{group} {kind}, term string, coefficient double")
