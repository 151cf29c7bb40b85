"""Joint maximum-likelihood fits of score models on counts of scores per ordered pair of teams.

The log rates of a match are level + home advantage + attack - defence; the low scores are corrected by rho. Goals are Poisson, negative-binomial around the rate (nb2), or Poisson at a pace that
both sides of a match share and that is uniform around 1 (shared_pace). All parameters of a model are fitted together by a quasi-Newton method with its analytic gradient; the one number
that shapes the distribution is profiled. Nothing is as wide as teams times matches: gradients are sums by team.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("poisson", "nb2", "shared_pace")
#: Where the shape of each kind is looked for.
SHAPES = {"poisson": (0.0, 0.0), "nb2": (1e-4, 1.0), "shared_pace": (1e-3, 0.95)}
RHO_BOUND = 0.25


@dataclass(frozen=True)
class Fit:
    teams: np.ndarray
    attack: np.ndarray
    defence: np.ndarray
    level: float
    home: float
    rho: float
    shape: float
    loglik: float
    gradient: float


def _ln_factorial(k: np.ndarray) -> np.ndarray:
    table = np.array([math.lgamma(n + 1) for n in range(int(k.max(initial=0)) + 1)])
    return table[k.astype(int)]


def _poisson_tail(k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(Poisson(x) > k) and P(Poisson(x) = k)."""
    term, below = np.exp(-x), np.zeros_like(x)
    for j in range(int(k.max(initial=0)) + 1):
        below = np.where(j <= k, below + term, below)
        if j < k.max():
            term = term * x / (j + 1)
    at = np.exp(-x + k * np.log(np.maximum(x, 1e-300)) - _ln_factorial(k))
    return 1 - below, at


def goal_likelihood(kind: str, h: np.ndarray, a: np.ndarray, lh: np.ndarray, la: np.ndarray, shape: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log probability of scores and its derivatives by the two log rates."""
    base = h * np.log(lh) + a * np.log(la) - _ln_factorial(h) - _ln_factorial(a)
    if kind == "poisson":
        return base - lh - la, h - lh, a - la
    if kind == "nb2":
        out = np.zeros_like(lh)
        slopes = []
        for k, rate in ((h, lh), (a, la)):
            size = 1 / shape
            rising = np.array([sum(math.log1p(shape * j) for j in range(n)) for n in range(int(k.max(initial=0)) + 1)])[k.astype(int)]
            # ln Gamma(k + size) - ln Gamma(size) = k ln size + sum of ln(1 + j shape)
            out += rising + k * np.log(rate) - _ln_factorial(k) - (k + size) * np.log1p(shape * rate)
            slopes.append((k - rate) / (1 + shape * rate))
        return out, slopes[0], slopes[1]
    mu, k = lh + la, h + a
    up, pu = _poisson_tail(k, mu * (1 + shape))
    low, pl = _poisson_tail(k, mu * (1 - shape))
    mass = np.maximum(up - low, 1e-300)
    out = base + _ln_factorial(k) + np.log(mass) - math.log(2 * shape) - (k + 1) * np.log(mu)
    by_mu = ((1 + shape) * pu - (1 - shape) * pl) / mass - (k + 1) / mu
    return out, h + lh * by_mu, a + la * by_mu


def _tau(h: np.ndarray, a: np.ndarray, lh: np.ndarray, la: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ln of the correction of low scores, and its derivatives by the log rates and rho."""
    c = [(h == 0) & (a == 0), (h == 0) & (a == 1), (h == 1) & (a == 0), (h == 1) & (a == 1)]
    t = np.select(c, [1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, np.full_like(lh, 1 - rho)], 1.0)
    if t.min(initial=1.0) <= 0:
        return np.full_like(t, -np.inf), t, t, t
    dh = np.select(c[:3], [-lh * la * rho, lh * rho, 0 * lh], 0.0) / t
    da = np.select(c[:3], [-lh * la * rho, 0 * la, la * rho], 0.0) / t
    dr = np.select(c, [-lh * la, lh, la, np.full_like(lh, -1.0)], 0.0) / t
    return np.log(t), dh, da, dr


def maximise(f, x: np.ndarray, steps: int = 400, memory: int = 12, tolerance: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray]:
    """The maximum of a smooth function (value and gradient) by limited-memory quasi-Newton steps with backtracking."""
    value, grad = f(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        q, alphas = grad.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        else:
            q /= max(1.0, np.abs(grad).max())
        for (s, y), alpha in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            q += s * (alpha - (y @ q) / (y @ s))
        rate = 1.0
        while rate > 1e-12:
            new, g = f(x + rate * q)
            if np.isfinite(new) and new >= value + 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        s, y = rate * q, grad - g
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        x, value, grad = x + s, new, g
    return x, value, grad


def fit(rows: pd.DataFrame, kind: str = "poisson", ridge: float = 0.01, shape: float | None = None, precision: float = 5e-3) -> Fit:
    """The fit of weighted score counts (home, away, hg, ag, w). Attack and defence sum to zero; ``ridge`` penalises their squares. Without ``shape`` it is profiled by golden section, to ``precision`` of its range."""
    teams = np.unique(np.r_[rows["home"], rows["away"]])
    h_, a_ = np.searchsorted(teams, rows["home"]), np.searchsorted(teams, rows["away"])
    h, a, w = rows["hg"].to_numpy(float), rows["ag"].to_numpy(float), rows["w"].to_numpy(float)
    n = len(teams)
    start = np.zeros(2 * n + 3)
    start[2 * n] = math.log(max(0.1, ((h + a) * w).sum() / 2 / w.sum()))

    def objective(shape_: float):
        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            att, dfn = x[:n] - x[:n].mean(), x[n : 2 * n] - x[n : 2 * n].mean()
            rho = RHO_BOUND * math.tanh(x[-1])
            lh, la = np.exp(np.clip(x[2 * n] + x[2 * n + 1] + att[h_] - dfn[a_], -8, 4)), np.exp(np.clip(x[2 * n] + att[a_] - dfn[h_], -8, 4))
            ll, gh, ga = goal_likelihood(kind, h, a, lh, la, shape_)
            lt, th, ta, tr = _tau(h, a, lh, la, rho)
            value = float((w * (ll + lt)).sum() - ridge / 2 * (att @ att + dfn @ dfn))
            if not np.isfinite(value):
                return -np.inf, np.zeros_like(x)
            gh, ga = w * (gh + th), w * (ga + ta)
            g = np.empty_like(x)
            ga_ = np.bincount(h_, gh, n) + np.bincount(a_, ga, n) - ridge * att
            gd_ = -np.bincount(a_, gh, n) - np.bincount(h_, ga, n) - ridge * dfn
            g[:n], g[n : 2 * n] = ga_ - ga_.mean(), gd_ - gd_.mean()
            g[2 * n], g[2 * n + 1] = gh.sum() + ga.sum(), gh.sum()
            g[-1] = (w * tr).sum() * RHO_BOUND * (1 - math.tanh(x[-1]) ** 2)
            return value, g

        return f

    # a gradient this small moves no parameter in its fourth digit
    rest = 1e-5 * max(1.0, w.sum())

    def solve(shape_: float, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        return maximise(objective(shape_), x, tolerance=rest)

    low, high = SHAPES[kind]
    x = start
    if kind != "poisson" and shape is None:
        ratio = (math.sqrt(5) - 1) / 2
        width = (high - low) * precision

        def at(s: float) -> float:
            nonlocal x
            x, v, _ = solve(s, x)  # each look starts from the last
            return v

        a1, a2 = high - ratio * (high - low), low + ratio * (high - low)
        v1, v2 = at(a1), at(a2)
        while high - low > width:
            if v1 >= v2:
                high, a2, v2 = a2, a1, v1
                a1 = high - ratio * (high - low)
                v1 = at(a1)
            else:
                low, a1, v1 = a1, a2, v2
                a2 = low + ratio * (high - low)
                v2 = at(a2)
        shape = (low + high) / 2
    x, value, grad = solve(shape or 0.0, x)
    shape = shape or 0.0
    return Fit(teams, x[:n] - x[:n].mean(), x[n : 2 * n] - x[n : 2 * n].mean(), float(x[2 * n]), float(x[2 * n + 1]), RHO_BOUND * math.tanh(x[-1]), float(shape), value, float(np.abs(grad).max()))


def score_counts(matches: DataFrame, pool: str, half_life_days: float = 730.0) -> DataFrame:
    """pool, home, away, hg, ag, w: the time-decayed weight of each score of each ordered pair of teams, which is all a fit needs. Bounded by the pairs of a pool and the scores they reach."""
    newest = matches.groupBy(pool).agg(F.max("ko").alias("newest"))
    w = F.pow(F.lit(0.5), (F.col("newest") - F.col("ko")) / 86400.0 / half_life_days)
    return matches.join(newest, pool).groupBy(pool, "home", "away", "hg", "ag").agg(F.sum(w).alias("w"))


def fit_models(matches: DataFrame, pool: str, kinds: tuple[str, ...] = KINDS, ridge: float = 0.01) -> DataFrame:
    """pool, model, team, attack, defence, level, home_advantage, rho, shape, loglik, accepted: one fit per pool and kind; accepted where its projected gradient has come to rest."""
    kind_type = dict(matches.dtypes)[pool]
    team_type = dict(matches.dtypes)["home"]
    counts = score_counts(matches, pool).withColumn("model", F.explode(F.array(*[F.lit(k) for k in kinds])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit(pdf, pdf["model"].iloc[0], ridge)
        return pd.DataFrame({pool: pdf[pool].iloc[0], "model": pdf["model"].iloc[0], "team": f.teams, "attack": f.attack, "defence": f.defence, "level": f.level, "home_advantage": f.home, "rho": f.rho, "shape": f.shape, "loglik": f.loglik, "accepted": f.gradient < 1e-4 * max(1.0, pdf["w"].sum())})

    return counts.groupBy(pool, "model").applyInPandas(run, f"{pool} {kind_type}, model string, team {team_type}, attack double, defence double, level double, home_advantage double, rho double, shape double, loglik double, accepted boolean")
