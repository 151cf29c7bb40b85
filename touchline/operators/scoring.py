"""Proper scores, calibration, ranking quality and intervals of probability forecasts."""

from __future__ import annotations

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAMP = 1e-15


def log_loss(p: Column) -> Column:
    """-ln of the probability given to what happened, clamped."""
    return -F.ln(F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP)))


def brier(ps: list[Column], hits: list[Column]) -> Column:
    return sum(((p - h) * (p - h) for p, h in zip(ps, hits, strict=True)), F.lit(0.0))


def ranked_score(ps: list[Column], hits: list[Column]) -> Column:
    """Half the sum of squared cumulative differences over ordered classes."""
    total, cp, ch = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for p, h in list(zip(ps, hits, strict=True))[:-1]:
        cp, ch = cp + p, ch + h
        total = total + (cp - ch) * (cp - ch)
    return total / 2


def first_argmax(ps: list[Column], names: list[str]) -> Column:
    """The class of the greatest probability; ties go to the first."""
    top = F.greatest(*ps)
    out = F.lit(names[-1])
    for p, name in reversed(list(zip(ps, names, strict=True))):
        out = F.when(p >= top, name).otherwise(out)
    return out


def bins(p: Column, n: int = 10) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("long")


def crps(pmf: Column, observed: Column) -> Column:
    """Continuous ranked probability score of a count distribution (array of probabilities from 0) against an observed count; mass beyond the array counts as above it."""
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, p: Column) -> Column:
        cdf = acc["cdf"] + p
        gap = cdf - F.when(acc["k"] >= observed, 1.0).otherwise(0.0)
        return F.struct(cdf.alias("cdf"), (acc["s"] + gap * gap).alias("s"), (acc["k"] + 1).alias("k"))

    return F.aggregate(pmf, start, step, lambda acc: acc["s"])


def auc(df: DataFrame, group: list[str], score: str, label: str, ranges: int = 1024) -> DataFrame:
    """group columns, auc: probability that a hit outranks a miss, ties counting half, from counts per distinct score (combined before the shuffle) instead of pairs. Scores are cut into ranges of 1 / ``ranges``, so that no group is sorted in one task; null groups and scores have none."""
    per = df.groupBy(*group, score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    # the misses below a score: those of the lower ranges, from one row per range, and those within the range
    per = per.withColumn("__p", F.floor(F.col(score) * ranges))
    low = per.groupBy(*group, "__p").agg(F.sum("neg").alias("n"))
    low = low.select(*group, "__p", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    w = Window.partitionBy(*group, "__p").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(low, [*group, "__p"]).withColumn("below", F.col("below") + F.col("__o"))
    out = per.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


#: Drawn blocks held in memory at once by the bootstrap; it changes no result.
DRAWN_AT_ONCE = 2**22


def _drawn_starts(rng: np.random.Generator | random.Random, top: int, replicates: int, blocks: int) -> np.ndarray:
    """Starts from 0 to ``top`` for each replicate's blocks: from numpy's generator, or one by one from Python's, whose published sequences can so be repeated."""
    if isinstance(rng, random.Random):
        return np.array([rng.randrange(top + 1) for _ in range(replicates * blocks)], dtype=np.int64).reshape(replicates, blocks)
    return rng.integers(0, top + 1, size=(replicates, blocks))


def block_bootstrap(losses: np.ndarray, replicates: int, block: int, seed: int, python_random: bool = False) -> np.ndarray:
    """Means of moving-block resamples of a series of paired differences, cut to its length.

    A block's sum is a difference of two running sums, so a replicate costs a number per block, not per value; replicates are made in chunks, so memory does not grow with them.
    """
    rng = random.Random(seed) if python_random else np.random.default_rng(seed)
    n = len(losses)
    block = min(block, n)
    blocks = -(-n // block)
    # the mean is taken out first, so that long running sums keep their digits
    mean = losses.mean()
    running = np.r_[0.0, np.cumsum(losses - mean)]
    cut = n - (blocks - 1) * block  # what the last block is cut to
    step = max(1, DRAWN_AT_ONCE // blocks)
    means = []
    for done in range(0, replicates, step):
        starts = _drawn_starts(rng, n - block, min(step, replicates - done), blocks)
        lengths = np.full(blocks, block)
        lengths[-1] = cut
        means.append((running[starts + lengths] - running[starts]).sum(1) / n + mean)
    return np.concatenate(means)


def batched_bootstrap(values: np.ndarray, batches: np.ndarray, replicates: int, block: int, seed: int, python_random: bool = False) -> np.ndarray:
    """Means of resamples by blocks of ``block`` consecutive batches (rows of one kick-off, numbered in order), each cut to the length of the series; with fewer batches than a block has, the plain mean twice."""
    starts = np.flatnonzero(np.r_[True, batches[1:] != batches[:-1]])
    if len(starts) < block:
        return np.array([values.mean(), values.mean()])
    ends = np.r_[starts[1:], len(values)]
    firsts, lasts = starts[: len(starts) - block + 1], ends[block - 1 :]
    n, mean = len(values), values.mean()
    running = np.r_[0.0, np.cumsum(values - mean)]
    rng = random.Random(seed) if python_random else np.random.default_rng(seed)
    means = np.empty(replicates)
    for r in range(replicates):
        taken, total = 0, 0.0
        while taken < n:
            at = rng.randrange(len(firsts)) if python_random else int(rng.integers(0, len(firsts)))
            size = min(lasts[at] - firsts[at], n - taken)
            total += running[firsts[at] + size] - running[firsts[at]]
            taken += size
        means[r] = total / n + mean
    return means


def independent_bootstrap(differences: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Means of resamples of paired differences, drawn independently with replacement; made in chunks."""
    rng = np.random.default_rng(seed)
    n, step = len(differences), max(1, DRAWN_AT_ONCE // max(1, len(differences)))
    return np.concatenate([differences[rng.integers(0, n, size=(min(step, samples - done), n))].mean(1) for done in range(0, samples, step)])


def bootstrap_intervals(df: DataFrame, group: str, order: str | list[str], value: str, replicates: int = 2000, block: int = 10, seed: int = 20260831) -> DataFrame:
    """group, mean, low, high, n: 95% moving-block bootstrap interval of the mean of ``value`` in time order, per group. End ``order`` with an id, so that it is total.

    A group is one series, which is resampled whole from its running sums (its size is that of an evaluation, not of the raw data); reduce series first.
    """
    orders = [order] if isinstance(order, str) else list(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(orders)[value].to_numpy(float)
        means = block_bootstrap(x, replicates, block, seed)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high], "n": [len(x)]})

    kind = dict(df.dtypes)[group]
    return df.select(group, *orders, value).groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double, n long")


def paired_intervals(df: DataFrame, domain: str, batch: str, order: str, candidate: str, reference: str, replicates: int = 2000, block: int = 10, seed: int = 20260831) -> DataFrame:
    """scope, mean, low, high, n, conclusion: how much less a candidate loses than the reference, on the same matches.

    Per domain by blocks of kick-off batches (scope: the domain's name), over all domains as their plain mean (``macro``) and their mean by size (``weighted``), with the same replicates, and
    over all matches as if they were independent (``independent``). CANDIDATE_BETTER where the whole interval lies below 0, CANDIDATE_WORSE where above, else INCONCLUSIVE.
    Rows in which either loss is null are left out. A domain is one series, of the size of an evaluation.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([batch, order])
        d = (pdf["c"] - pdf["r"]).to_numpy(float)
        number = int(pdf["number"].iloc[0])
        means = batched_bootstrap(d, pd.factorize(pdf[batch])[0], replicates, block, seed + number, True)
        means = np.resize(means, replicates) if len(means) != replicates else means
        return pd.DataFrame({"scope": [str(pdf[domain].iloc[0])], "n": [len(d)], "mean": [d.mean()], "means": [means.tolist()], "sums": [independent_sums(d).tolist()]})

    def independent_sums(d: np.ndarray) -> np.ndarray:
        # Poisson(1) weights: a resample of independent rows that parts can make on their own
        rng = np.random.default_rng([seed, len(d)])
        out = np.zeros((replicates, 2))
        for start in range(0, len(d), 4096):
            w = rng.poisson(1.0, size=(replicates, len(d[start : start + 4096])))
            out[:, 0] += w @ d[start : start + 4096]
            out[:, 1] += w.sum(1)
        return out.ravel()

    rows = df.where(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(domain, batch, order, F.col(candidate).alias("c"), F.col(reference).alias("r"))
    names = rows.select(domain).distinct()
    numbered = names.withColumn("number", F.row_number().over(Window.orderBy(domain)) - 1)  # one row per domain
    per = rows.join(F.broadcast(numbered), domain).groupBy(domain).applyInPandas(run, "scope string, n long, mean double, means array<double>, sums array<double>")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scope")
        means, n = np.stack(pdf["means"].to_numpy()), pdf["n"].to_numpy(float)
        sums = np.stack(pdf["sums"].to_numpy()).sum(0).reshape(replicates, 2)
        series = {**dict(zip(pdf["scope"], means, strict=True)), "macro": means.mean(0), "weighted": (means * n[:, None]).sum(0) / n.sum(), "independent": sums[:, 0] / np.maximum(sums[:, 1], 1)}
        whole = float((pdf["mean"] * n).sum() / n.sum())
        points = {**dict(zip(pdf["scope"], pdf["mean"], strict=True)), "macro": float(pdf["mean"].mean()), "weighted": whole, "independent": whole}
        sizes = {**dict(zip(pdf["scope"], n, strict=True)), "macro": n.sum(), "weighted": n.sum(), "independent": n.sum()}
        out = []
        for scope, values in series.items():
            low, high = np.quantile(values, [0.025, 0.975])
            out.append((scope, float(points[scope]), float(low), float(high), int(sizes[scope]), "CANDIDATE_BETTER" if high < 0 else "CANDIDATE_WORSE" if low > 0 else "INCONCLUSIVE"))
        return pd.DataFrame(out, columns=["scope", "mean", "low", "high", "n", "conclusion"])

    # a row per domain: bounded by their number
    return per.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: combine(pdf), "scope string, mean double, low double, high double, n long, conclusion string")


def calibration_gate(metrics: DataFrame, key: list[str], tolerance: dict[str, float], least_improved: int = 1, epsilon: float = 1e-12) -> DataFrame:
    """key columns, accepted, reasons: whether a calibration is taken over: no metric may get worse beyond its tolerance, and at least ``least_improved`` must get better.

    ``metrics`` has the key columns, metric, raw, calibrated (smaller is better); those without a tolerance are not looked at; a null is a regression.
    """
    bounds = F.create_map(*[x for k, v in tolerance.items() for x in (F.lit(k), F.lit(float(v)))])
    m = metrics.withColumn("t", F.try_element_at(bounds, F.col("metric"))).where("t is not null")
    worse = ~F.coalesce(F.col("calibrated") <= F.col("raw") + F.col("t"), F.lit(False))
    better = F.coalesce(F.col("calibrated") < F.col("raw") - epsilon, F.lit(False))
    out = m.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(worse, F.concat("metric", F.lit(" regression exceeds tolerance"))))).alias("reasons"), F.count_if(better).alias("improved"))
    reasons = F.concat("reasons", F.when(F.col("improved") < least_improved, F.array(F.lit("insufficient metric improvement"))).otherwise(F.array().cast("array<string>")))
    return out.select(*key, (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, "; ").alias("reasons"))


def admission_gate(intervals: DataFrame, domains: DataFrame, family: str) -> DataFrame:
    """family, verdict: ACCEPTED or REJECTED for a family of features by the intervals of its metric deltas.

    ``intervals``: family, metric (joint_log_loss, one_x_two_log_loss, brier, rps, crps), mean, high; ``domains``: family, domain, mean (joint log loss). The joint loss must fall by 0.003 with its whole interval
    below 0 and the result loss must not rise; the others may rise by 0.01 (CRPS 0.02) at most at the upper end; no domain by more than 0.02, and of three or more domains three must fall.
    """
    at = lambda metric, field: F.max(F.when(F.col("metric") == metric, F.col(field)))
    i = intervals.groupBy(family).agg(*[at(m, f).alias(f"{m}_{f}") for m in ("joint_log_loss", "one_x_two_log_loss", "brier", "rps", "crps") for f in ("mean", "high")])
    d = domains.groupBy(family).agg(F.max("mean").alias("worst"), F.count_if(F.col("mean") < 0).alias("falling"), F.count("*").alias("domains"))
    fine = (
        (F.col("joint_log_loss_mean") <= -0.003) & (F.col("joint_log_loss_high") < 0) & (F.col("one_x_two_log_loss_mean") <= 0) & (F.col("brier_high") <= 0.01) & (F.col("rps_high") <= 0.01) & (F.col("crps_high") <= 0.02)
        & (F.col("worst") <= 0.02) & ((F.col("domains") < 3) | (F.col("falling") >= 3))
    )
    return i.join(d, family, "left").select(family, F.when(F.coalesce(fine, F.lit(False)), "ACCEPTED").otherwise("REJECTED").alias("verdict"))


def gate(metrics: DataFrame, thresholds: dict[str, tuple[float, float]], name: str = "metric", value: str = "value") -> DataFrame:
    """metrics with a verdict per row: PASS at or below the first threshold of its metric, WARN at or below the second, else FAIL; metrics without thresholds and null values are UNKNOWN."""
    bounds = F.create_map(*[x for k, (a, b) in thresholds.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))])
    t = F.try_element_at(bounds, F.col(name))
    v = F.col(value)
    return metrics.withColumn("verdict", F.when(t.isNull() | v.isNull() | F.isnan(v), "UNKNOWN").when(v <= t["a"], "PASS").when(v <= t["b"], "WARN").otherwise("FAIL"))


def leaks(snapshots: DataFrame, key: str, document: str, cutoff: str, outcome_keys: tuple[str, ...] = ("home_goals", "away_goals", "outcome", "result")) -> DataFrame:
    """key, finding of feature snapshots (JSON objects of features, each with known_at in seconds) that hold an outcome or something known after the cutoff."""
    features = F.from_json(F.col(document), "map<string,struct<known_at:bigint>>")
    names = F.map_keys(features)
    outcome = F.exists(names, lambda k: F.lower(k).isin(*outcome_keys))
    late = F.exists(F.map_values(features), lambda v: F.coalesce(v["known_at"] > F.col(cutoff), F.lit(False)))
    finding = F.when(features.isNull(), "malformed").when(outcome, "outcome_key").when(late, "known_after_cutoff")
    return snapshots.select(key, finding.alias("finding")).where("finding is not null")


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, each value until it stands still; near the mean it takes about as many terms as the root of the greater parameter, in the tails few."""
    tiny = 1e-300
    out = np.empty(np.shape(x))
    flat, at = out.reshape(-1), np.arange(np.size(x))
    x, a, b = (np.ravel(v) for v in (x, a, b))
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 20_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        moving = np.abs(c * d - 1) >= 1e-14
        if not moving.all():
            flat[at[~moving]] = f[~moving]
            at, x, a, b, c, d, f = (v[moving] for v in (at, x, a, b, c, d, f))
        if not len(at):
            break
    flat[at] = f
    return out


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.vectorize(lgamma, otypes=[float])(x)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where it converges fast."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * _beta_fraction(x, a, b)))
    return np.where(flip, 1 - out, out)


def _beta_start(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Near the quantile, from that of a normal distribution (Abramowitz and Stegun 26.5.22); the mean where a parameter is below 1."""
    z = -NormalDist().inv_cdf(min(max(q, 1e-300), 1 - 1e-16))
    u, v = 1 / (2 * np.maximum(a, 1) - 1), 1 / (2 * np.maximum(b, 1) - 1)
    h, k = 2 / (u + v), (z * z - 3) / 6
    w = z * np.sqrt(h + k) / h - (v - u) * (k + 5 / 6 - 2 / (3 * h))
    x = a / (a + b * np.exp(np.clip(2 * w, -700, 700)))
    return np.where((a >= 1) & (b >= 1) & (x > 0) & (x < 1), x, a / (a + b))


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where ``beta_cdf`` reaches q: Newton steps held within a bracket that shrinks with every step, each value until its step is so short that the next is below rounding."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    out = np.ascontiguousarray(_beta_start(q, a, b))
    flat, at = out.reshape(-1), np.arange(out.size)
    a, b, x = a.ravel(), b.ravel(), out.flatten()
    low, high = np.zeros_like(x), np.ones_like(x)
    norm, width = _ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b), np.sqrt(a * b / (a + b) ** 3)
    for _ in range(200):
        if not len(at):
            break
        gap = beta_cdf(x, a, b) - q
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = x - gap / np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        short = 1e-7 * np.minimum(width, np.minimum(x, 1 - x))
        newton = (step >= low - short) & (step <= high + short)  # rounding may put the last step just beyond the bracket
        new = np.where(newton, np.clip(step, low, high), (low + high) / 2)
        flat[at] = new
        moving = ~(newton & (np.abs(new - x) <= short))
        at, a, b, x, low, high, norm, width = (v[moving] for v in (at, a, b, new, low, high, norm, width))
    return out


def clopper_pearson(hits: np.ndarray, n: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of a rate, from quantiles of the beta distribution."""
    k, n = np.asarray(hits, float), np.asarray(n, float)
    tail = (1 - level) / 2
    low = np.where(k <= 0, 0.0, beta_quantile(tail, np.maximum(k, 0.5), n - k + 1))
    high = np.where(k >= n, 1.0, beta_quantile(1 - tail, k + 1, np.maximum(n - k, 0.5)))
    return low, high


def exact_intervals(df: DataFrame, hits: str, n: str, level: float = 0.95) -> DataFrame:
    """df with low and high: the exact interval of each rate hits / n; null where n is null or not positive."""
    from collections.abc import Iterator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = (pdf[n] > 0).fillna(False).to_numpy(bool) & pdf[hits].notna().to_numpy()
            low, high = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            if ok.any():
                low[ok], high[ok] = clopper_pearson(pdf.loc[ok, hits].to_numpy(float), pdf.loc[ok, n].to_numpy(float), level)
            yield pdf.assign(low=low, high=high)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    out = df.mapInPandas(run, f"{schema}, low double, high double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})
