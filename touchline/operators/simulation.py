"""Deterministic Monte Carlo of score distributions: counter-based random numbers, so results do not depend on partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Constants of the generator, and the draws of a match in batches.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BATCHES, BATCH_DRAWS = 4, 28_115
#: Bits of a draw by which draws are counted before they are compared with bounds; of any number the counts are the same.
LEADING_BITS = 12


# The gates of a simulation. Limits of the difference between two batches, of half an interval, of the distance over all scores, and of one event's error; familywise levels of the intervals.
STABILITY_LIMIT, PRECISION_LIMIT, VARIATION_LIMIT, ERROR_LIMIT = 0.01997, 0.005, 0.012794580429261083, 0.008613326107968184
PRECISION_LEVEL, PARITY_LEVEL = 0.05, 0.01

_GOALS = ("0", "1", "2", "3", "4", "5+")
#: The derived events of a simulated score, in order: 36 scores, results, both score, totals over and under, clean sheets, totals, and the tail.
EVENTS = (
    *[f"score:{h}-{a}" for h in _GOALS for a in _GOALS], "outcome:home_win", "outcome:draw", "outcome:away_win", "btts:yes", "btts:no",
    *[f"total:{side}_{n}.5" for n in range(5) for side in ("over", "under")], *[f"clean_sheet:{side}_{x}" for side in ("home", "away") for x in ("yes", "no")], *[f"total_goals:{n}" for n in _GOALS], "unresolved_tail",
)
SCORES = 36


def event_matrix(home: np.ndarray, away: np.ndarray) -> np.ndarray:
    """One row per score, one column per event of EVENTS: whether the score is in it. Negative goals are the tail and in no other event."""
    at = {e: i for i, e in enumerate(EVENTS)}
    out = np.zeros((len(home), len(EVENTS)), dtype=bool)
    tail, total = home < 0, home + away
    rules = {"outcome:home_win": home > away, "outcome:draw": home == away, "outcome:away_win": home < away, "btts:yes": (home > 0) & (away > 0), "btts:no": (home == 0) | (away == 0)}
    for i, h in enumerate(_GOALS):
        for j, a in enumerate(_GOALS):
            rules[f"score:{h}-{a}"] = (np.minimum(home, 5) == i) & (np.minimum(away, 5) == j)
        rules[f"total_goals:{h}"] = np.minimum(total, 5) == i
    for n in range(5):
        rules |= {f"total:over_{n}.5": total > n, f"total:under_{n}.5": total <= n}
    for side, conceded in (("home", away), ("away", home)):
        rules |= {f"clean_sheet:{side}_yes": conceded == 0, f"clean_sheet:{side}_no": conceded > 0}
    for event, holds in rules.items():
        out[:, at[event]] = holds & ~tail
    out[:, -1] = tail
    return out


@lru_cache(64)
def _cached_matrix(home: bytes, away: bytes) -> np.ndarray:
    """``event_matrix`` as numbers: forecasts of one grid share it."""
    return event_matrix(np.frombuffer(home, dtype=np.int64), np.frombuffer(away, dtype=np.int64)).astype(np.float64)


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n outputs of SplitMix64; its state is a counter, so all come at once."""
    with np.errstate(over="ignore"):
        z = _counters(n) + np.uint64(seed)
        for shift, factor in ((30, MIX1), (27, MIX2)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        return z


@lru_cache(4)
def _counters(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.uint64(GAMMA) * np.arange(1, n + 1, dtype=np.uint64)


def unit(words: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1)."""
    return ((words >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def commitment(protocol: str, policy: str, probabilities: str) -> bytes:
    """The common part of a forecast's seeds: the hash of protocol, policy and the hash of its probabilities."""
    return hashlib.sha256((protocol + policy + probabilities).encode()).digest()


def seed_of(base: bytes, match: str, batch: int) -> int:
    """The seed of a batch: leading bytes of a hash over base, match and batch number, big endian."""
    return int.from_bytes(hashlib.sha256(base + match.encode() + batch.to_bytes(4, "big")).digest()[:8], "big")


def sample(cumulative: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """Counts of draws per atom: the first atom whose cumulative probability exceeds the uniform number."""
    words = splitmix64(seed, draws)
    if len(cumulative) <= 16:  # few atoms: counted below each bound, no search
        u = unit(words)
        below = np.array([np.count_nonzero(u < c) for c in cumulative[:-1]] + [draws])
        return np.diff(below, prepend=0)
    if not (np.diff(cumulative) >= 0).all():  # a negative or missing probability
        at = np.searchsorted(cumulative, unit(words), side="right")
        return np.bincount(np.minimum(at, len(cumulative) - 1), minlength=len(cumulative))
    # many atoms: draws are counted by their leading bits, and only those that share them with a bound are compared with it
    lead = (words >> np.uint64(64 - LEADING_BITS)).astype(np.intp)
    bounds = cumulative[:-1]
    edges = np.clip(np.floor(bounds * (1 << LEADING_BITS)), 0, (1 << LEADING_BITS) - 1).astype(np.intp)
    split = np.zeros(1 << LEADING_BITS, dtype=bool)
    split[edges] = True
    whole = np.bincount(lead, minlength=1 << LEADING_BITS)
    whole[split] = 0
    below = np.cumsum(whole)[edges] + np.searchsorted(np.sort(unit(words[split[lead]])), bounds)
    return np.diff(below, prepend=0, append=draws)


def simulate(forecasts: DataFrame, key: str, cells: str, base: bytes = b"touchline", batches: int = BATCHES, draws: int = BATCH_DRAWS) -> DataFrame:
    """key, batch, home, away, hits: draws per score of each forecast (cells: array of home, away, p; what is missing to 1 is the tail, home and away -1)."""
    kind = dict(forecasts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hits = []
            for k, batch, p in zip(pdf["k"], pdf["batch"], pdf["p"], strict=True):
                p = np.asarray(p, dtype=float)
                hits.append(sample(np.cumsum(np.append(p, max(0.0, 1 - p.sum()))), seed_of(base, str(k), int(batch)), draws))
            sizes = [len(h) for h in hits]
            goals = lambda c: np.concatenate([np.append(x, -1) for x in pdf[c]]) if len(pdf) else np.array([], dtype=int)  # noqa: B023, E731
            yield pd.DataFrame({"k": np.repeat(pdf["k"].to_numpy(), sizes), "batch": np.repeat(pdf["batch"].to_numpy(), sizes), "home": goals("home"), "away": goals("away"), "hits": np.concatenate(hits) if hits else []})

    part = lambda f: F.transform(cells, lambda x: x[f])
    spread = forecasts.select(F.col(key).alias("k"), part("home").alias("home"), part("away").alias("away"), part("p").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    spread = spread.repartition("k", "batch")  # one row is a batch of draws: spread them over the cores
    return spread.mapInPandas(run, f"k {kind}, batch int, home int, away int, hits long").withColumnRenamed("k", key)


def simulate_events(forecasts: DataFrame, key: str, cells: str, protocol: str = "touchline-simulation-v1", policy: str = "", batches: int = BATCHES, draws: int = BATCH_DRAWS) -> DataFrame:
    """key, counts (per event of EVENTS the draws of each batch), analytic (per event its probability): all batches of a forecast drawn and reduced together.

    The seed of a batch comes from the protocol, the policy, the hash of the forecast's probabilities, the key and the batch's number, so that a result can be drawn again anywhere.
    """
    kind = dict(forecasts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            counts, analytic = [], []
            for k, home, away, p in zip(pdf["k"], pdf["home"], pdf["away"], pdf["p"], strict=True):
                p = np.append(np.asarray(p, dtype=float), 0.0)
                p[-1] = max(0.0, 1 - p.sum())
                events = _cached_matrix(np.append(home, -1).astype(np.int64).tobytes(), np.append(away, -1).astype(np.int64).tobytes())
                base = commitment(protocol, policy, hashlib.sha256(p.tobytes()).hexdigest())
                cumulative = np.cumsum(p)
                counts.append(np.stack([sample(cumulative, seed_of(base, str(k), b), draws) for b in range(batches)]) @ events)
                analytic.append((p @ events).tolist())
            yield pd.DataFrame({"k": pdf["k"], "counts": [c.T.astype(np.int64).tolist() for c in counts], "analytic": analytic})

    part = lambda f: F.transform(cells, lambda x: x[f])
    rows = forecasts.select(F.col(key).alias("k"), part("home").alias("home"), part("away").alias("away"), part("p").alias("p"))
    # a row is many draws: rows are spread over the cores first, and few bytes are no reason to bring them together again
    return rows.repartition(4 * forecasts.sparkSession.sparkContext.defaultParallelism, "k").mapInPandas(run, f"k {kind}, counts array<array<bigint>>, analytic array<double>").withColumnRenamed("k", key)


def event_rates(simulated: DataFrame, key: str) -> DataFrame:
    """key, event, hits, analytic, widest: draws per event over all batches, its probability, and the greatest difference of its rate between two batches."""
    names = F.array(*[F.lit(e) for e in EVENTS])
    per = F.arrays_zip(names.alias("event"), F.col("counts"), F.col("analytic"))
    long = simulated.select(key, F.inline(per)).toDF(key, "event", "batches", "analytic")
    draws = F.lit(float(BATCH_DRAWS))
    return long.select(key, "event", F.aggregate("batches", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hits"), "analytic", ((F.array_max("batches") - F.array_min("batches")) / draws).alias("widest"))


@lru_cache(4)
def _known_bounds(n: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n + 1, np.nan), np.full(n + 1, np.nan)


def exact_bounds(hits: np.ndarray, n: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of each rate hits / n. There are n + 1 counts only, so a process works out each of them once, however many rows have it."""
    from touchline.operators.scoring import clopper_pearson

    known = _known_bounds(n, level)
    low, high = np.full(len(hits), np.nan), np.full(len(hits), np.nan)
    there = ~np.isnan(hits)
    k = hits[there].astype(np.int64)
    if k.min(initial=0) < 0 or k.max(initial=0) > n:
        raise ValueError(f"counts are not within 0 and {n}")
    new = np.unique(k)
    new = new[np.isnan(known[0][new])]
    if len(new):
        known[0][new], known[1][new] = clopper_pearson(new, np.full(len(new), n), level)
    low[there], high[there] = known[0][k], known[1][k]
    return low, high


def gates(rates: DataFrame, key: str, n: int = BATCHES * BATCH_DRAWS) -> DataFrame:
    """``rates`` (see ``event_rates``) with low, high (the exact familywise 95% interval of the rate) and verdict: TAIL_SAMPLED, UNSTABLE, IMPRECISE, OUT_OF_PARITY, else PASS.

    An event is in parity where its probability lies within the exact familywise 99% interval of its rate, that is, where neither tail of the binomial beyond the count is too thin.
    """
    from touchline.operators.scoring import beta_cdf

    schema = ", ".join(f"`{c}` {t}" for c, t in rates.dtypes)
    thin = PARITY_LEVEL / len(EVENTS) / 2

    def out_of_parity(hits: np.ndarray, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 0, 1)
        low, high = exact_bounds(hits, n, 1 - PARITY_LEVEL / len(EVENTS))
        out = (p < low) | (p > high)
        # within rounding of a bound, the tails themselves decide
        near = (np.abs(p - low) <= 1e-9 * low) | (np.abs(p - high) <= 1e-9 * high)
        if near.any():
            k, x = hits[near], p[near]
            at_least = np.where(k <= 0, 1.0, beta_cdf(x, np.maximum(k, 1), n - k + 1))
            at_most = np.where(k >= n, 1.0, 1 - beta_cdf(x, k + 1, np.maximum(n - k, 1)))
            out[near] = (at_least < thin) | (at_most < thin)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hits = pdf["hits"].to_numpy(float)
            low, high = exact_bounds(hits, n, 1 - PRECISION_LEVEL / len(EVENTS))
            verdict = np.select(
                [(pdf["event"] == EVENTS[-1]) & (hits > 0), pdf["widest"] > STABILITY_LIMIT, (high - low) / 2 > PRECISION_LIMIT, out_of_parity(hits, pdf["analytic"].to_numpy(float))],
                ["TAIL_SAMPLED", "UNSTABLE", "IMPRECISE", "OUT_OF_PARITY"], "PASS",
            )
            yield pdf.assign(low=low, high=high, verdict=verdict)

    return rates.mapInPandas(run, f"{schema}, low double, high double, verdict string")


def variation_gate(simulated: DataFrame, key: str, n: int = BATCHES * BATCH_DRAWS) -> DataFrame:
    """key, distance (half the sum of absolute differences over the 36 scores), worst (the greatest error of an event), verdict: FAIL beyond the limit of the distance, WARN beyond that of the error, else PASS."""
    rate = F.transform("counts", lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(float(n)))
    errors = F.zip_with(rate, F.col("analytic"), lambda a, b: F.abs(a - b))
    d = simulated.select(key, errors.alias("e"))
    d = d.select(key, (F.aggregate(F.slice("e", 1, SCORES), F.lit(0.0), lambda a, x: a + x) / 2).alias("distance"), F.array_max("e").alias("worst"))
    return d.withColumn("verdict", F.when(F.col("distance") > VARIATION_LIMIT, "FAIL").when(F.col("worst") > ERROR_LIMIT, "WARN").otherwise("PASS"))


def total_variation(hits: DataFrame, forecasts: DataFrame, key: str, cells: str) -> DataFrame:
    """key, distance: half the sum of absolute differences between drawn rates and probabilities over all scores and the tail."""
    expected = forecasts.select(key, F.inline(cells)).select(key, "home", "away", "p")
    tail = expected.groupBy(key).agg(F.greatest(1 - F.sum("p"), F.lit(0.0)).alias("p")).select(key, F.lit(-1).alias("home"), F.lit(-1).alias("away"), "p")
    drawn = hits.groupBy(key, "home", "away").agg(F.sum("hits").alias("n"))
    total = drawn.groupBy(key).agg(F.sum("n").alias("draws"))
    both = expected.unionByName(tail).join(drawn, [key, "home", "away"], "full").join(total, key)
    return both.groupBy(key).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("n", F.lit(0)) / F.col("draws"))) / 2).alias("distance"))
