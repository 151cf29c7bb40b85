"""Simulation at size: each interval worked out once and in few steps, draws counted by leading bits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import scoring, simulation

N = simulation.BATCHES * simulation.BATCH_DRAWS


@pytest.fixture
def evaluated(monkeypatch):
    """The numbers of values for which the continued fraction was worked out, call by call."""
    sizes, fraction = [], scoring._beta_fraction
    monkeypatch.setattr(scoring, "_beta_fraction", lambda x, a, b: sizes.append(np.size(x)) or fraction(x, a, b))
    return sizes


def test_bounds_of_many_draws_take_few_steps(evaluated):
    k = np.concatenate([np.arange(40), np.linspace(40, N / 2, 30).astype(int)])
    k = np.unique(np.concatenate([k, N - k]))
    level = 1 - simulation.PRECISION_LEVEL / len(simulation.EVENTS)
    low, high = scoring.clopper_pearson(k, np.full(len(k), N), level)
    assert sum(evaluated) <= 16 * len(k)
    assert (np.diff(low) > 0).all() and (np.diff(high) > 0).all() and low[0] == 0 and high[-1] == 1
    assert np.allclose(low, 1 - high[::-1], rtol=0, atol=1e-12)
    # the tail at a bound, added up term by term
    for n, hits in ((N, 7), (N, 1500), (N, 56_230), (400, 200), (1, 1)):
        p = float(scoring.clopper_pearson(np.array([hits]), np.array([n]), level)[0][0])
        i = np.arange(hits, min(n, hits + 5000) + 1)
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in i]
        assert math.fsum(terms) == pytest.approx((1 - level) / 2, rel=1e-8)


def test_a_count_is_worked_out_once(evaluated):
    simulation._known_bounds.cache_clear()
    hits = np.array([5.0, 70_000, np.nan, 5, 0, N])
    first = simulation.exact_bounds(hits, N, 0.95)
    before = len(evaluated)
    again = simulation.exact_bounds(np.tile(hits, 3), N, 0.95)
    assert before and len(evaluated) == before
    assert np.array_equal(again, np.tile(first, (1, 3)), equal_nan=True) and np.isnan(first[0]).tolist() == [False, False, True, False, False, False]
    with pytest.raises(ValueError, match="not within"):
        simulation.exact_bounds(np.array([N + 1.0]), N, 0.95)


def test_parity_at_the_bounds(spark):
    thin = simulation.PARITY_LEVEL / len(simulation.EVENTS) / 2
    rows = []
    for hits in (0, 1, 30, 5000, 56_230, N - 1, N):
        ends = simulation.exact_bounds(np.array([float(hits)]), N, 1 - 2 * thin)
        rows += [(len(rows) + i, "btts:yes", hits, float(e[0]) * (1 + d), 0.0) for e in ends for i, d in enumerate((-1e-6, -1e-8, -1e-12, 0, 1e-12, 1e-8, 1e-6))]
    df = spark.createDataFrame(rows, "id long, event string, hits long, analytic double, widest double")
    got = simulation.gates(df, "id").toPandas()
    k, p = got["hits"].to_numpy(float), np.clip(got["analytic"].to_numpy(), 0, 1)
    at_least = np.where(k <= 0, 1.0, scoring.beta_cdf(p, np.maximum(k, 1), N - k + 1))
    at_most = np.where(k >= N, 1.0, 1 - scoring.beta_cdf(p, k + 1, np.maximum(N - k, 1)))
    assert ((got["verdict"] == "OUT_OF_PARITY") == ((at_least < thin) | (at_most < thin))).all()
    assert {"PASS", "OUT_OF_PARITY"} == set(got["verdict"]) and simulation.gates(df.where(F.lit(False)), "id").collect() == []


def test_counts_by_leading_bits_are_those_of_a_search():
    rng = np.random.default_rng(4)
    for seed in range(60):
        u = simulation.unit(simulation.splitmix64(seed, 5000))
        some = np.concatenate([rng.choice(u, 20), np.nextafter(rng.choice(u, 10), 0), rng.integers(0, 4097, 20) / 4096, rng.random(60) * 1.01])
        cumulative = np.append(np.sort(np.repeat(some, 1 + seed % 2)), 1.0) if seed % 5 else np.append(some, 1.0)
        want = np.bincount(np.minimum(np.searchsorted(cumulative, u, side="right"), len(cumulative) - 1), minlength=len(cumulative))
        assert np.array_equal(simulation.sample(cumulative, seed, 5000), want), seed
